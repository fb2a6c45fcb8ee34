"""Token counts of whole texts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.llm.bpe import Encoder, slices
from lectern.llm.common import chained

#: Bytes of text that are encoded together.
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 1024, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``.

    Counts are those of the tokenizers library for the vocabulary file at ``path``, without added special tokens.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; an empty table gives none; other
    columns are ignored. Texts of any length are encoded whole.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in rows:
            sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            found = chained([e.tokens(part, ids=False)[0] for part in slices(batch.column(1), batch_bytes)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found), pa.array(found > max_tokens)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
