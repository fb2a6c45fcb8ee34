"""Document fingerprints: all shingle hashes below a fixed fraction of the hash range.

Such sketches merge by union, and the share of one sketch found in another estimates containment even where one
document is far larger. The least hash is kept too, so that no text with words has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WordHashes, shingles, stored, words

#: Words of a shingle, and one part in how many of the hash range is kept.
SHINGLE, SCALE = 5, 8

PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def sketch(text: bytes | None, hashes: WordHashes, k: int = SHINGLE, scale: int = SCALE) -> np.ndarray:
    s = shingles(hashes.of(words(text)), k)
    return s[: max(1, int(np.searchsorted(s, np.uint64(2**64 // scale))))]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    s = np.union1d(a, b)
    return s[: max(1, int(np.searchsorted(s, np.uint64(2**64 // scale))))]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the Jaccard similarity; two empty sketches are alike."""
    both = _shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the share of a's shingles that b has; an empty sketch is contained in any."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def text_of(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def sketch_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``doc_id, fingerprint`` of each row. A null or empty text has an empty fingerprint; equal texts equal ones."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHashes()
        for batch in rows:
            made = [text_of(sketch(t.encode() if t else None, h, k, scale)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


class _Pairs:
    """Rows of a document and the one after it."""

    def __init__(self, k: int, scale: int) -> None:
        self.k, self.scale, self.hashes = k, scale, WordHashes()
        self.rows: list[tuple] = []

    def sketch(self, text: str) -> np.ndarray:
        return sketch(text.encode(), self.hashes, self.k, self.scale)

    def add(self, doc_id, text: str, own: np.ndarray, after: str, next_own: np.ndarray) -> None:
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        changed = self.sketch(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        self.rows.append((doc_id, len(text), sha, text_of(own), text_of(changed), likeness(own, changed), likeness(own, next_own), containment(own, changed)))

    def out(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        columns = list(zip(*self.rows)) if self.rows else [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in PAIRS.split(", ")])


def _range(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds do not pass an id, by bisection; -1 for a null id."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    table = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else None
    at = F.lit(0)
    if steps:
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(table, n + step - 1) <= doc_id, n + step).otherwise(n))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(at)


def edited_fingerprints(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next text's are.

    The edited form has its last third replaced by as many first characters of the next document in descending
    ``doc_id`` order (after the last, the first). Null texts count as empty; rows of one id are ordered by their
    text's hash; null ids come last; a single row follows itself; an empty table gives no rows; other columns are
    ignored. Texts are shuffled by ranges of ids whose bounds are fixed beforehand, once for their rows and once to find
    each range's first and last row; a range's last row meets the next range's first in a small join with one row a range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []  # one number a range
    order = [F.col("part").desc(), F.col("known").desc(), F.col("doc_id").desc(), F.col("tie").desc()]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.col("doc_id").isNotNull().alias("known"), _range(F.col("doc_id"), sorted(set(bounds))).alias("part"))
    ranged = rows.repartition(n, "part")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = _Pairs(k, scale), None
        for batch in batches:
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                own = made.sketch(text)
                if last and last[0] == part:
                    made.add(*last[1:], text, own)
                last = part, doc_id, text, own
                if len(made.rows) >= 2000:
                    yield made.out()
        yield made.out()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Pairs(k, scale)
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns)):
                made.add(doc_id, text, made.sketch(text), after, made.sketch(after))
        yield made.out()

    most = ranged.sortWithinPartitions(*order).select("doc_id", "text", "part").mapInArrow(inner, PAIRS)
    key, whole = F.struct("known", "doc_id", "tie"), F.struct("doc_id", "text")
    edges = stored(ranged.groupBy("part").agg(F.max_by(whole, key).alias("head"), F.min_by(whole, key).alias("last")))
    # The windows see one number a range, no text.
    down, every = Window.orderBy(F.col("part").desc()), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = edges.select("part", F.coalesce(F.lead("part").over(down), F.max("part").over(every)).alias("next"))
    heads = edges.select(F.col("part").alias("next"), F.col("head.text").alias("after"))
    rest = edges.select("part", "last").join(follows, "part").join(heads, "next").select("last.doc_id", "last.text", "after").mapInArrow(ends, PAIRS)
    return most.unionByName(rest)
