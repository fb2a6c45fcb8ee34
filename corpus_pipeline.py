"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, piece encoding.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import queries as q
from lectern.llm.common import documents, stored

STAGES = [
    ("quality rules", q.quality_stage),
    ("line dedup", q.line_stage),
    ("n-gram Jaccard join", q.near_duplicate_stage),
    ("mixing sources to target weights", q.mixing_stage),
    ("SentencePiece encoding and decoding", q.encoding_stage),
]

#: SQL can't express seeded segmentations; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
