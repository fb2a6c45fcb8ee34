"""Seeded orders of rows, and the words that are no terms of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import fnv1a

#: Capitalised words that are no terms.
STOPWORDS = (
    "the", "this", "that", "these", "those", "there", "then", "when", "where", "while", "which", "what", "who", "whom", "whose", "each", "every", "any", "all", "some", "both",
    "for", "from", "with", "without", "however", "therefore", "because", "although", "though", "since", "after", "before", "during", "under", "over", "into", "onto", "such",
    "they", "their", "them", "its", "his", "her", "our", "your", "and", "but", "not", "may", "must", "should", "would", "could", "will", "shall", "can", "has", "have", "had",
    "was", "were", "are", "been", "being", "section", "figure", "table", "chapter", "appendix", "note", "example",
)


def seeded_shuffle(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """``rows(key)`` with their place in the order of the seeded hash: in a bucket of hashes, after those of the buckets before."""
    h = fnv1a(F.concat(F.lit(seed), F.col(key).cast("string")))
    out = rows.select(key, h.alias("h")).withColumn("bucket", F.floor(F.col("h") / (1 << 20)))
    sizes = out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # 4096 rows at most
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    return out.withColumn("inner", inner).join(F.broadcast(bases), "bucket").select(key, "h", (F.col("base") + F.col("inner")).alias("place"))
