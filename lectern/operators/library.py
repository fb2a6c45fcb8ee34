"""Snapshots of a library: describing, merging, deleting, finding what is stale."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_describe(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()))


def restore_merge(local: DataFrame, backup: DataFrame, key: list[str], updated: str) -> DataFrame:
    """Both sides by key, the later row of each, the local one on a tie; ``action`` tells added, updated or kept."""
    rest = [c for c in local.columns if c not in key]
    a = local.select(*key, F.struct(*rest).alias("_a"))
    b = backup.select(*key, F.struct(*rest).alias("_b"))
    joined = a.join(b, key, "full_outer")
    newer = F.col("_a").isNull() | (F.col(f"_b.{updated}") > F.col(f"_a.{updated}"))
    action = F.when(F.col("_a").isNull(), "added").when(F.coalesce(newer, F.lit(False)), "updated").otherwise("kept")
    picked = F.when(action == "kept", F.col("_a")).otherwise(F.col("_b"))
    return joined.select(*key, picked.alias("_p"), action.alias("action")).select(*key, *(f"_p.{c}" for c in rest), "action")


def restore_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def cascade_delete(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def stale_rows(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, state`` of each document against its index row: fresh, renamed, stale or missing."""
    i = index.select(F.col("doc_id"), F.col("title").alias("_t"), F.col("n_words").alias("_n"))
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") != F.col("n_words"), "stale").when(F.col("_t") != F.col("title"), "renamed").otherwise("fresh")
    return docs.join(i, "doc_id", "left").select("doc_id", state.alias("state"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's executors share one; a temporary one only on a local master without the setting, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to a new shared folder and read again: what several steps read is made once, and a lost executor costs nothing."""
    folder = shared_folder(rows.sparkSession, "lectern-kept")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def export(tables: dict[str, DataFrame]) -> str:
    """Writes each table below one new shared folder, which is returned."""
    folder = shared_folder(next(iter(tables.values())).sparkSession, "lectern-snapshot")
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    return folder
