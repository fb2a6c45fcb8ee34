"""Helpers that several operators share: whole-text words, hashes, scratch tables."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as the contracts define it, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Words a worker remembers the hash of; later words are hashed each time.
WORD_CACHE = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only on a local master without the setting, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/lectern/{uuid.uuid4().hex}"


#: The setting by which Spark removes a query's shuffle files at its end rather than at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled(spark: SparkSession) -> Iterator[None]:
    """Joins are planned by shuffle for any size of their sides: one plan for small and large input, no broadcast that grows."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def workroom(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored`` for tables that nothing reads after the block: their folder is removed at its end."""
    folder = scratch(spark)
    try:
        yield lambda df: stored(df, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def placed(docs: DataFrame) -> DataFrame:
    """``row``, all columns of ``docs`` as one struct, and ``place``: the row's number in the order of the files and of the rows in them.

    A place holds however the files are read, tells equal rows apart, and keeps the order in which they were written.
    Rows that are not read from files as they are will be stored first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stored(docs)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    # One row a file; numbered names that outgrow their zeros are longer.
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(files), "file").select("row", (F.col("first") + F.col("at")).alias("place"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text: ``bytes.split`` cuts at 0x20 and 0x09-0x0D exactly; A-Z are lower-cased."""
    return text.lower().split() if text else []


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text counts as one shingle, an empty one as none."""
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    s = h[: n - width + 1].copy()
    for j in range(1, width):
        s = mix(s + _P) + h[j : n - width + 1 + j]
    return np.unique(mix(s + np.uint64(width)))


def binaries(column: pa.Array) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batches(texts: list[bytes | None], limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes each; a longer text stands alone."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            out.append((start, i))
            start, held = i, 0
        held += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def chained(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def flat(lists) -> list:
    return list(itertools.chain.from_iterable(lists))
