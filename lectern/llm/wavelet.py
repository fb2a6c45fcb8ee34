"""Token ids on disk as wavelet matrices: one compressed file a shard, with rank and select.

A shard holds consecutive documents in ascending ``doc_id`` order. Its bit-planes answer which token stands at a
place, how often a token occurs before a place and where its k-th occurrence is, without decoding the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import slices
from lectern.llm.common import chained, scratch
from lectern.llm.tokens import BATCH_BYTES, encoder

#: Tokens of a shard, but for a longer document, which has its own.
SHARD_TOKENS = 1 << 20

#: 64-bit words between two samples of a plane's ranks.
SAMPLE = 8

SHARD = "part int, seq int, n long, width int, zeros array<long>, doc_ids array<long>, sizes array<long>, ranks binary, planes binary"


class WaveletMatrix:
    """Bit-planes of a sequence, the highest bit first; each plane's zeros go before its ones in the next."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        zeros, planes, ranks, cur = [], [], [], ids
        for level in range(width - 1, -1, -1):
            ones = (cur >> ids.dtype.type(level)) & ids.dtype.type(1) != 0
            packed = np.packbits(ones, bitorder="little")
            plane = np.zeros(-(-len(ids) // 64), "<u8")
            plane.view(np.uint8)[: len(packed)] = packed
            low, high = cur[~ones], cur[ones]
            zeros.append(len(low))
            planes.append(plane)
            ranks.append(cls._samples(plane))
            cur = np.concatenate([low, high])
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _samples(plane: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(plane).astype(np.uint32)
        return np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(counts), SAMPLE)))]).astype("<u4") if len(counts) else np.zeros(1, "<u4")

    @classmethod
    def read(cls, n: int, width: int, zeros: list[int], ranks: bytes, planes: bytes) -> WaveletMatrix:
        words = -(-n // 64)
        p = np.frombuffer(planes, "<u8").reshape(width, words)
        r = np.frombuffer(ranks, "<u4").reshape(width, -(-words // SAMPLE) + 1)
        return cls(n, list(zeros), list(p), list(r))

    def blobs(self) -> tuple[bytes, bytes]:
        return b"".join(r.tobytes() for r in self.ranks), b"".join(p.tobytes() for p in self.planes)

    def _rank1(self, k: int, at: int) -> int:
        """Ones of plane k before a place."""
        word, bit = divmod(at, 64)
        block = word // SAMPLE
        ones = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][block * SAMPLE : word]).sum())
        return ones + (int(self.planes[k][word]) & ((1 << bit) - 1)).bit_count() if bit else ones

    def access(self, at: int) -> int:
        """The token at a place."""
        value = 0
        for k, z in enumerate(self.zeros):
            one = int(self.planes[k][at // 64]) >> (at % 64) & 1
            ones = self._rank1(k, at)
            value, at = value << 1 | one, z + ones if one else at - ones
        return value

    def rank(self, token: int, at: int) -> int:
        """How often a token occurs before a place."""
        low, high = self._range(token, at)
        return high - low

    def _range(self, token: int, at: int) -> tuple[int, int]:
        low, high, width = 0, at, len(self.zeros)
        for k, z in enumerate(self.zeros):
            a, b = self._rank1(k, low), self._rank1(k, high)
            low, high = (z + a, z + b) if token >> (width - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0; IndexError if it has fewer."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, width = low + k, len(self.zeros)
        for level in range(width - 1, -1, -1):
            one = token >> (width - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def _select(self, k: int, nth: int, one: int) -> int:
        samples = self.ranks[k].astype(np.int64)
        if not one:
            samples = np.minimum(np.arange(len(samples)) * 64 * SAMPLE, self.n) - samples
        block = int(np.searchsorted(samples, nth, "right")) - 1
        left = nth - int(samples[block])
        words = self.planes[k][block * SAMPLE : (block + 1) * SAMPLE]
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")
        return block * SAMPLE * 64 + int(np.flatnonzero(bits == one)[left])

    def decode(self) -> np.ndarray:
        """The whole sequence: planes are undone from the lowest bit up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty_like(v)
            out[~ones] = v[: self.zeros[k]]
            out[ones] = v[self.zeros[k] :] | kind(1 << (len(self.zeros) - 1 - k))
            v = out
        return v


def _row(part: int, seq: int, doc_ids: list, sizes: list[int], ids: np.ndarray, width: int) -> dict:
    w = WaveletMatrix.of(ids, width)
    ranks, planes = w.blobs()
    return {"part": part, "seq": seq, "n": w.n, "width": width, "zeros": w.zeros, "doc_ids": doc_ids, "sizes": sizes, "ranks": ranks, "planes": planes}


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes ``docs(doc_id, text)``, appends ``end_id`` to each and writes shards in ascending ``doc_id`` order.

    Null and empty texts hold the end id alone. Repeated rows are kept, rows of one id ordered by their text's hash;
    null ids come first. An empty table writes no shard. Other columns are ignored. One task holds a shard at a time.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("zeros", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ranks", pa.binary()), ("planes", pa.binary())])

    def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        width = max(end_id, len(e.widths) - 1).bit_length()
        held: list[np.ndarray] = []
        held_ids, sizes, seq, part = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_row(part, seq, held_ids, sizes, chained(held, e.dtype), width)], schema)

        for batch in rows:
            at = 0
            for some in slices(batch.column(1), BATCH_BYTES):
                counts, flat = e.tokens(some)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                counts, ends = counts + 1, ends + np.arange(1, len(ends) + 1)
                doc_ids, k = batch.column(0).slice(at, len(some)).to_pylist(), 0
                part = batch.column(2)[at].as_py()
                while k < len(counts):
                    before = int(ends[k - 1]) if k else 0
                    to = int(np.searchsorted(ends, before + shard_tokens - sum(sizes), "right"))
                    if to == k and not held_ids:
                        to = k + 1
                    if to > k:
                        held.append(flat[before : ends[to - 1]])
                        held_ids += doc_ids[k:to]
                        sizes += counts[k:to].tolist()
                        k = to
                    if k < len(counts):
                        yield shard()
                        held, held_ids, sizes, seq = [], [], [], seq + 1
                at += len(some)
        if held_ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(folder)


def document_table(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the shards' own contents."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                ids = WaveletMatrix.read(r["n"], r["width"], r["zeros"], r["ranks"], r["planes"]).decode().astype("<u4")
                data, sizes = memoryview(ids.tobytes()), np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[4 * (b - a) : 4 * b]) for a, b in zip(sizes.tolist(), ends.tolist())]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * k, pa.int32()), pa.array([r["seq"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    # Shards are few: one row for some millions of tokens; the running sum is over their sizes alone.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    found = shards.mapInArrow(decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the shards to ``folder`` (a new shared one by default) and returns ``document_table`` of what it reads back."""
    folder = folder or scratch(docs.sparkSession)
    write_shards(docs, tokenizer, folder, end_id)
    return document_table(read_shards(docs.sparkSession, folder))


def _each(row: dict) -> WaveletMatrix:
    return WaveletMatrix.read(row["n"], row["width"], row["zeros"], row["ranks"], row["planes"])


def accessed(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, at, token`` for the places ``wanted(doc_id, at)``, from the documents' bit-planes without decoding them.

    A place that a document doesn't have gives no row; repeated places give one; of rows that share an id each is looked
    up. Places are distinct, so a shard is asked for no more of them than it has tokens.
    """
    docs = shards.select("part", "seq", F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("sizes").alias("size"))).alias("k", "d")).select("part", "seq", "k", "d.*")
    before = Window.partitionBy("part", "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    asked = docs.join(wanted.select("doc_id", "at").distinct(), "doc_id").where((F.col("at") >= 0) & (F.col("at") < F.col("size")))
    asked = asked.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "at", (F.col("first") + F.col("at")).alias("place"))).alias("asked"))

    def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                w = _each(r)
                yield pa.RecordBatch.from_pylist([{"doc_id": x["doc_id"], "at": x["at"], "token": w.access(x["place"])} for x in r["asked"]], pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("token", pa.int64())]))

    return shards.join(asked, ["part", "seq"]).mapInArrow(look, "doc_id long, at long, token long")


def counted(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n`` of a short list of tokens: how often each stands in the files, by two ranks a bit-plane and shard."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                w = _each(r)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([w.count(t) if t >> r["width"] == 0 else 0 for t in tokens], pa.int64())], ["token", "n"])

    return shards.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def located(shards: DataFrame, token: int) -> DataFrame:
    """``doc_id, at`` of every occurrence of a token, one select each; a document's places count from 0."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                w = _each(r)
                places = np.array([w.select(token, k) for k in range(w.count(token))] if token >> r["width"] == 0 else [], np.int64)
                ends = np.cumsum(np.array(r["sizes"], np.int64))
                of = np.searchsorted(ends, places, "right")
                firsts = ends - np.array(r["sizes"], np.int64)
                ids = pa.array(r["doc_ids"], pa.int64()).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(places - firsts[of], pa.int64())], ["doc_id", "at"])

    return shards.mapInArrow(find, "doc_id long, at long")
