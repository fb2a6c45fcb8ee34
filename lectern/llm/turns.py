"""Prefix trie of conversations, built by burst tries.

A turn has an id of 16 bytes; a conversation's path is its ids in order, so the first 16 * d bytes of a path name a
trie node of depth d. Equal paths become one, with their count. At first one container under the root holds all
paths. A container with too many is burst: its head becomes a node and its paths go to containers one turn deeper, by
next turn id. A container that is small enough is sorted and swept into nodes in one task; burst heads are summed up
from what the containers below them report.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD, shuffled, stored, workroom

#: Bytes of a turn's id.
ID = 16

#: Paths of a container at most, or it bursts.
CONTAINER = 1024

#: Rows under one key are joined in so many parts.
SALTS = 16

#: Conversations of a copied path are listed in chunks of so many neighbouring ids (a power of two).
CHUNK_BITS = 16

#: A conversation takes its first turns from that with the next lower id divisible by ``BASE_EVERY``: ``crc32 % MOST_TURNS`` of them.
BASE_EVERY, MOST_TURNS = 20, 4

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

#: What a swept container gives: its nodes, and of its head the path and the words of its turns.
SWEPT = pa.schema(
    [*((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODES.split(", ")), ("head", pa.binary()), ("words", pa.list_(pa.int32()))]
)

#: The digest of no ids.
NONE = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    """The first 16 bytes of a SHA-256 of texts, told apart from any other texts by their lengths."""
    told = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.unhex(F.sha2(F.concat(*told).cast("binary"), 256)), 1, ID)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, each as ``id`` and ``words``.

    Null turns come first; equal turn numbers are ordered by role, then by the turn's id. Null roles and texts are
    empty. Rows without ``conv_id`` belong to no conversation. Repeated rows are turns each. Columns may have any name.
    A conversation's turns, 20 bytes or so each, are held together in a row.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].alias("turn"), role.alias("role"), _digest(role, text).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(found: DataFrame, every: int = BASE_EVERY, most: int = MOST_TURNS) -> DataFrame:
    """``conv_id, path, words``: each conversation with the first turns of its base in the place of its own."""
    own = found.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    both = own.join(bases, "base", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    both = both.select("conv_id", turns.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return both.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """``path, words, n, conv_id, ends``: each distinct path, its conversations' number and least id, and the SHA-256 of their ids.

    Ids are sorted and joined in chunks of neighbours; one path's chunks then run through one digest, a chunk at a time.
    """
    key = F.substring(F.unhex(F.sha2("path", 256)), 1, ID).alias("key")
    ids = F.sort_array(F.collect_list("conv_id"))  # 2^CHUNK_BITS at most
    chunks = convs.groupBy(key, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.array_join(ids.cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list = []
        state = None
        for batch in batches:
            done = []
            for k, path, words, n, first, ids in zip(*(batch[c] for c in ("key", "path", "words", "n", "conv_id", "ids"))):
                if open_ and open_[0] == k:
                    open_[3] += n
                    state.update(b"," + ids.encode())
                else:
                    if open_:
                        done.append((*open_[1:], state.hexdigest()))
                    open_, state = [k, path, words, n, first], hashlib.sha256(ids.encode())
            if done:
                yield pd.DataFrame(done, columns=["path", "words", "n", "conv_id", "ends"])
        if open_:
            yield pd.DataFrame([(*open_[1:], state.hexdigest())], columns=["path", "words", "n", "conv_id", "ends"])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(digest, "path binary, words array<int>, n long, conv_id long, ends string")


def _head(level: Column) -> Column:
    return F.substring(F.col("path"), F.lit(1), level * ID)


def contained(paths: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = CONTAINER) -> DataFrame:
    """``paths`` with ``level``, the turns of its container's head, and ``burst``: it ends at a burst head, which is no container any more.

    A round bursts every container of more than ``most`` paths by one turn; only their paths take part in the next one.
    """
    level, settled = 0, []
    open_ = keep(paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")))
    while True:
        at = open_.withColumn("head", _head(F.lit(level)))
        big = at.groupBy("head").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most)
        big = big.select("head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("burst"))
        told = keep(at.join(big, ["head", "salt"], "left").drop("head").withColumn("burst", F.coalesce("burst", F.lit(False))))
        ends = F.length("path") == level * ID
        settled.append(told.where(~F.col("burst") | ends).drop("salt").withColumn("level", F.lit(level)))
        open_ = told.where(F.col("burst") & ~ends).drop("burst")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        level += 1


#: Nodes that a task gathers before it hands them on.
NODES_AT_ONCE = 20_000


class _Node:
    __slots__ = ("children", "conv_id", "depth", "ends", "leaves", "n", "parent", "saved", "words")

    def __init__(self, parent: _Node | None, depth: int, words: int):
        self.parent, self.depth, self.words = parent, depth, words
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id, self.ends = None, NONE

    def add(self, n: int, conv_id: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def close(self) -> None:
        """All below it has been seen: the parent gets its sums."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.words
        if self.parent:
            self.parent.add(self.n, self.conv_id)
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // ID
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * ID : mid * ID] == b[low * ID : mid * ID]:
            low = mid
        else:
            high = mid - 1
    return low


def swept(rows: Iterator[tuple[int, bytes, list[int], int, int, str]]) -> Iterator[tuple]:
    """Nodes of containers, from their sorted ``level, path, words, n, conv_id, ends``; a container's head has its path and its turns' words too."""
    nodes: list[_Node] = []
    stack: list[_Node] = []
    level, last, lead = 0, b"", []

    def closed() -> Iterator[tuple]:
        while stack:
            stack.pop().close()
        for i, x in enumerate(nodes):
            head = (last[: level * ID], lead) if not i and level else (None, None)
            yield (x.conv_id, x.depth, x.parent.conv_id if x.parent else None, x.n, x.children, x.leaves, x.saved, x.ends, *head)
        nodes.clear()

    for at, path, words, n, conv_id, ends in rows:
        if not nodes or at != level or path[: at * ID] != last[: at * ID]:
            yield from closed()
            level, shared, lead = at, at, list(words[:at])
            nodes.append(_Node(None, at, words[at - 1] if at else 0))
            stack.append(nodes[0])
        else:
            shared = common_turns(last, path)
        while stack[-1].depth > shared:
            stack.pop().close()
        for d in range(shared, len(path) // ID):
            nodes.append(_Node(stack[-1], d + 1, words[d]))
            stack.append(nodes[-1])
        stack[-1].add(n, conv_id)
        stack[-1].ends = ends
        last = path
    yield from closed()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("level", "path", "words", "n", "conv_id", "ends"))))
    found = swept(rows)
    while some := list(itertools.islice(found, NODES_AT_ONCE)):
        yield pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*some), SWEPT)], schema=SWEPT)


def _above(found: DataFrame, own: bool) -> DataFrame:
    """``found`` once for each proper prefix of its ``path``, of ``up`` turns; ``own``: and for the path itself."""
    return found.withColumn("up", F.explode(F.sequence(F.lit(0), (F.length("path") / ID).cast("int") - (0 if own else 1)))).withColumn("head", _head(F.col("up")))


def burst_heads(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of burst heads with their ``path``, from what is reported to every head above: the tops of containers, and the paths that end at a head."""
    last = F.when(F.col("up") > 0, F.get("words", F.col("up") - 1)).otherwise(0).alias("words")
    below = _above(tops.select("path", "words", "n_convs", "conv_id", "n_leaves", "saved_tokens"), own=False)
    below = below.select("head", "up", last, "n_convs", "conv_id", "n_leaves", "saved_tokens", (F.length("path") == (F.col("up") + 1) * ID).cast("int").alias("child"), F.lit(None).cast("string").alias("ends"))
    here = _above(ended.select("path", "words", F.col("n").alias("n_convs"), "conv_id", "ends"), own=True)
    zero = F.lit(0).cast("long")
    here = here.select("head", "up", last, "n_convs", "conv_id", zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(0).alias("child"), F.when(F.length("path") == F.col("up") * ID, F.col("ends")).alias("ends"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens", "child")]
    heads = below.unionByName(here).groupBy("head", "up").agg(F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *sums)
    return heads.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumnRenamed("head", "path")


def prefix_nodes(conversations: DataFrame, most: int = CONTAINER, every: int = BASE_EVERY, most_turns: int = MOST_TURNS) -> DataFrame:
    """The nodes of the rebuilt conversations' trie, one row each, as the columns of ``NODES`` say.

    A conversation without turns is a member of the root only. Nulls, ties, repeated rows and clashing names are
    handled as ``sequences`` says; an empty table has no conversation, so no node. Turns are told apart by 16 bytes of
    a SHA-256 of role and text.
    """
    with shuffled(conversations.sparkSession), workroom(conversations.sparkSession) as keep:
        paths = distinct_paths(rebuilt(keep(sequences(conversations)), every, most_turns))
        dealt = contained(paths, keep, most)
        inside, ended = dealt.where(~F.col("burst")), dealt.where("burst")
        nodes = keep(inside.repartition(_head(F.col("level"))).sortWithinPartitions("path").mapInArrow(_sweep, NODES + ", head binary, words array<int>"))
        tops = nodes.where("head IS NOT NULL").withColumnRenamed("head", "path")
        heads = keep(burst_heads(tops, ended))
        more = _above(heads, own=False).where("length(path) > 0").groupBy(F.col("head").alias("path")).agg(
            F.sum("own").alias("more_saved"), F.sum((F.length("path") == (F.col("up") + 1) * ID).cast("long")).alias("more_children")
        )
        whole = heads.join(more, "path", "left").select(
            "path", "conv_id", F.col("up").cast("long").alias("depth"), "n_convs", (F.col("child") + F.coalesce("more_children", F.lit(0))).alias("n_children"), "n_leaves",
            (F.col("saved_tokens") + F.col("own") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
        )
        columns = [c.split()[0] for c in NODES.split(", ")]
        upper = tops.select("path", *(c for c in columns if c != "parent_conv_id")).unionByName(whole)
        upper = upper.withColumn("up", F.when(F.col("depth") > 0, _head(F.col("depth").cast("int") - 1))).withColumn("salt", F.pmod("conv_id", F.lit(SALTS)).cast("int"))
        parents = heads.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        upper = upper.join(parents, ["up", "salt"], "left")
        return stored(nodes.where("head IS NULL").select(columns).unionByName(upper.select(columns)))
