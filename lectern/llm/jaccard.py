"""Exact n-gram Jaccard join and its connected components, by an inverted index over short prefixes of the sets.

Set relations save most of the work. Equal sets are one set. In each list the other sets meet the set that stands
nearest its own start first, and each set is compared with one such leader. What a set adds to its leader and what it
lacks then stand for it: the answers between sets of one leader are derived from these differences alone, by an
index of their own. Sets of different leaders meet in lists that are cut into blocks by size and position; a block
that can't reach the threshold with another is skipped as a whole. Pairs inside one component need no answer, and of the
others those whose parity bitmaps are too far apart need none either: both bounds are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WordHashes, binaries, chained, placed, shingles, shuffled, stored, words, workroom

#: Words of a shingle; sets link when 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 4, 85

#: A shingle counts as frequent from one in so many of all shingles (so there are no more than this many), and from
#: this many sets at least. Only the order of a set's shingles depends on it, never the result.
FREQUENT_PART, FREQUENT_LEAST = 1 << 21, 16

#: Shingles that are counted together before they are sent on.
COUNT_BLOCK = 4 << 20

#: Entries of a list that are one block; a leader of so many sets has blocks of its own.
SHORT_LIST = 32

#: A set's parity bitmap: 64-bit words for so many shingles, doubled with the set so many times at most.
BITMAP, BITMAP_SIZE, BITMAP_MOST = 16, 768, 9

#: The least share of a set that its leader must be able to have.
LED_PERCENT = 75

#: Bits of the filter (log2) that keeps most texts without a candidate out of the verification.
LG_FILTER = 24


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least intersection that links sets of two sizes."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-9).cast("int")


class _Sets:
    def __init__(self, k: int) -> None:
        self.k, self.hashes = k, WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        return shingles(self.hashes.of(words(text)), self.k)

    @staticmethod
    def bitmap(s: np.ndarray) -> np.ndarray:
        """Each bit tells whether an odd number of the set's shingles fall on it."""
        width = 64 * BITMAP << min(BITMAP_MOST, max(0, (len(s) - 1) // BITMAP_SIZE).bit_length())
        odd = np.bincount((s >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    @staticmethod
    def key(s: np.ndarray) -> int:
        """A signed 64-bit key of the set; with the set's size, it stands for the set."""
        import xxhash

        return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """``kind, key, a, b, bits``: kind 0 is a document (id, set key, set size, bitmap), 1 a shingle met twice or more in a block (shingle, times)."""
    names = ["kind", "key", "a", "b", "bits"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = _Sets(k), set()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            keys, times = np.unique(chained(held, np.uint64), return_counts=True)
            keys, times = keys[times > 1], times[times > 1]
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(_signed(keys)), pa.array(times.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names)

        for batch in rows:
            keys, sizes, bits = [], [], []
            for text in binaries(batch.column(1)):
                s = sets.of(text)
                keys.append(key := sets.key(s))
                sizes.append(len(s))
                bits.append(sets.bitmap(s))
                if key not in seen and len(s):
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size >= COUNT_BLOCK:
                    yield counted()
                    held, size = [], 0
            n = len(keys)
            ends = np.cumsum([0, *map(len, bits)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(chained(bits, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), flat], names)
        if held:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, key long, a long, b int, bits array<long>")


def _most(a: str, b: str, size_a: str, size_b: str) -> Column:
    """The most that two sets can share: each bit in which bitmaps of one width differ is a shingle of one set only."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.least(size_a, size_b, F.when(F.size(a) == F.size(b), F.floor((F.col(size_a) + F.col(size_b) - apart) / 2).cast("int")))


def entries(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``shingle, id, size, at``: the index entries of each set's prefix, rare shingles first.

    ``frequent`` holds the frequent shingles, rarest first. Sets that link share a shingle of both their prefixes.
    """
    order = np.argsort(frequent, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = _Sets(k), set()
        table, place = shared.value
        for batch in rows:
            found, ids, sizes, at = [], [], [], []
            for text in binaries(batch.column(1)):
                s = sets.of(text)
                n = len(s)
                key = sets.key(s)
                if not n or key in seen:
                    continue
                seen.add(key)
                if len(table):
                    i = np.searchsorted(table, s)
                    common = table[np.minimum(i, len(table) - 1)] == s
                    if common.any():
                        last = s[common]
                        s = np.concatenate([s[~common], last[np.argsort(place[i[common]], kind="stable")]])
                prefix = n - -(-percent * n // 100) + 1
                found.append(s[:prefix])
                ids.append(np.full(prefix, key, np.int64))
                sizes.append(np.full(prefix, n, np.int32))
                at.append(np.arange(prefix, dtype=np.int32))
            columns = [_signed(chained(found, np.uint64)), chained(ids, np.int64), chained(sizes, np.int32), chained(at, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "id", "size", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "shingle long, id long, size int, at int")


def _bits(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over ``id``: one bit a hash."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << LG_FILTER))
    word, bit = F.shiftright(place, 5).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))
    rows = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # 2^(LG_FILTER - 5) rows at most
    out = np.zeros(1 << (LG_FILTER - 5), np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``id, shingles`` of the sets in ``wanted(id, doc_id, ...)``, with its other columns; texts that the filter excludes are not sent on."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.col("doc_id").alias("id"))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << LG_FILTER)).alias("place")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, table = _Sets(k), bits.value
        for batch in rows:
            place = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.flatnonzero(table[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1))
            batch = batch.take(pa.array(keep))
            made = [sets.of(t) for t in binaries(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets.key(s) for s in made], pa.int64()), pa.array([_signed(s) for s in made], pa.list_(pa.int64()))], ["doc_id", "id", "shingles"])

    made = docs.select("doc_id", "text", place).mapInArrow(run, "doc_id long, id long, shingles array<long>")
    # Rows that share an id may hold other texts: the set's own key decides; of equal ones, one row stays.
    # The join has dealt the rows by both columns already.
    rest = ["shingles", *(c for c in wanted.columns if c not in ("doc_id", "id"))]
    return made.join(wanted, ["doc_id", "id"]).groupBy("doc_id", "id").agg(*(F.any_value(c).alias(c) for c in rest)).select("id", *rest)


def _led(sets: DataFrame) -> DataFrame:
    """``a, b, size_a, size_b, common, extra, lost``: what each set ``b`` adds to its leader ``a`` and what it lacks.

    ``sets`` are ``id, shingles, leads, leader, size_a, size_b``; a set is sent on as one or the other only.
    """
    b = sets.where("leader IS NOT NULL").select(F.col("leader").alias("a"), F.col("id").alias("b"), "size_a", "size_b", F.col("shingles").alias("_sb"))
    both = b.join(sets.where("leads").select(F.col("id").alias("a"), F.col("shingles").alias("_sa")), "a")
    both = both.withColumns({"extra": F.sort_array(F.array_except("_sb", "_sa")), "lost": F.sort_array(F.array_except("_sa", "_sb"))})
    return both.withColumn("common", F.col("size_b") - F.size("extra")).drop("_sa", "_sb")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with ``common``, the size of the intersection."""
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    return pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("_sa", "_sb"))).drop("_sa", "_sb")


def components(edges: DataFrame, most: int = 60, stored: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``node, root`` of ``edges(a, b)`` over numbers: the least node that each one reaches.

    Large-star and small-star steps in turn, each by aggregation and join, until nothing moves.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most):
        around = both(state)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        state = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _block(long: Column) -> Column:
    """The block of an entry in its list, by group, size, what is left and what is off; a short list is one block."""
    step = lambda c, k: F.floor(F.log2(F.greatest(F.col(c), F.lit(0)) + 1) * k).cast("int")
    none = F.lit(0)
    whole = F.struct(F.lit(0).cast("long").alias("g"), none.alias("s"), none.alias("r"), none.alias("o"))
    cut = F.struct(F.col("own").alias("g"), step("size", 16).alias("s"), step("left", 16).alias("r"), step("off", 8).alias("o"))
    return F.when(long, cut).otherwise(whole)


def met(entries: DataFrame, percent: int, apart: bool, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b, size_a, size_b``: the pairs that share an entry and can still reach the threshold.

    Entries are ``key, id, size, left, off, base, own, grp, root, first, second``: of a pair, one set's entry is ``first``,
    the other's ``second``. Two sets of a list can share at most ``left`` (the lesser one) of what stands from here on,
    and need what links their sizes, plus both ``off``, less ``base``. Whole blocks that can't, by their own bounds, are
    skipped before any entry is paired. ``apart``: only sets of two groups are paired; two sets of one component never
    are.
    """
    size, left = F.min("size"), F.min("left")
    # Of a list of two, the one pair is decided here.
    open_ = (F.max("size") * percent <= size * 100) & (left >= _needed(size, F.max("size"), percent) - F.first("base") + F.sum("off"))
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), open_.alias("open"))
    lists = lists.where("low <> high AND (n > 2 OR open)").select("key", (F.col("n") > SHORT_LIST).alias("long"))
    cut = stored(entries.join(lists, "key").withColumn("blk", _block(F.col("long"))).drop("long", "own"))

    def side(name: str, flag: str) -> tuple[DataFrame, DataFrame]:
        about = cut.where(flag).groupBy("key", "blk").agg(
            F.min("size").alias("least"), F.max("size").alias("most"), F.max("left").alias("left"), F.min("off").alias("off"), F.first("base").alias("base"),
            F.min("root").alias("low"), F.max("root").alias("high"), F.min("grp").alias("from"), F.max("grp").alias("to"),
        )
        renamed = lambda t: t.select("key", *(F.col(c).alias(f"{c}_{name}") for c in t.columns if c != "key"))
        return renamed(cut.where(flag).drop("first", "second")), renamed(about)

    (ex, bx), (ey, by) = side("x", "first"), side("y", "second")
    same = lambda low, high: (F.col(f"{low}_x") == F.col(f"{high}_x")) & (F.col(f"{low}_y") == F.col(f"{high}_y")) & (F.col(f"{low}_x") == F.col(f"{low}_y"))
    skip = same("low", "high") | (same("from", "to") if apart else F.lit(False))
    near = (F.col("most_x") * 100 >= F.col("least_y") * percent) & (F.col("most_y") * 100 >= F.col("least_x") * percent)
    can = F.least("left_x", "left_y") >= _needed(F.col("least_x"), F.col("least_y"), percent) - F.col("base_x") + F.col("off_x") + F.col("off_y")
    blocks = bx.join(by, "key").where(~skip & near & can).select("key", "blk_x", "blk_y")
    can = F.least("left_x", "left_y") >= _needed(F.col("size_x"), F.col("size_y"), percent) - F.col("base_x") + F.col("off_x") + F.col("off_y")
    if apart:  # each set is first and second
        blocks = blocks.where("blk_x <= blk_y")
        can = can & (F.col("grp_x") != F.col("grp_y")) & ((F.col("blk_x") != F.col("blk_y")) | (F.col("id_x") < F.col("id_y")))
    pairs = ex.join(blocks, ["key", "blk_x"]).join(ey, ["key", "blk_y"]).where((F.col("id_x") != F.col("id_y")) & (F.col("root_x") != F.col("root_y")) & can)
    turned = F.col("id_x") > F.col("id_y")
    one = lambda c: (F.when(turned, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")), F.when(turned, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")))
    (a, b), (na, nb) = one("id"), one("size")
    return pairs.select(a.alias("a"), b.alias("b"), na.alias("size_a"), nb.alias("size_b")).distinct()


def _derived(starred: DataFrame, name: DataFrame, percent: int, stored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: the links between sets of one leader in two components, from how each differs from the leader.

    With leader l, a set is l without ``lost`` and with ``extra``, so overlap(a, b) is |l| - |lost_a| - |lost_b| and
    what the two have in common of their differences. One of the two doesn't link with l (else they were in one
    component): their sizes alone then ask for some common differences, and the rare ones of both are indexed.
    """
    need = _needed(F.col("size_a"), F.col("size_b"), percent)
    rows = starred.withColumn("loose", F.col("common") < need).withColumn("all", F.size("extra") + F.size("lost"))
    groups = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("loose").alias("any")).where("n > 1 AND any").select("a")
    rows = stored(rows.join(groups, "a").join(name.select(F.col("id").alias("b"), "root"), "b"))
    # The longest start of the differences that must hold a common one: added shingles first, then lost ones.
    part = F.lit(percent / (100.0 + percent))
    second = F.least(F.col("all"), F.size("extra") + F.ceil(part * F.greatest(F.col("size_a") - F.col("size_b"), F.lit(0))).cast("int"))
    first = F.when(F.col("loose"), F.col("all") - (need - F.col("common")) + 1).otherwise(0)
    marked = F.concat(F.transform("extra", lambda v: F.xxhash64("a", F.lit(1), v)), F.transform("lost", lambda v: F.xxhash64("a", F.lit(2), v)))
    t = rows.select("a", "b", "size_a", "size_b", "root", F.size("lost").alias("off"), "all", first.alias("n1"), second.alias("n2"), F.posexplode(F.slice(marked, F.lit(1), F.greatest(first, second))).alias("at", "key"))
    t = t.select(
        "key", F.col("b").alias("id"), F.col("size_b").alias("size"), (F.col("all") - F.col("at")).alias("left"), "off", F.col("size_a").alias("base"), F.lit(0).cast("long").alias("own"), F.col("a").alias("grp"), "root",
        (F.col("at") < F.col("n1")).alias("first"), (F.col("at") < F.col("n2")).alias("second"),
    )
    pairs = met(stored(t), percent, False, stored)
    one, other = (rows.select(F.col("b").alias(c), F.col("a").alias(f"leader_{c}"), F.col("size_a").alias(f"n_{c}"), F.col("extra").alias(f"extra_{c}"), F.col("lost").alias(f"lost_{c}")) for c in "ab")
    pairs = pairs.join(one, "a").join(other, "b").where("leader_a = leader_b")
    common = F.col("n_a") - F.size("lost_a") - F.size("lost_b") + F.size(F.array_intersect("lost_a", "lost_b")) + F.size(F.array_intersect("extra_a", "extra_b"))
    return pairs.where(common >= need).select("a", "b")


def linked_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, stored: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """``doc_id, id, size`` of each row, and ``id, component_id`` of each set that links with another set; ``stored`` keeps what is read again."""
    about = stored(described(docs, k))
    rows = about.where("kind = 0").select(F.col("key").alias("doc_id"), F.col("a").alias("id"), F.col("b").alias("size"), "bits")
    total = rows.agg(F.sum("size")).first()[0] or 0
    floor = max(FREQUENT_LEAST, -(-total // FREQUENT_PART))
    often = about.where("kind = 1").groupBy("key").agg(F.sum("a").alias("n")).where(F.col("n") >= floor)
    frequent = often.orderBy("n", "key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)  # FREQUENT_PART rows at most

    # Lists with one set alone are dropped. Entries are dealt once, by shingle, for the count and for the join; a set
    # that several tasks have met is one entry.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = entries(docs, k, percent, frequent).repartition(n, "shingle")
    # The whole entry is compared, so that both uses ask for the same columns and share the exchange.
    ends = index.groupBy("shingle").agg(F.min(F.struct("id", "size", "at")).alias("low"), F.max(F.struct("id", "size", "at")).alias("high"))
    lists = ends.where("low.id <> high.id").select("shingle")
    index = stored(index.join(lists, "shingle").distinct())

    # In each list the other sets meet the one that stands nearest its own start; of those that a set meets and may be
    # like, the one that most sets meet is its leader.
    first = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.any_value("bits").alias("bits"))
    wanted = stored(index.select("id").distinct().join(first, "id"))
    known = wanted.select(F.col("id").alias("node"), F.col("doc_id").alias("name"))
    bits = lambda c: wanted.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"))
    most = _most("bits_a", "bits_b", "size_a", "size_b")
    heads = index.groupBy("shingle").agg(F.min(F.struct("at", "size", "id")).alias("head"))
    hub = F.col("head")
    near = F.least(hub["size"] - hub["at"], F.col("size") - F.col("at")) >= _needed(hub["size"], F.col("size"), percent)
    seen = index.join(heads, "shingle").where((F.col("id") != hub["id"]) & near).select(F.col("id").alias("b"), hub["id"].alias("a"), F.col("size").alias("size_b"), hub["size"].alias("size_a"))
    seen = seen.distinct().join(bits("a"), "a").join(bits("b"), "b").where(most * 100 >= F.greatest("size_a", "size_b") * LED_PERCENT)
    seen = stored(seen.select("a", "b", "size_a", "size_b", most.alias("most"), _needed(F.col("size_a"), F.col("size_b"), percent).alias("needed")))
    known_by = seen.groupBy("a").agg(F.count(F.lit(1)).alias("sets"))
    leaders = seen.join(known_by, "a").groupBy("b").agg(F.max_by(F.struct("a", "size_a", "size_b", "sets"), F.struct("sets", "a")).alias("l"))
    leaders = stored(leaders.select("l.a", "b", "l.size_a", "l.size_b", "l.sets"))
    # A set is compared with its leader, and with the other heads that it has met where their bitmaps leave a link open.
    others = stored(seen.join(leaders, ["a", "b"], "left_anti").where("most >= needed").drop("most", "needed"))
    flagged = lambda t, c, leads, asked: t.select(F.col(c).alias("id"), F.lit(leads).alias("leads"), F.lit(asked).alias("asked"))
    of = flagged(leaders, "a", True, False).union(flagged(leaders, "b", False, False)).union(flagged(others, "a", False, True)).union(flagged(others, "b", False, True))
    of = of.groupBy("id").agg(F.max("leads").alias("leads"), F.max("asked").alias("asked"))
    of = stored(of.join(wanted.drop("bits"), "id").join(leaders.drop("sets").withColumnRenamed("b", "id").withColumnRenamed("a", "leader"), "id", "left"))
    links = lambda p: F.col("common") >= _needed(F.col("size_a"), F.col("size_b"), percent)
    with workroom(docs.sparkSession) as briefly:
        sets = briefly(shingle_sets(docs, of, k))
        starred = stored(_led(sets))
        others = stored(overlaps(others, sets.where("asked")))
    edges = starred.where(links(starred)).select("a", "b").union(others.where(links(others)).select("a", "b"))
    state = stored(_named(edges, known))
    roots = components(state, stored=stored)

    # Between components: sets of one leader by their differences, the others by their lists' blocks.
    name = known.join(roots.withColumnRenamed("node", "name"), "name", "left").select(F.col("node").alias("id"), F.coalesce("root", "name").alias("root"))
    grouped = leaders.select(F.col("b").alias("id"), F.col("a").alias("grp"), "sets")
    name = stored(name.join(grouped, "id", "left").select("id", "root", F.coalesce("grp", "id").alias("grp"), F.when(F.col("sets") >= SHORT_LIST, F.col("grp")).otherwise(F.lit(0)).alias("own")))
    derived = stored(_derived(starred, name, percent, stored))
    zero, every = F.lit(0), F.lit(True)
    plain = index.join(name, "id").select(F.col("shingle").alias("key"), "id", "size", (F.col("size") - F.col("at")).alias("left"), zero.alias("off"), zero.alias("base"), "own", "grp", "root", every.alias("first"), every.alias("second"))
    pairs = met(plain, percent, True, stored)
    done = starred.select("a", "b").union(others.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.join(done, ["a", "b"], "left_anti").join(bits("a"), "a").join(bits("b"), "b")
    pairs = stored(pairs.where(most >= _needed(F.col("size_a"), F.col("size_b"), percent)).select("a", "b", "size_a", "size_b"))
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    with workroom(docs.sparkSession) as briefly:
        asked = stored(overlaps(pairs, briefly(shingle_sets(docs, stored(asked.join(wanted.drop("bits"), "id")), k))))
    more = derived.union(asked.where(links(asked)).select("a", "b"))
    roots = components(_named(more, known).union(state), stored=stored)
    return rows, known.join(roots.withColumnRenamed("node", "name"), "name").select(F.col("node").alias("id"), F.col("root").alias("component_id"))


def _named(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Links of sets as links of the least ``doc_id`` that has each."""
    a, b = known.select(F.col("node").alias("a"), F.col("name").alias("_a")), known.select(F.col("node").alias("b"), F.col("name").alias("_b"))
    return edges.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def joined(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``.

    Null texts and texts without words have the empty set: they link with nothing. Rows of equal sets link; repeated
    rows are alike. A null id takes part and never names a component unless it links with no known id. An empty
    table gives none; other columns are ignored.
    """
    with shuffled(docs.sparkSession), workroom(docs.sparkSession) as keep:
        rows, found = linked_sets(docs, k, percent, keep)
        own = rows.where("size > 0").groupBy("id").agg(F.min("doc_id").alias("own"))
        out = rows.join(own, "id", "left").join(found, "id", "left")
        component = F.when(F.col("size") > 0, F.coalesce("component_id", "own")).otherwise(F.col("doc_id"))
        return stored(out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id")))


def representatives(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: that of its least ``doc_id``; rows without words stay.

    Rows are told apart by their place in the files, not by ``doc_id``: ids may be null (the last ones) or repeat, and of
    equal rows the first in place stays. An empty table gives none; all columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    rows = placed(docs)
    found = joined(rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text")), k, percent).where("n_shingles > 0")
    with shuffled(spark):
        # Most rows are alone in their component.
        members = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
        several = found.join(members, "component_id").select(F.col("doc_id").alias("place"), "component_id")
        several = several.join(rows.select("place", F.col("row.doc_id").alias("id")), "place")
        first = several.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))["place"].alias("stays"))
        dropped = stored(several.join(first, "component_id").where("place <> stays").select("place"))
    return rows.join(dropped.hint("shuffle_hash"), "place", "left_anti").select("row.*")
