"""Mixing sources to target weights as a curriculum over training time.

Each source's weight changes over training time. Its integral is the share of the source's words demanded so far;
a document's place among its source's words, put through the inverse of that integral, is its training position.
Native expressions only. Running sums are taken over hash buckets of a source first, then inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, placed, stored

#: Weights in the order of sources, repeating; how each source's weight leans to the end of training (-1 to 1).
WEIGHTS, LEANS = (5, 2, 1), (-0.5, 0.0, 0.5)

#: The most that a source, and so a document, is repeated.
MAX_EPOCHS = 3

#: Hash buckets of a source (log2), each summed on its own.
LG_BUCKETS = 10


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("double") for v in values)), ((place - 1) % len(values) + 1).cast("int"))


def sized(rows: DataFrame) -> DataFrame:
    """``place, doc_id, source, size`` of ``placed`` rows."""
    return rows.select("place", "row.doc_id", "row.source", F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target, lean`` of each source.

    Shares of all words by weight; no target above ``max_epochs`` times its source's size. With sources in the order
    of cap by weight, each prefix of capped ones leaves a level (words for one weight) to the rest; the highest is
    the level that resharing ends at. One row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = by_source.withColumn("place", place).withColumn("weight", _cycle(weights, F.col("place"))).withColumn("lean", _cycle(leans, F.col("place"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - capped) / open_weight
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"), "lean")


def demand_time(share: Column, lean: Column) -> Column:
    """When a source has been asked for a share of its words, if its weight is 1 + lean * (2 t - 1) at time t."""
    root = F.sqrt((1 - lean) * (1 - lean) + 4 * lean * share)
    return F.when(lean == 0, share).otherwise((root - (1 - lean)) / (2 * lean))


def mixture(rows: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """``place, doc_id, source, size, source_size, target, copies, taken, before, lean`` of each of ``placed`` rows.

    A source is taken whole as often as its target allows; the rest is its next documents in hash order, up to
    where half of the next would pass the target. Null texts have no words and are not taken; a null source is the
    last source; rows of one id are documents of their own, told apart by their place; an empty table gives none;
    other columns are ignored. Joins are by shuffle at all sizes, but for one row a source.
    """
    sizes = stored(sized(rows))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = sizes.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - LG_BUCKETS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = targets(sizes, weights, leans, max_epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    t, b = plan.alias("t"), buckets.alias("b")
    places = b.join(t.hint("merge"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "base", "source_size", "target", "lean")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    r, p = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r"), places.alias("p")
    joined = r.join(p.hint("merge"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    joined = joined.select("place", "doc_id", "r.source", "size", "source_size", "target", "lean", (F.col("base") + F.col("inner")).alias("before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    copies = F.when(F.col("size") > 0, F.least(F.col("epochs") + F.when(more, 1).otherwise(0), F.lit(max_epochs))).otherwise(0)
    return joined.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))


def position(epoch: Column) -> Column:
    """The training time (0 to 1) of a document's copy in a ``mixture``."""
    share = (epoch * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.greatest("target", F.lit(1.0))
    return demand_time(F.least(share, F.lit(1.0)), F.col("lean"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """The ``mixture`` of ``docs``, with the first training position, sorted by it; documents that are not taken are last.

    Nulls, rows of one id, ties and empty tables are handled as in ``mixture``; equal positions are ordered by id, null
    ids first, then by place.
    """
    m = mixture(placed(docs), **options)
    first = F.when(F.col("copies") > 0, position(F.lit(0)))
    out = m.select("place", "doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "place").drop("place")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, in training order; documents it does not take are absent.

    The order is that of the rows in the files they are written to, which ``placed`` gives back. Equal positions are
    ordered by id, place and copy; rows of one id keep their own copies; an empty table gives none; all columns are
    kept, whatever their names.
    """
    rows = placed(docs)
    m = mixture(rows, **options).where("copies > 0").select("place", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"), "source_size", "target", "lean", "before", "size")
    m = m.select("place", position(F.col("epoch")).alias("position"), "epoch")
    # A row is sent on once for all its copies, and sorted with what its order needs only.
    turns = m.groupBy("place").agg(F.collect_list(F.struct("position", "epoch")).alias("turns"))  # of one row: MAX_EPOCHS at most
    out = rows.join(turns.hint("shuffle_hash"), "place").select("row", "place", F.explode("turns").alias("turn"))
    return out.orderBy("turn.position", "row.doc_id", "place", "turn.epoch").select("row.*")
