"""Line dedup by the spread of a line over sites.

Each line hash carries a HyperLogLog sketch of its sites, merged by aggregation. Where the estimate is near the
threshold, the exact number of distinct sites decides. Of a line on enough sites, the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import placed, shuffled, stored, workroom

#: Distinct sites that make a line boilerplate; the sketches' log2 of registers.
MIN_SITES, LG_K = 5, 12

#: A line's occurrences are joined in so many parts, so that a common line is no single task's.
SALTS = 16

#: White space at a line's ends that does not tell lines apart.
EDGES = "\t\u000b\f\r "


def _margin(min_sites: int, lg_k: int) -> float:
    """Three standard errors of an estimate about the threshold, and 1 at least."""
    return max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)


def exploded(rows: DataFrame, site: str) -> DataFrame:
    """``place, doc_id, site, at, h1, h2, salt``: the place and the 96-bit hash of each line with a word of ``placed`` rows."""
    site_of = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{site}`").cast("string")), F.lit(""))
    lines = rows.select("place", F.col("row.doc_id").alias("doc_id"), F.xxhash64(site_of).alias("site"), F.posexplode(F.split(F.coalesce("row.text", F.lit("")), "\n")).alias("at", "line"))
    bare = F.btrim("line", F.lit(EDGES))
    lines = lines.withColumn("line", bare).where(F.col("line") != "")
    return lines.select("place", "doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), F.pmod(F.xxhash64("place", "at"), F.lit(SALTS)).cast("int").alias("salt"))


def _salted(found: DataFrame) -> DataFrame:
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated(lines: DataFrame, times: int) -> DataFrame:
    """The occurrences of lines that occur ``times`` times or more, on two sites at least: others can't be on so many sites."""
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    often = often.where((F.col("n") >= times) & ((F.col("low") != F.col("high")) | F.lit(times < 2))).select("h1", "h2")
    return lines.join(_salted(often), ["h1", "h2", "salt"], "left_semi")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``h1, h2, first``: the lines on ``min_sites`` sites or more, and where each occurs first."""
    place = F.struct("doc_id", "place", "at")
    margin = _margin(min_sites, lg_k)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sites"), F.min(place).alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("about")).where(F.col("about") >= min_sites - margin)
    near = spread.where(F.col("about") <= min_sites + margin).select("h1", "h2")
    exact = lines.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("one").alias("exact"))
    decided = spread.join(exact, ["h1", "h2"], "left")
    return decided.where(F.coalesce(F.col("exact") >= min_sites, F.lit(True))).select("h1", "h2", "first")


def deduplicated(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``row`` (the columns of ``docs``), ``dropped``, the places (from 0) of lines to remove, and ``cleaned``, the text without them.

    A line is what stands between newlines, without white space at its ends; lines without a word stay. A null site
    is a site of its own. The first occurrence is that of the least ``doc_id``, null ids first, and of rows that share
    an id the first in place. A null text stays null; an empty table gives none; other columns may have any name.
    Joins are by shuffle at all sizes: the texts are shuffled once.
    """
    rows = placed(docs)
    with shuffled(docs.sparkSession), workroom(docs.sparkSession) as keep:
        lines = keep(repeated(keep(exploded(rows, site)), min_sites))
        found = _salted(boilerplate(lines, min_sites, lg_k))
        hits = lines.join(found, ["h1", "h2", "salt"]).where(F.struct("doc_id", "place", "at") != F.col("first"))
        drops = stored(hits.groupBy("place").agg(F.sort_array(F.collect_list("at")).alias("dropped")))  # of one row's lines
    joined = rows.join(drops.hint("shuffle_hash"), "place", "left").select("row", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    left = F.filter(F.transform(F.split("row.text", "\n"), lambda x, i: F.when(~F.array_contains("dropped", i), x)), lambda x: x.isNotNull())
    return joined.withColumn("cleaned", F.when(F.size("dropped") > 0, F.array_join(left, "\n")).otherwise(F.col("row.text")))


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, n_chars, text_sha256`` of each row; of null texts the last is null."""
    out = deduplicated(docs, site, min_sites)
    return out.select(
        "row.doc_id",
        F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.coalesce(F.length("cleaned"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(F.col("cleaned").cast("binary"), 256).alias("text_sha256"),
    )


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without cross-site lines; rows that lost their last word to that go. ``n_chars`` follows the text.

    Nulls, repeated rows, ties, empty tables and clashing names are handled as ``deduplicated`` says.
    """
    out = deduplicated(docs, site, min_sites).where((F.size("dropped") == 0) | F.col("cleaned").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))
