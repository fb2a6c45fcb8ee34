"""Names and acronyms in documents: mentions, each document's index, the corpus index, what tells a section.

A name is a run of capitalised words inside a sentence, held together by at most two words in lower case such as "of".
All five operators stand on ``mentions``; words are numbered within their document, so islands of words are found by
windows over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import slug

#: Occurrences that a name needs in a document; words of a name; entries, and sections of an entry, that a document's index lists.
LEAST, LONGEST, ENTRIES, SECTIONS = 2, 8, 600, 12

#: Documents of an entity up to which ``entity_filter`` and ``dq_entities`` list them, as their SQL does; ``entity_corpus`` lists all.
LISTED = 1000

#: A run of an entity's list: documents of one count whose numbers are equal but for so many bits.
RUN_BITS = 12

#: Anchors of a section.
ANCHORS = 3

#: Words in lower case inside a name, and how many in a row.
CONNECTORS = ("of", "and", "for", "the", "to", "in", "on", "with", "at", "a", "an", "de")
MOST_CONNECTORS = 2

#: Capitalised words that name nothing.
NOT_NAMES = tuple(
    "the this that these those there then when where while which what who whom whose each every any all some both for from with without however therefore because although though since after before "
    "during under over into onto such they their them its his her our your and but not may must should would could will shall can has have had was were are been being note example see also "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "section figure table chapter appendix page part step box annex version use".split()
)

#: Fixed value: a word's shell and what is inside.
SHELL = r"^([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)$"

#: A word that may begin or go on a name, as a pattern; of its sentence, that one stands after the first word.
NAMING, NAMED = r"[A-Z]|^[^A-Za-z0-9]*(?:" + "|".join(CONNECTORS) + r")[^A-Za-z0-9]*$", " [^ ]*[A-Z]"

#: Kinds of blocks that name nothing.
UNNAMED = ("code",)


def located(tokens: DataFrame, sections: DataFrame) -> DataFrame:
    """Tagged ``tokens`` with the ``section`` that their block belongs to, and whether it is ``furniture``."""
    of = sections.select("doc_id", "section", "furniture", F.explode(F.sequence("block_from", F.col("block_to") - 1)).alias("block"))
    return tokens.join(of, ["doc_id", "block"])


def placed(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``blocks`` with their ``section`` and ``furniture``, looked up by number in one row a document: with both sides dealt by document, nothing is shuffled.

    A block's number stands for its place, as blocks are numbered from 0 and sections follow each other.
    """
    runs = F.transform(
        F.sort_array(F.collect_list(F.struct("section", "block_from", "block_to", "furniture"))),
        lambda x: F.array_repeat(F.struct(x["section"].alias("section"), x["furniture"].alias("furniture")), (x["block_to"] - x["block_from"]).cast("int")),
    )
    of = sections.groupBy("doc_id").agg(F.flatten(runs).alias("_of"))
    return blocks.join(of, "doc_id").withColumn("_at", F.get("_of", F.col("block").cast("int"))).select(*blocks.columns, "_at.section", "_at.furniture")


def _readable() -> Column:
    return ~F.col("furniture") & ~F.col("kind").isin(*UNNAMED)


def _runs(pieces: Column, longest: int) -> Column:
    """An island's names: pieces go on one name while it stays within the longest, then the next name starts with the bare word."""

    def step(runs: Column, p: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        more = F.concat(last["words"], p["words"])
        alone = F.struct(p["i"].alias("i"), p["section"].alias("section"), F.slice(p["words"], -1, 1).alias("words"))
        longer = F.struct(last["i"].alias("i"), last["section"].alias("section"), more.alias("words"))
        fits = (F.size(runs) > 0) & (F.size(more) <= longest)
        return F.when(fits, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(alone)))

    return F.aggregate(pieces, F.array().cast("array<struct<i:bigint,section:int,words:array<string>>>"), step)


def mentions(located: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """``doc_id, i, section, kind, key, display``: each mention of an acronym or a name, at the number of its first word; ``short``: the words that acronyms are taken from, if not all.

    A name ends at punctuation, an acronym, furniture, code, a word that names nothing, the first word of a sentence,
    and a third connector in a row; it has eight words at most. Connectors belong to it only if another word follows.
    """
    core, word = F.col("core"), F.col("word")
    named = (F.length(core) >= 2) & ~word.contains("[") & core.rlike("^[A-Z]") & core.rlike("[a-z]") & ~F.lower(core).isin(*NOT_NAMES)
    plain = _readable() & F.col("acronym").isNull()
    trail = F.regexp_extract("word", SHELL, 3)
    connects = ~named & (trail == "") & core.isin(*CONNECTORS)
    role = F.when(plain & named & (F.col("at") > 0), F.when(trail == "", "open").otherwise("closed")).when(plain & connects, "joins").otherwise("breaks")
    order = Window.partitionBy("doc_id").orderBy("i")
    back = [F.lag(F.struct("role", "core", "i"), k).over(order) for k in range(1, MOST_CONNECTORS + 2)]
    # Words that break a name are left out before the window: what is next to each other then must have neighbouring numbers.
    rows = located.where(core.rlike("^[A-Z]") | core.isin(*CONNECTORS)).withColumn("role", role).where(F.col("role") != "breaks").select("doc_id", "i", "section", "core", "role").withColumns({f"b{k}": b for k, b in enumerate(back)})
    is_name = F.col("role").isin("open", "closed")
    held = F.lit(None).cast("int")
    for k in range(MOST_CONNECTORS, -1, -1):  # the name before ends k connectors ago
        joined = (F.col(f"b{k}.role") == "open") & (F.col(f"b{k}.i") == F.col("i") - (k + 1))
        for j in range(k):
            joined &= F.col(f"b{j}.role") == "joins"
        held = F.when(joined, k).otherwise(held)
    rows = rows.withColumn("held", F.when(is_name, held)).withColumn("island", F.sum((is_name & F.col("held").isNull()).cast("int")).over(order))
    words = F.concat(*(F.when(F.col("held") > k, F.array(F.col(f"b{k}.core"))).otherwise(F.array().cast("array<string>")) for k in range(MOST_CONNECTORS - 1, -1, -1)), F.array("core"))
    pieces = F.sort_array(F.collect_list(F.struct("i", "section", "words")))
    runs = rows.where(is_name).withColumn("words", words).groupBy("doc_id", "island").agg(pieces.alias("pieces")).select("doc_id", F.explode(_runs(F.col("pieces"), LONGEST)).alias("r"))
    display = F.array_join("r.words", " ")
    names = runs.select("doc_id", "r.i", "r.section", F.lit("term").alias("kind"), slug(display).alias("key"), display.alias("display"))
    short = (short or located).where(_readable() & F.col("acronym").isNotNull()).select("doc_id", F.col("i").cast("long").alias("i"), F.col("section").cast("int").alias("section"), F.lit("acronym").alias("kind"), F.col("acronym").alias("key"), F.col("acronym").alias("display"))
    return names.unionByName(short)


def document_index(located: DataFrame, short: DataFrame | None = None, lower: DataFrame | None = None) -> DataFrame:
    """``doc_id, rank, key, display, kind, count, first, sections, truncated``: each document's names and acronyms, the commonest first.

    ``short`` and ``lower`` are the words that acronyms, and that rivals in lower case are taken from, if not all.

    Acronyms are listed however rare; a name from two mentions on, and one of a single word only if the document does
    not write it in lower case more often. ``sections`` are the first twelve; ``truncated`` tells how many entries the
    document has beyond the 600 that are listed. Of equal counts the lesser spelling comes first.
    """
    by = mentions(located, short).groupBy("doc_id", "key").agg(
        F.min_by("display", "i").alias("display"), F.min_by("kind", "i").alias("kind"), F.count(F.lit(1)).alias("count"), F.min("i").alias("first"), F.slice(F.sort_array(F.collect_set("section")), 1, SECTIONS).alias("sections")
    )
    common = (lower or located).where(_readable() & F.col("acronym").isNull() & F.col("core").rlike("^[a-z]{2,}$")).groupBy("doc_id", F.col("core").alias("lower")).agg(F.count(F.lit(1)).alias("uses"))
    rows = by.withColumn("lower", F.lower("display")).join(common, ["doc_id", "lower"], "left")
    earned = F.contains("display", F.lit(" ")) | (F.col("count") >= F.coalesce("uses", F.lit(0)))
    rows = rows.where((F.col("kind") == "acronym") | ((F.col("count") >= LEAST) & earned))
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.col("count").desc(), "display", "key"))).withColumn("held", F.count(F.lit(1)).over(whole))
    rows = rows.where(F.col("rank") <= ENTRIES)
    return rows.select("doc_id", "rank", "key", "display", "kind", "count", "first", "sections", F.greatest(F.col("held") - ENTRIES, F.lit(0)).cast("long").alias("truncated"))


def corpus_index(index: DataFrame, most: int | None = None) -> DataFrame:
    """``key, display, kind, docs, total, listed``: entities over all documents, spelled as the document that has most of them does.

    ``listed`` holds document, count, first word and number of sections of every document, the busiest first. With
    ``most``, it is null for an entity of more documents than that.
    """
    by = index.groupBy("key").agg(
        F.max_by("display", F.struct("count", -F.col("doc_id"))).alias("display"), F.min_by("kind", "doc_id").alias("kind"), F.count(F.lit(1)).alias("docs"), F.sum("count").alias("total")
    )
    rows = index if most is None else index.join(by.where(F.col("docs") <= most).select("key"), "key", "left_semi")
    one = F.struct((-F.col("count")).alias("order"), "doc_id", "count", "first", F.size("sections").alias("sections"))
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("x"))
    listed = listed.select("key", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["count"].alias("count"), x["first"].alias("first"), x["sections"].alias("sections"))).alias("listed"))
    return by.join(listed, "key", "left").select("key", "display", "kind", "docs", "total", "listed")


def corpus_text(index: DataFrame) -> DataFrame:
    """``corpus_index`` with ``listed`` as text, ``document:count:first:sections`` with commas between, of every document.

    A list is made of runs, which many tasks write; the task that has an entity strings its runs together, so it holds
    a common entity's list as text, not as rows.
    """
    one = F.struct("doc_id", "first", F.size("sections").alias("sections"))
    text = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat_ws(":", x["doc_id"], F.col("count"), x["first"], x["sections"])))
    runs = index.groupBy("key", "count", F.shiftright("doc_id", RUN_BITS).alias("run")).agg(
        F.min("doc_id").alias("at"), F.min_by("display", "doc_id").alias("display"), F.min_by("kind", "doc_id").alias("kind"), F.count(F.lit(1)).alias("n"), text.alias("text")
    )
    texts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("order"), "run", "text"))), lambda x: x["text"])
    return runs.groupBy("key").agg(
        F.max_by("display", F.struct("count", -F.col("at"))).alias("display"), F.min_by("kind", "at").alias("kind"), F.sum("n").alias("docs"), F.sum(F.col("count") * F.col("n")).alias("total"), F.concat_ws(",", texts).alias("listed")
    )


def filtered(corpus: DataFrame, acronyms: DataFrame, needle: str = "", shared: bool = False, kind: str | None = None) -> DataFrame:
    """Entities of at least two documents if ``shared``, of one kind, whose spelling or, for an acronym, expansion holds the needle."""
    rows = corpus.where((F.col("docs") >= (2 if shared else 0)) & (F.lit(kind is None) | (F.col("kind") == (kind or ""))))
    n = needle.strip().lower()
    if not n:
        return rows
    found = rows.join(F.broadcast(acronyms.select("key", F.lit("acronym").alias("kind"), "expansion")), ["key", "kind"], "left")  # a fixed small table
    hit = F.contains(F.lower("display"), F.lit(n)) | F.coalesce(F.contains(F.lower("expansion"), F.lit(n)), F.lit(False))
    return found.where(hit).select(*corpus.columns)


def anchors(located: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, section, place, label, kind``: three entities that tell a section: its acronyms, the commonest there first, then the document's names in the order of its index."""
    short = located.where("acronym IS NOT NULL").groupBy("doc_id", "section", F.col("acronym").alias("label")).agg((-F.count(F.lit(1))).alias("order")).withColumn("kind", F.lit("acronym"))
    long = index.where("kind = 'term'").select("doc_id", F.explode("sections").alias("section"), F.col("display").alias("label"), F.col("rank").cast("long").alias("order"), "kind")
    both = short.unionByName(long)
    same = Window.partitionBy("doc_id", "section", F.lower("label")).orderBy("kind", "order", "label")
    both = both.withColumn("k", F.when(F.col("kind") == "term", F.row_number().over(same)).otherwise(1)).where("k = 1")
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("kind", "order", "label"))
    return both.withColumn("place", place).where(F.col("place") <= ANCHORS).select("doc_id", "section", "place", "label", "kind")
