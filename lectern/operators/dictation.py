"""Dictated text put right by the vocabulary of the document that it is about.

A recogniser doesn't know a document's terms: it writes what it heard. Windows of one to four words meet the terms of
the same document by how they sound; the longest window that meets one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.expr import consonants, letters_key, sound_key, spelt

#: Words of a window at most; letters of a sound that tells something; how much shorter or longer than a term's form a window may be.
SPAN, LEAST_SOUND, SHORTER, LONGER = 4, 3, 0.6, 1.4

#: How each letter is written when it was spoken on its own.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "ay,bee,see,dee,ee,eff,gee,aitch,eye,jay,kay,el,em,en,oh,pee,cue,are,ess,tee,you,vee,double you,ex,why,zed".split(",")))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def spelled(term: Column) -> Column:
    """A term spoken letter by letter."""
    names = F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))
    letters = F.filter(F.split(F.regexp_replace(F.lower(term), "[^a-z]", ""), ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: F.element_at(names, c)), " ")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by scope in as many parts as shuffles have: their bytes are few, and would be put in few parts, for much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope")


def forms(vocabulary: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """``scope, way, key, term, lengths`` of ``vocabulary(scope, term)``: what each term is found by, written or by sound.

    A sound belongs to the longest term that has it, of equally long ones to the first in the alphabet; ``lengths`` are
    those of this term's forms with that sound. Of terms that differ in case only, the last in the alphabet is the
    written form. ``spoken(term, form)`` lists further ways of saying a term.
    """
    terms = _dealt(vocabulary.select("scope", "term").where("term <> ''")).distinct()
    said = terms.select("scope", "term", F.explode(F.array("term", spelled(F.col("term")))).alias("form"))
    if spoken is not None:
        said = said.unionByName(terms.join(spoken, "term").select("scope", "term", "form"))
    sounds = said.select("scope", "term", sound_key(F.col("form")).alias("key"), _letters(F.col("form")).alias("n")).where(F.length("key") >= LEAST_SOUND)
    sounds = sounds.groupBy("scope", "key", "term").agg(F.collect_set("n").alias("lengths"))
    best = F.min_by(F.struct("term", "lengths"), F.struct(-F.length("term"), F.col("term"))).alias("b")
    sounds = sounds.groupBy("scope", "key").agg(best).select("scope", F.lit("sound").alias("way"), "key", "b.term", "b.lengths")
    written = terms.groupBy("scope", F.lower("term").alias("key")).agg(F.max("term").alias("term"))
    return sounds.unionByName(written.select("scope", F.lit("written").alias("way"), "key", "term", F.array().cast("array<int>").alias("lengths")))


def reconciled(transcripts: DataFrame, vocabulary: DataFrame, spoken: DataFrame | None = None) -> DataFrame:
    """``id, text, corrections`` of ``transcripts(id, scope, text)``: the text put right, and each change as ``from`` and ``to``.

    White space becomes single spaces. A single word that is a term but for case is that term; otherwise windows of four
    words to one, without regard to stops, meet a term with the same sound and about the same size. From left to right,
    the longest window wins and its words are used up; a window that is already right is used up, but no change. Only
    the vocabulary of the transcript's own scope is looked at. Null texts are empty.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = _dealt(transcripts.select("id", "scope", "text")).select("id", "scope", words.alias("words"))
    # A window's sound is made of its words' letters, which are taken once; each step reads the one before it, and only windows that can meet a term become rows.
    own = F.transform("words", lambda w: F.struct(letters_key(w).alias("letters"), _letters(w).alias("size")))
    known = rows.join(vocabulary.select("scope").distinct(), "scope", "left_semi").withColumn("own", own)

    def window(i: Column, n: Column) -> Column:
        of = F.slice("own", i + 1, n)
        return F.struct(i.alias("i"), n.alias("n"), F.aggregate(of, F.lit(0), lambda s, x: s + x["size"]).alias("size"), spelt(F.array_join(F.transform(of, lambda x: x["letters"]), "")).alias("spelt"))

    spans = F.flatten(F.transform("own", lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SPAN), F.size("own") - i)), lambda n: window(i, n))))
    heard = F.transform(spans, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["size"].alias("size"), F.lit("sound").alias("way"), consonants(x["spelt"]).alias("key")))
    heard = F.filter(heard, lambda x: F.length(x["key"]) >= LEAST_SOUND)
    read = F.transform("words", lambda w, i: F.struct(i.alias("i"), F.lit(1).alias("n"), F.lit(0).alias("size"), F.lit("written").alias("way"), F.lower(w).alias("key")))
    windows = known.select("id", "scope", F.explode(F.concat(heard, F.filter(read, lambda x: x["key"].rlike("[a-z]")))).alias("w")).select("id", "scope", "w.*")
    met = windows.join(forms(vocabulary, spoken), ["scope", "way", "key"])
    met = met.where((F.col("way") == "written") | F.exists("lengths", lambda n: (F.col("size") >= n * SHORTER) & (F.col("size") <= n * LONGER)))
    best = F.max_by(F.struct("n", "term"), F.struct("n", "way")).alias("m")  # the longest; of one word, the written form
    found = met.groupBy("id", "i").agg(best).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "m.n", "m.term"))).alias("found"))

    def take(s: Column, x: Column) -> Column:
        return F.when(x["i"] >= s["free"], F.struct((x["i"] + x["n"]).alias("free"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)

    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<i:int,n:int,term:string>>").alias("taken"))
    out = rows.join(found, "id", "left").withColumn("taken", F.coalesce(F.aggregate("found", start, take, lambda s: s["taken"]), F.array().cast("array<struct<i:int,n:int,term:string>>")))
    # Each window's text stands for its words; what lies between two windows stays.
    taken, size_ = F.col("taken"), F.size("words")
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get(taken, k - 1)["i"] + F.get(taken, k - 1)["n"])
    kept = lambda k, until: F.slice("words", begin(k) + 1, F.greatest(until - begin(k), F.lit(0)))
    parts = F.concat(F.flatten(F.transform(taken, lambda x, k: F.concat(kept(k, x["i"]), F.array(x["term"])))), kept(F.size(taken), size_))
    said = F.transform(taken, lambda x: F.struct(F.array_join(F.slice("words", x["i"] + 1, x["n"]), " ").alias("from"), x["term"].alias("to")))
    changes = F.filter(said, lambda x: x["from"] != x["to"])
    return out.select("id", F.array_join(parts, " ").alias("text"), changes.alias("corrections"))
