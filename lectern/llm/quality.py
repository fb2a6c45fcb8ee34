"""Quality rules, line first: a line that fails a rule goes; a document that loses too much text goes as a whole.

Native expressions only. Repeated three-word windows are found inside the row, by sorting the row's own window
hashes, so that no window is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document needs so many words, and of 100 words at most so many in repeated three-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50

#: Of 1000 characters of a line, so many runs of symbols, separators or exclamation marks make it fail.
MAX_RUNS = 40

#: A menu: so many separators or more, and of words at most so many for each of its labels.
MENU_SEPARATORS, MENU_WORDS = 2, 3

#: A line of so many characters without any sentence mark fails; so does a line of at most so many words that is cut short.
UNPUNCTUATED, TEASER_WORDS = 60, 12

#: Boilerplate phrases count in lines of up to so many characters.
BOILERPLATE_CHARS = 160

#: A line of so many words needs a function word, in texts where one of so many words is one.
LISTED_WORDS, FUNCTION_SHARE = 12, 20

#: A line of up to so many characters that repeats an earlier line of its text fails.
SHORT_LINE = 40

#: Of 100 characters of a document, the most that failing lines may hold.
MAX_LOST = 50

#: Phrases of lines that are no prose, by language.
BOILERPLATE = {
    "en": ("all rights reserved", "cookie policy", "enable javascript", "follow us on", "licensed under", "lorem ipsum", "privacy policy", "sign up for", "subscribe to our", "terms of service", "terms of use", "use of cookies"),
    "de": ("alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "folgen sie uns", "javascript aktivieren", "newsletter abonnieren", "nutzungsbedingungen", "verwendet cookies"),
    "fr": ("abonnez-vous", "activer javascript", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "suivez-nous", "tous droits réservés", "utilise des cookies"),
    "es": ("activar javascript", "aviso legal", "condiciones de uso", "política de privacidad", "suscríbete a", "síguenos en", "todos los derechos reservados", "utiliza cookies"),
}

#: Frequent function words, by language.
FUNCTION_WORDS = {
    "en": ("a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"),
    "de": ("auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"),
    "fr": ("au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "es": ("al", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_RUNS = r"[#*$%&|<>!\x{00BB}\x{2022}]+"
_SEPARATORS = rf"{_SPACE}([|/>\x{{00B7}}\x{{00BB}}\x{{2022}}\x{{203A}}\x{{2192}}]|::){_SPACE}"
_STOP = rf"[.!?\x{{2026}}\x{{3002}}][\"')\]\x{{201D}}\x{{2019}}]*{_SPACE}*$"
_CUT = rf"(\.\.\.|\x{{2026}}){_SPACE}*$"
_PHRASES = "(?iu)" + "|".join(p for ps in BOILERPLATE.values() for p in ps)
_FUNCTION = rf"(?i)(^|{_SPACE})(" + "|".join(sorted({w for ws in FUNCTION_WORDS.values() for w in ws})) + rf")([,.;:!?]|{_SPACE}|$)"


def _fails(line: Column, known: Column) -> Column:
    """Whether a line breaks a rule of symbols, menus, punctuation, boilerplate or lists; a blank line doesn't.

    ``known`` tells whether the text's function words are those of a language known here: only there a long line
    without any is a list.
    """
    n, words, separators = F.length(line), F.regexp_count(line, F.lit(_WORD)), F.regexp_count(line, F.lit(_SEPARATORS))
    symbols = F.regexp_count(line, F.lit(_RUNS)) * 1000 > n * MAX_RUNS
    menu = (separators >= MENU_SEPARATORS) & (words - separators <= (separators + 1) * MENU_WORDS) & ~line.rlike(_STOP)
    punctuation = ((n >= UNPUNCTUATED) & ~line.rlike(r"[.!?\x{2026}\x{3002}]")) | (line.rlike(_CUT) & (words <= TEASER_WORDS))
    boilerplate = (n <= BOILERPLATE_CHARS) & line.rlike(_PHRASES)
    listed = known & ~line.rlike(_FUNCTION) & (words >= LISTED_WORDS)
    return line.rlike(r"[^\x20\x09-\x0D]") & (symbols | menu | punctuation | boilerplate | listed)


def _short(line: Column) -> Column:
    """A short line's characters without the white space around them; null if it is long or blank."""
    bare = F.regexp_replace(line, rf"^{_SPACE}+|{_SPACE}+$", "")
    return F.when((F.length(bare) <= SHORT_LINE) & (bare != ""), bare)


#: Counts of ``measured``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_chars")


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of ``docs``, whatever their names) and the struct ``q`` of counts, verdicts and the cleaned text.

    A null or empty text has no words and is rejected. Equal lines are told by their characters; the first of equal
    lines is no repetition, and short ones that follow it go. Rows are judged each on their own: repeated rows alike; an empty table gives none.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # Each step's arrays are columns of their own, so that the next step's lambdas read them instead of building them.
    rows = rows.withColumns({"lines": F.split("text", "\n"), "words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")})
    rows = rows.withColumns({"h": F.transform("words", lambda w: F.xxhash64(w)), "chars": F.length(F.array_join("words", ""))})
    h = F.col("h")
    hashed = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))
    rows = rows.withColumns(
        {
            "windows": hashed,
            "n": F.size(h),
            "worded": F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "known": F.regexp_count("text", F.lit(_FUNCTION)) * FUNCTION_SHARE >= F.size(h),
            "shorts": F.transform("lines", _short),
        }
    )
    # Repeats of short lines are neighbours once sorted by their characters; sorted by place again, the first ones stay.
    named = F.filter("shorts", lambda x: x.isNotNull())
    sorted_lines = F.array_sort(F.transform("lines", lambda x, i: F.struct(F.get(F.col("shorts"), i).alias("short"), i.alias("i"), x.alias("line"))))
    rows = rows.withColumn("by_short", F.when(F.size(F.array_distinct(named)) < F.size(named), sorted_lines))
    by_short = F.col("by_short")
    told = F.array_sort(F.transform(by_short, lambda x, j: F.struct(x["i"].alias("i"), x["line"].alias("line"), (x["short"] == F.get(by_short, j - 1)["short"]).alias("again"))))
    firsts = F.transform(F.filter(told, lambda x: F.coalesce(~x["again"], F.lit(True))), lambda x: x["line"])
    rows = rows.withColumn("firsts", F.coalesce(firsts, F.col("lines")))
    rows = rows.withColumn("good", F.filter("firsts", lambda x: ~_fails(x, F.col("known"))))
    windows = F.col("windows")
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    by_hash = F.col("sorted")
    twice = F.filter(by_hash, lambda x, i: (x["w"] == F.get(by_hash, i - 1)["w"]) | (x["w"] == F.get(by_hash, i + 1)["w"]))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counts = {
        "n_words": F.col("n"),
        "word_chars": F.col("chars"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("worded") - F.size(F.array_distinct("worded")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lost_chars": F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)) - F.aggregate("good", F.lit(0), lambda a, x: a + F.length(x)),
    }
    rows = rows.withColumns({k: v.cast("long") for k, v in counts.items()})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    kept = ~failed & (F.col("n_lost_chars") * 100 <= F.length("text") * MAX_LOST)
    return rows.select("row", F.struct(*COUNTS, failed.alias("base_failed"), kept.alias("kept"), F.array_join("good", "\n").alias("cleaned")).alias("q"))


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of each row; other cases as ``measured`` says."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_chars"]
    return measured(docs.select("doc_id", "text")).select("row.doc_id", *(f"q.{n}" for n in names))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with their columns; ``text`` is without the lines that failed, ``n_chars`` its length.

    Null and empty texts go; repeated rows stay or go alike; an empty table gives none; columns may have any name.
    """
    # The partition's number keeps the optimizer from moving the filter, with all that it depends on, below the steps.
    kept = measured(docs).withColumn("part", F.spark_partition_id()).where(F.col("q.kept") & (F.col("part") >= 0))
    own = {"text": F.col("q.cleaned"), "n_chars": F.length("q.cleaned").cast("long")}
    return kept.select(*(own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns))
