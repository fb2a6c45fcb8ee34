"""Native column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619) % F.lit(4294967296))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def near_ms(ts: Column) -> Column:
    """Milliseconds since 1970, the nearest; halves go away from zero, as DuckDB's ``epoch_ms`` has it."""
    ms, us = F.unix_millis(ts.cast("timestamp")), F.unix_micros(ts.cast("timestamp"))
    return ms + (us - ms * 1000 >= F.when(us < 0, 501).otherwise(500)).cast("int")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)


def title_key(text: Column) -> Column:
    """Lower case, "and" for ampersands, no punctuation, no article."""
    t = F.regexp_replace(F.lower(text), "&", " and ")
    t = F.regexp_replace(t, "[‐-―-]+", " ")
    t = F.regexp_replace(t, "[^a-z0-9 ]+", " ")
    t = F.regexp_replace(t, r"\bthe\b", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def answer_key(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"[’']s\b", "")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9%. ]+", " "), " +", " ")
    return F.regexp_replace(F.trim(t), "s$", "")


def letters_key(text: Column) -> Column:
    """The letters of a text in lower case, nothing else."""
    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


def spelt(letters: Column) -> Column:
    """Letters in a common spelling, by fixed replacements: no pattern is needed."""
    t = letters
    for a, b in (("ph", "f"), ("ck", "k"), ("ce", "se"), ("ci", "si"), ("cy", "sy")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.replace(F.translate(t, "cqz", "kks"), F.lit("x"), F.lit("ks"))


def consonants(spelling: Column) -> Column:
    """A spelling without the vowels after its first letter, doubled sounds as one."""
    return F.regexp_replace(F.concat(F.substring(spelling, 1, 1), F.translate(F.substring(spelling, 2, 1 << 30), "aeiou", "")), r"(.)\1+", "$1")


def sound_key(text: Column) -> Column:
    """A word's consonants in a common spelling; a leading vowel stays, doubled sounds are one. The spellings are fixed values."""
    return consonants(spelt(letters_key(text)))


#: Inline marks and what stays of them, in this order.
INLINE = (
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"</?[a-zA-Z][^>]*>", ""),
    (r"`([^`]+)`", "$1"),
    (r"(\*\*\*|___)(.+?)\1", "$2"),
    (r"(\*\*|__)(.+?)\1", "$2"),
    (r"(\*|_)(?=\S)(.+?)(?<=\S)\1", "$2"),
    (r"~~(.+?)~~", "$1"),
    (r"\[\s*\d{1,3}(?:\s*[,;–—-]\s*\d{1,3})*\s*\]", ""),
    (r"(?<!(?:https?://|doi\.org|www\.)[\s\S]{0,36})(?<!/\S{0,39})([A-Za-z][.!?][\"'’”)\]]?)\d{1,3}(?:\s*[,;–—-]\s*\d{1,3})*(?![./\w])", "$1"),
    (r"([A-Za-z])[*†‡§¶‖]+", "$1"),
    (r"\s+([,.;:!?])", "$1"),
    (r"\\([\\`*_{}\[\]()#+\-.!])", "$1"),
    (r"\s+", " "),
)


def plain_inline(text: Column) -> Column:
    """Text without inline marks: images, links, tags, code, emphasis, marks of citations (not inside addresses), spaces before stops, escapes."""
    t = text
    for pattern, by in INLINE:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def duration(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    s = half_up(seconds % 60)
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m"))
    minutes = F.when(s > 0, F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))).otherwise(F.concat(m.cast("string"), F.lit("m")))
    return F.when(seconds <= 0, "0s").when(m == 0, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, minutes).otherwise(hours)


def pivot_letter(word: Column) -> Column:
    """The place of the letter that the eye fixes in a word: the first to fourth letter or digit, by their number."""
    n = F.length(F.regexp_replace(word, "[^A-Za-z0-9À-ɏ]", ""))
    at = F.when(n <= 1, 0).when(n <= 5, 1).when(n <= 9, 2).otherwise(3)
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    places = F.filter(F.transform(letters, lambda c, i: F.when(c.rlike("[A-Za-z0-9À-ɏ]"), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, at), F.lit(0))
