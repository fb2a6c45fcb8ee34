"""Interaction of document filters: what each of them removes in every order of applying them.

A document's failures are a mask of bits. Documents are counted by part and mask; one part's 32 counts are all that the
walk needs. It visits every subset of filters in Gray-code order, so that one filter is switched at a time: each mask
cell's counter of active failures moves by one, and the running survivors change only by the cells whose counter leaves
or reaches zero. The survivors of the 32 subsets are stored; a step of any order is the difference of two of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shuffled, stored, workroom

#: The filters; filter k is bit k of a mask.
FILTERS = "ABCDE"

#: A document fails A under so many words, B under so many distinct ones in 100, C over so many capitals in 100 characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5

#: A document fails D if it holds any of these.
MARKS = "[#$%&*|]"

#: What is counted of the documents of a cell: all, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")

COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> Column:
    """The bits A to D of a text."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\u000b\f\r", " " * 5), " "), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (F.size(words) < MIN_WORDS, distinct * 100 < F.size(words) * MIN_DISTINCT, capitals * 100 > F.length(text) * MAX_CAPITALS, text.rlike(MARKS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good ones and toxic ones of each part and mask of failures.

    A null text is empty, a null part the empty string. A document without labels is neither good nor toxic; of
    several rows of labels one suffices. Repeated rows are documents each: only those of a text's least ``doc_id``
    pass E. A null ``doc_id`` is neither smaller nor greater than any, so it passes E and has no labels. Texts are
    told apart by SHA-256. An empty table gives none; other columns may have any name.
    """
    with shuffled(docs.sparkSession), workroom(docs.sparkSession) as keep:
        rows = docs.select(docs["doc_id"], F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        facts = keep(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), text_failures(F.col("text")).cast("int").alias("mask")))
        # The rows of a hot text meet its least id by id, so that they are dealt evenly.
        least = facts.where("doc_id IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        known = labels.groupBy(labels["doc_id"]).agg(*(F.max((labels[c] == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
        found = facts.join(least, ["h", "doc_id"], "left").join(known, "doc_id", "left")
        copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
        mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
        counts = [F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTS[1:])]
        return stored(found.groupBy("part", mask.alias("mask")).agg(*counts))


def survivors(counts: np.ndarray) -> np.ndarray:
    """What survives each subset of filters: ``counts`` and the result are indexed by part, mask, kind of count."""
    size = counts.shape[1]
    masks, fails = np.arange(size), np.zeros(size, int)
    out, now = np.empty_like(counts), counts.sum(axis=1)
    active = 0
    out[:, 0] = now
    for turn in range(1, size):
        bit = turn & -turn
        touched = masks[(masks & bit) > 0]
        active ^= bit
        if active & bit:
            now = now - counts[:, touched[fails[touched] == 0]].sum(axis=1)
            fails[touched] += 1
        else:
            fails[touched] -= 1
            now = now + counts[:, touched[fails[touched] == 0]].sum(axis=1)
        out[:, active] = now
    return out


def steps(counts: np.ndarray, parts: Iterable[str], filters: str = FILTERS) -> pd.DataFrame:
    """A row for each part, order and step, from the counts by part, mask and kind."""
    parts, left = list(parts), survivors(counts)
    orders = list(itertools.permutations(range(len(filters))))
    path = np.array([list(itertools.accumulate((1 << k for k in o), initial=0)) for o in orders])
    before, after, which = path[:, :-1], path[:, 1:], np.array(orders)
    gone = left[:, before] - left[:, after]  # part, order, step, kind
    masks = np.arange(counts.shape[1])
    failing = np.stack([counts[:, (masks >> k & 1) > 0, 0].sum(axis=1) for k in range(len(filters))], axis=1)
    alone = counts[:, [1 << k for k in range(len(filters))], 0]
    shares = np.stack([(gone[..., 0] * (which == k)).sum(axis=(1, 2)) for k in range(len(filters))], axis=1)
    shape = gone.shape[:3]
    flat = lambda x: np.broadcast_to(x, shape).reshape(-1)
    return pd.DataFrame(
        {
            "part": np.repeat(np.array(parts, object), shape[1] * shape[2]),
            "filter_order": flat(np.array(["".join(filters[k] for k in o) for o in orders], object)[None, :, None]),
            "step": flat(np.arange(1, shape[2] + 1, dtype=np.int32)),
            "kept": flat(left[:, after, 0]),
            "removed": flat(gone[..., 0]),
            "redundant": flat(failing[:, which] - gone[..., 0]),
            "unique_fails": flat(alone[:, which]),
            "good_lost": flat(gone[..., 1]),
            "toxic_lost": flat(gone[..., 2]),
            "shapley": flat(shares[:, which]),
        }
    )


#: Parts of which a task holds the steps at once.
PARTS_AT_ONCE = 256


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, failing it only, and lost.

    ``shapley`` is what the step's filter removes, summed over all orders. Nulls, repeated rows, empty tables and
    clashing names are handled as ``cells`` says; a filter that no document fails gives zeros.
    """
    by_part = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # 32 at most

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.iloc[start : start + PARTS_AT_ONCE]
                counts = np.zeros((len(some), 1 << len(FILTERS), len(COUNTS)), np.int64)
                for i, found in enumerate(some["cells"]):
                    for cell in found:
                        counts[i, cell["mask"]] = [cell[c] for c in COUNTS]
                yield steps(counts, some["part"])

    return by_part.mapInPandas(walk, COLUMNS)
