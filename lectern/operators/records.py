"""Records of a backup, told good from bad one by one: a backup that is good but for one row restores all but that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of record must hold. A text may not be empty, or not blank, where it says so.
RULES = {
    "docs": (("id", "text", "not empty"), ("title", "text", ""), ("source", "text", "not blank")),
    "sessions": (("docId", "text", ""), ("tokenIndex", "number", "")),
    "reviews": (("id", "text", ""), ("docId", "text", ""), ("prompt", "text", ""), ("dueAt", "number", "")),
    "exams": (("id", "text", "not empty"), ("at", "number", ""), ("correct", "number", ""), ("total", "number", ""), ("missed", "list", "")),
}

#: What Spark calls the types of JSON values.
TYPES = {"text": "^STRING$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "list": "^ARRAY"}


def _fault(value: Column, name: str, kind: str, need: str) -> Column:
    """What is wrong with one field, null if nothing."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    text = F.try_variant_get(value, f"$.{name}", "string")
    fault = F.when(field.isNull(), f"{name}: missing").when(~F.schema_of_variant(field).rlike(TYPES[kind]), f"{name}: no {kind}")
    if need:
        fault = fault.when((text if need == "not empty" else F.regexp_replace(text, r"\s+", "")) == "", f"{name}: empty")
    return fault


def validated(records: DataFrame) -> DataFrame:
    """``records(kind, payload, ...)`` with ``reason``: what first makes a record bad, null of a good one.

    A payload that is no JSON, or no object, is bad, and so is a record of a kind that is not known. Fields that no rule
    names don't matter.
    """
    value = F.try_parse_json("payload")
    shape = F.when(F.col("payload").isNull() | value.isNull(), "no JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "no object")
    by_kind = F.lit("kind not known")
    for kind, rules in RULES.items():
        by_kind = F.when(F.col("kind") == kind, F.coalesce(*(_fault(value, *rule) for rule in rules))).otherwise(by_kind)
    return records.withColumn("reason", F.coalesce(shape, by_kind))


def counted(records: DataFrame) -> DataFrame:
    """``kind, reason, n`` of ``validated`` records; the good ones' reason is ``good``."""
    return records.groupBy("kind", F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
