"""Jobs over landed registries: roll-ups, headcounts, text keys, contacts and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.functions.norm import folded

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def emails(text: Column) -> Column:
    """The distinct e-mail addresses of a text in order of first occurrence, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower))


def classify(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The class of the first rule one of whose tokens the folded text holds as a word."""
    words, out = F.split(folded(text), " "), F.lit(otherwise)
    for tokens, name in reversed(rules):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, tokens))), name).otherwise(out)
    return out


def latest_edition(rows: DataFrame, edition: str) -> DataFrame:
    """The rows of the latest edition; its value is one row and broadcast."""
    return rows.join(F.broadcast(rows.agg(F.max(edition).alias(edition))), edition)


def holdings(heads: DataFrame, units: dict[str, float]) -> DataFrame:
    """Per holding: livestock units, the dominant species and whether several count.

    ``heads`` has ``holding, species, heads, active``; of a species' active rows the
    largest counts, as registries repeat them.
    """
    unit = F.coalesce(F.create_map(*(F.lit(x) for kv in units.items() for x in kv))[F.col("species")], F.lit(0.0))
    most = heads.filter("active").groupBy("holding", "species").agg(F.max("heads").alias("heads")).withColumn("units", F.col("heads") * unit)
    return most.groupBy("holding").agg(
        F.sum("units").alias("units"),
        F.max_by("species", F.struct("units", "species")).alias("dominant"),
        (F.count(F.when(F.col("units") > 0, 1)) > 1).alias("mixed"),
    )


def with_headcount(places: DataFrame, enrolments: DataFrame, key: str, staff: float = 0.12) -> DataFrame:
    """Adds students (summed before the join) and people, students and staff together."""
    sums = enrolments.groupBy(key).agg(F.sum("students").alias("students"))
    return places.join(sums, key, "left").withColumn("people", F.round(F.col("students") * (1 + staff)).cast("long"))
