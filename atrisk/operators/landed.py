"""Landed source tables: messy headers, contacts, map elements, census rows and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.functions import geom, grids
from atrisk.functions.norm import folded

#: A header row is looked for in so many first lines and has so many different names.
HEADER_LINES, HEADER_NAMES = 12, 5


def column_key(text: Column) -> Column:
    """A column name folded to letters and digits."""
    return F.regexp_replace(folded(text), "[^a-z0-9]", "")


def headers(rows: DataFrame) -> DataFrame:
    """``file, header_line, names`` (folded, by position) of files of ``file, line, cells``.

    The header is the first of a file's first lines with enough different names; a file
    without one is left out. By partial aggregation over those lines only.
    """
    names = F.array_distinct(F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: F.upper(F.trim(c))))
    top = rows.filter((F.col("line") < HEADER_LINES) & (F.size(names) >= HEADER_NAMES))
    first = top.groupBy("file").agg(F.min_by(F.struct("line", "cells"), "line").alias("h"))
    keys = F.transform("h.cells", lambda c: F.coalesce(column_key(c), F.lit("")))
    return first.select("file", F.col("h.line").alias("header_line"), keys.alias("names"))


def position_of(names: Column, *candidates: str) -> Column:
    """Position (from 0) of the first candidate that equals a folded name, else of the first
    that is part of one; null, never a guess, where none is."""
    keys = [k for k in ("".join(ch for ch in c.lower() if ch.isalnum()) for c in candidates) if k]
    whole = [F.nullif(F.array_position(names, k), F.lit(0)) for k in keys]

    def part(key: str) -> Column:
        return F.nullif(F.array_position(F.transform(names, lambda n: n.contains(key)), True), F.lit(0))

    holds = [part(k) for k in keys]
    return (F.coalesce(*whole, *holds) - 1).cast("int")


def messy_table(rows: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """``file, line`` and the wanted fields of the rows below each file's header, as text.
    Candidates are given without accents. One row per file meets the file's rows; the join
    leaves the choice of its strategy to the optimizer."""
    head = headers(rows).select("file", "header_line", *(position_of(F.col("names"), *c).alias(f"at_{f}") for f, c in fields.items()))
    body = rows.join(head, "file").filter("line > header_line")
    clean = lambda f: F.nullif(F.trim(F.get("cells", F.col(f"at_{f}"))), F.lit("")).alias(f)
    return body.select("file", "line", *(clean(f) for f in fields))


def phones(*values: Column) -> Column:
    """Distinct telephone numbers of several text columns, in order: lists are split, 00 is a
    plus, nine digits belong to the country +34, others of up to eleven keep their own code."""
    digits = F.transform(F.split(F.concat_ws(" ; ", *values), "[;,/|]| y | i "), lambda c: F.regexp_replace(c, r"[^\d+]", ""))
    core = F.transform(digits, lambda d: F.regexp_replace(F.regexp_replace(d, "^00", "+"), r"^\++", ""))
    core = F.transform(core, lambda d: F.when(d.startswith("34") & (F.length(d) == 11), F.substring(d, 3, 9)).otherwise(d))
    good = F.filter(core, lambda d: d.rlike(r"^\d{9,11}$"))
    return F.array_distinct(F.transform(good, lambda d: F.when(F.length(d) == 9, F.concat(F.lit("+34"), d)).otherwise(F.concat(F.lit("+"), d))))


def web_address(text: Column) -> Column:
    """An address with its scheme, put before it if missing; null if it has no host."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    full = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))
    return F.when(full.rlike(r"^https?://[\w.-]+\.\w{2,}"), full)


def elements(rows: DataFrame) -> DataFrame:
    """One row per map element (kind, id): the first with geometry, else the first, in order
    of ``position``; by partial aggregation, so that no element's copies are gathered."""
    rest = [c for c in rows.columns if c not in ("kind", "id")]
    has = F.col("geometry").isNotNull() & (F.size("geometry") > 0)
    return rows.groupBy("kind", "id").agg(F.min_by(F.struct(*rest), F.struct(~has, "position")).alias("e")).select("kind", "id", "e.*")


def feature_shape(points: Column) -> Column:
    """``shape, lon, lat, area_m2`` of an element's vertices (array of x, y).

    A closed run of four or more is a footprint with centroid and area, another run of two
    or more a line with the middle of its length; fewer give null. Moments are taken from
    the first vertex, for precision; a ring without area falls back to its vertex mean.
    """
    n, first = F.size(points), F.get(points, F.lit(0))
    at = F.transform(points, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    count = F.greatest(n - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(at, 1, count).alias("a"), F.slice(at, 2, count).alias("b"))

    def total(value):
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + value(p["a"], p["b"]))

    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    length = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    twice, metres = F.nullif(total(cross), F.lit(0.0)), F.nullif(total(length), F.lit(0.0))
    centre = {c: first[c] + F.coalesce(total(lambda a, b, c=c: (a[c] + b[c]) * cross(a, b)) / (3 * twice), total(lambda a, b, c=c: a[c]) / (n - 1)) for c in "xy"}
    middle = {c: first[c] + F.coalesce(total(lambda a, b, c=c: (a[c] + b[c]) / 2 * length(a, b)) / metres, F.lit(0.0)) for c in "xy"}
    area = F.abs(F.coalesce(twice, F.lit(0.0))) / 2 * F.cos(F.radians(centre["y"])) * F.lit(geom.DEG_LAT_M**2)
    last = F.get(points, n - 1)
    closed = (n >= 4) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    ring = F.struct(F.lit("footprint").alias("shape"), centre["x"].alias("lon"), centre["y"].alias("lat"), area.alias("area_m2"))
    line = F.struct(F.lit("line").alias("shape"), middle["x"].alias("lon"), middle["y"].alias("lat"), F.lit(None).cast("double").alias("area_m2"))
    return F.when(closed, ring).when(n >= 2, line)


def census_rows(rows: DataFrame, country: str) -> DataFrame:
    """A country's inhabited grid cells with their corner; unreadable names are left out."""
    inside = rows.filter((F.col("country") == country) & (F.col("population") > 0))
    placed = inside.select(*rows.columns, *(c.alias(n) for n, c in grids.corner(F.col("name")).items()))
    return placed.filter(F.col("easting").isNotNull() & F.col("northing").isNotNull())


def warnings(facts: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``position, code, message``: of named tests (condition, message) over a row of facts
    those that hold, in order; an unknown condition warns of nothing."""
    each = [F.when(test, F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), message.alias("message"))) for i, (code, (test, message)) in enumerate(tests.items())]
    return facts.select(F.inline(F.array_compact(F.array(*each))))
