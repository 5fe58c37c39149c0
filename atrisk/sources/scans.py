"""Scans of landed files: JSON pages, delimited text under a banner, gazetteer lines, map elements.

Files are read by Spark in splits; the order of lines is that of the split (its start in the
file, then the line in it), so nothing is gathered to number them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atrisk.functions.norm import folded
from atrisk.operators.landed import column_key, position_of
from atrisk.operators.shared import written

#: A delimited file's header is among so many lines of its start.
BANNER_LINES = 8
# Feature codes of places, best first.
PLACE_CODES = ["ADM3", "PPLC", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPL"]
ELEMENTS = "elements array<struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>, geometry array<struct<lat double, lon double>>>>"


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``file, at, text``: every line of the files under ``path``; ``at`` (start of the split,
    line in it) orders the lines of one file. Two scans of one call's result agree on it, as
    both have the same list of files and splits."""
    raw = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), text.alias("text"))


def cells(text: Column, sep: str) -> Column:
    """A line's cells: quotes around a cell are taken off, doubled ones inside are one; a quote
    that is never closed stays in its cell."""
    s = re.escape(sep)
    found = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(f'{s}("(?:[^"]++|"")*+"[^{s}]*+|[^{s}]*+)'), F.lit(1))
    bare = lambda c: F.replace(F.regexp_replace(c, '(?s)^"((?:[^"]++|"")*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(c.startswith('"') & c.rlike('^"(?:[^"]++|"")*+"'), bare(c)).otherwise(c))


def delimited(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]], *, mark: str, sep: str = ";", encoding: str = "ISO-8859-1", part: str = r"([^/]+?)\.[^/.]*$") -> tuple[DataFrame, DataFrame]:
    """Rows of delimited files below their headers, and a report of the files.

    A file's header is the first of its first lines that holds ``mark`` and the separator; what
    stands above it is a banner. Columns are found by name in each file (``landed.position_of``),
    so files may order them differently. Rows have ``file, part`` (what the pattern ``part``
    takes from the file's path), ``at``, the fields as text (null where empty or absent) and
    ``irregular`` (another number of cells than the header). The report has one row a file:
    ``file, has_header, rows, irregular``; a file without header gives no rows, empty lines are
    none. One record is one line.
    """
    all_lines = lines(spark, path, encoding)
    first = all_lines.filter("at.start = 0").groupBy("file").agg(F.min("at.line").alias("first"), F.min(F.when(F.col("text").contains(mark) & F.col("text").contains(sep), F.struct("at", "text"))).alias("h"))
    near = F.col("h.at.line") - F.col("first") < BANNER_LINES
    head = first.select("file", F.when(near, F.struct(F.col("h.at").alias("at"), cells(F.col("h.text"), sep).alias("names"))).alias("h"))
    keys = F.transform("h.names", lambda c: F.coalesce(column_key(c), F.lit("")))
    known = head.filter("h is not null").select("file", F.col("h.at").alias("h_at"), F.size("h.names").alias("width"), keys.alias("names"))
    placed = known.select("file", "h_at", "width", *(position_of(F.col("names"), *c).alias(f"at_{f}") for f, c in fields.items()))
    body = all_lines.filter(F.trim("text") != "").join(placed, "file").filter(F.col("at") > F.col("h_at")).withColumn("c", cells(F.col("text"), sep))
    clean = lambda f: F.nullif(F.trim(F.get("c", F.col(f"at_{f}"))), F.lit("")).alias(f)
    name = F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    rows = body.select("file", F.regexp_extract(name, part, 1).alias("part"), "at", *(clean(f) for f in fields), (F.size("c") != F.col("width")).alias("irregular"))
    counts = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("irregular").alias("irregular"))
    none = F.lit(0).cast("long")
    report = head.select("file", F.col("h").isNotNull().alias("has_header")).join(counts, "file", "left").select("file", "has_header", F.coalesce("rows", none).alias("rows"), F.coalesce("irregular", none).alias("irregular"))
    return rows, report


def json_pages(spark: SparkSession, path: str, schema: str, key: str, *, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of a portal's pages, one file a page, and what couldn't be read.

    Pages may overlap: of rows with one ``key`` that of the first page (by file name) stays, by
    partial aggregation. Rows without a key all stay. The second result has ``file, text`` of
    unreadable lines (of whole files with ``multi_line``). Pages are parsed once and written.
    """
    read = spark.read.schema(f"{schema}, _unread string").option("columnNameOfCorruptRecord", "_unread").option("multiLine", multi_line).json(path)
    names = T.StructType.fromDDL(schema).names  # folders named by a value add no column
    rows = written(read.select(*names, "_unread", F.col("_metadata.file_path").alias("_page")), "pages")
    rest = [c for c in names if c != key]
    good = rows.filter("_unread is null")
    one = good.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest, "_page"), "_page").alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*names)
    bad = rows.filter("_unread is not null").select(F.col("_page").alias("file"), F.col("_unread").alias("text"))
    return one.unionByName(good.filter(F.col(key).isNull()).select(*names)), bad


def gazetteer_lines(spark: SparkSession, path: str) -> DataFrame:
    """``name, lon, lat`` of a gazetteer's tab-separated lines without quoting.

    Columns: 1 and 2 name and plain name, 3 alternates by commas, 4 and 5 latitude and
    longitude, 7 the feature code. Each folded name of three or more letters gets the point of
    its best code, the first line of them on a tie; short lines, other codes and unreadable
    coordinates are left out.
    """
    parts = lines(spark, path).select("file", "at", F.split("text", "\t").alias("c")).filter(F.size("c") >= 15)
    rank = F.array_position(F.array(*map(F.lit, PLACE_CODES)), F.get("c", F.lit(7)))
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    names = F.concat(F.slice("c", 2, 2), F.split(F.get("c", F.lit(3)), ","))
    each = parts.select(F.explode(F.array_distinct(F.transform(names, folded))).alias("name"), number(5).alias("lon"), number(4).alias("lat"), rank.alias("rank"), "file", "at")
    kept = each.filter((F.col("rank") > 0) & F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.length("name") >= 3))
    return kept.groupBy("name").agg(F.min_by(F.struct("lon", "lat"), F.struct("rank", "file", "at")).alias("p")).select("name", "p.lon", "p.lat")


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map extracts, each a JSON document of its own file: ``kind, id, position,
    geometry`` (array of x, y; null without one), ``lon, lat`` (own or of the centre), ``tags``;
    what ``landed.elements`` takes. An unreadable file gives no rows."""
    docs = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("elements").alias("i", "e"))
    points = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return docs.select(F.col("e.type").alias("kind"), F.col("e.id").alias("id"), F.struct("file", "i").alias("position"), points.alias("geometry"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.col("e.tags").alias("tags"))
