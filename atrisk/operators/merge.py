"""Whole records of clusters: a primary whose gaps other records fill, with what each gave.

Every filled value is a fact of its own. Records are dealt out by cluster before their facts are
spelt out and sorted, a large cluster's in shares; a share is reduced where it lies, and what is
left of a cluster's shares meets in one task. There are as many tasks as ``ROWS`` asks for, so
that what one sorts in memory does not grow with the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The capacities that are filled, the most a merged record is trusted, and what each further record adds.
CAPACITIES = ["people", "beds", "students", "places", "animals", "livestock_units", "dwellings"]
MOST, EACH, UNKNOWN = 0.98, 0.06, 0.5
LISTS = ["phone", "email"]
#: Records of a task, and of a share of a large cluster.
ROWS, SHARE = 1 << 16, 1 << 12
#: Single fields by the name that provenance gives them.
SINGLE = {"contacts.website": "website", "contacts.operator": "operator", **{f"capacity.{c}": c for c in CAPACITIES}, "name": "name", "footprint_m2": "footprint_m2", "floors": "floors"}


def _order(priority: dict[str, int]) -> Column:
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col("source_id")], F.lit(0))
    return F.struct((-rank).alias("rank"), (-F.coalesce("confidence", F.lit(0.0))).alias("trust"), "doc_id")


def _facts(ranked: DataFrame) -> DataFrame:
    """``cluster, share, doc_id, source_id, at, field, slot, value, more``: what records have to
    give. Zero and empty single values are missing. ``slot`` tells the values of a list and the
    attributes apart, ``more`` goes along with a value (a footprint's kind, a capacity's basis).
    Every record gives the field '', of which the first is the primary's."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def fact(field, slot, value, more=none, i=F.lit(0)):
        return F.struct(i.alias("i"), field.alias("field"), slot.alias("slot"), value.alias("value"), more.alias("more"))

    def single(field, c):
        more = F.col("geometry_kind") if c == "footprint_m2" else F.col("basis") if c in CAPACITIES else none
        zero = F.col(c) == 0 if c in CAPACITIES or c in ("footprint_m2", "floors") else F.lit(False)
        return F.when(F.col(c).isNotNull() & (text(c) != "") & ~zero, fact(F.lit(field), F.lit(""), text(c), more))

    def listed(c):
        return F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v, i: fact(F.lit(f"contacts.{c}"), v, v, i=i))

    address = F.transform(F.filter(F.map_entries("address"), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: fact(F.concat(F.lit("address."), e["key"]), F.lit(""), e["value"]))
    attributes = F.transform(F.map_entries("attributes"), lambda e: fact(F.lit("attribute"), e["key"], e["value"]))
    given = F.array_compact(F.array(fact(F.lit(""), F.lit(""), none), *(single(f, c) for f, c in SINGLE.items())))
    empty = F.slice(given, 1, 0)
    rows = ranked.select("cluster", "share", "doc_id", "source_id", "order", F.explode(F.concat(given, *(F.coalesce(a, empty) for a in (*map(listed, LISTS), address, attributes)))).alias("f"))
    return rows.select("cluster", "share", "doc_id", "source_id", F.struct("order", "f.i").alias("at"), "f.field", "f.slot", "f.value", "f.more")


def _first(facts: DataFrame, tasks: int, *more: str) -> DataFrame:
    """The first fact of every ``cluster, field, slot``: in each share, then of the shares."""
    least = F.min_by(F.struct("at", "doc_id", *more), "at").alias("w")
    shares = facts.groupBy("cluster", "share", "field", "slot").agg(least).select("cluster", "field", "slot", "w.*")
    return shares.repartition(tasks, "cluster").groupBy("cluster", "field", "slot").agg(least).select("cluster", "field", "slot", "w.*")


def _shared(records: DataFrame, labels: DataFrame, tasks: int) -> DataFrame:
    """Records with ``cluster, share``."""
    members = labels.select("doc_id", "cluster")
    large = members.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > SHARE)  # at most one in SHARE records
    share = F.pmod(F.xxhash64("doc_id"), F.ceil(F.coalesce("n", F.lit(1)) / SHARE)).alias("share")
    members = members.join(F.broadcast(large), "cluster", "left").select("doc_id", "cluster", share)
    return records.repartition(tasks, "doc_id").join(members.repartition(tasks, "doc_id").hint("merge"), "doc_id")


def merged_records(records: DataFrame, labels: DataFrame, priority: dict[str, int], kept: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One record per cluster, and one row of provenance per record.

    The primary has the highest source priority, then confidence, then the smallest id. Phones
    and e-mails are appended, each once; single fields, capacities and parts of the address come
    from the first record that has them; an attribute whose name is taken is kept as
    ``source:name``, of several such the first. A capacity's basis is the primary's, else that of
    the first record which gave a capacity. Confidence grows with the records, up to ``MOST``.

    Records have ``doc_id, source_id, source_ref, name, category, lon, lat, confidence, phone``
    and ``email`` (arrays), ``website, operator``, the capacities, ``basis``, ``address`` and
    ``attributes`` (maps of texts), ``footprint_m2, geometry_kind, floors``; any may be null but the id and source.
    ``kept`` names further columns, which are the primary's.
    Provenance has ``cluster, doc_id, source_id, source_ref, fields``: identity and geometry for
    the primary, sorted names of what others gave, or corroboration.
    """
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // ROWS))
    shared = _shared(records, labels, tasks)
    ranked = shared.repartition(tasks, "cluster", "share").withColumn("order", _order(priority))
    own = F.struct("doc_id", "source_id", "source_ref", "category", "lon", "lat", "confidence", "basis", "geometry_kind", *kept)
    shares = ranked.groupBy("cluster", "share").agg(F.min_by(own, "order").alias("p"), F.min("order").alias("order"), F.count("*").alias("n"))
    primary = shares.repartition(tasks, "cluster").groupBy("cluster").agg(F.min_by("p", "order").alias("p"), F.sum("n").alias("merged_count"))
    facts = _facts(ranked)
    first = _first(facts.filter("field != ''"), tasks, "value", "more")
    plain = first.filter("field = 'attribute'")
    who = ["cluster", "slot", "doc_id"]
    others = facts.filter("field = 'attribute'").repartition(tasks, *who).join(plain.select(*who).repartition(tasks, *who).hint("merge"), who, "left_anti")
    spaced = others.select("cluster", "share", F.concat_ws(":", "source_id", "slot").alias("slot"), "at", "value").repartition(tasks, "cluster", "share")
    spaced = spaced.groupBy("cluster", "share", "slot").agg(F.min_by(F.struct("at", "value"), "at").alias("w")).select("cluster", "slot", "w.*")
    named = plain.select("cluster", "slot", "at", "value", F.lit(0).alias("late")).unionByName(spaced.withColumn("late", F.lit(1))).repartition(tasks, "cluster")
    attributes = named.groupBy("cluster", "slot").agg(F.min_by("value", F.struct("late", "at")).alias("value")).groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "value")), lambda a, b: F.when(a["slot"] < b["slot"], -1).when(a["slot"] > b["slot"], 1).otherwise(0))).alias("attributes"))

    won = lambda field, part="value": F.max(F.when(F.col("field") == field, F.col(part)))
    in_order = lambda field: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("at", "slot")))), lambda v: v["slot"])
    address = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").startswith("address."), F.struct(F.substring("field", 9, 1 << 20).alias("key"), "value")))))
    basis = F.min_by(F.struct("more"), F.when(F.col("field").startswith("capacity."), F.col("at")))["more"]
    numbers = {*CAPACITIES, "footprint_m2", "floors"}
    values = [(won(f).cast("double") if c in numbers else won(f)).alias(c) for f, c in SINGLE.items()]
    filled = first.filter("field != 'attribute'").groupBy("cluster").agg(*values, *(in_order(f"contacts.{c}").alias(c) for c in LISTS), address.alias("address"), basis.alias("first_basis"), won("footprint_m2", "more").alias("kind"))
    whole = primary.join(filled, "cluster", "left").join(attributes, "cluster", "left")
    confidence = F.round(F.least(F.lit(MOST), F.coalesce(F.nullif("p.confidence", F.lit(0.0)), F.lit(UNKNOWN)) + (F.col("merged_count") - 1) * EACH), 3)
    nothing = F.array().cast("array<string>")
    merged = whole.select(
        "cluster", *(F.col(f"p.{c}").alias(c) for c in ("doc_id", "source_id", "source_ref", "category", "lon", "lat")), *SINGLE.values(), *(F.coalesce(c, nothing).alias(c) for c in LISTS),
        F.coalesce("address", F.map_from_arrays(nothing, nothing)).alias("address"), F.coalesce("attributes", F.map_from_arrays(nothing, nothing)).alias("attributes"),
        F.coalesce("p.basis", "first_basis").alias("basis"), F.coalesce("kind", "p.geometry_kind").alias("geometry_kind"), "merged_count", confidence.alias("confidence"), *(F.col(f"p.{c}").alias(c) for c in kept),
    )
    who = ["cluster", "doc_id"]
    gave = _first(facts.filter("field != 'attribute'"), tasks).repartition(tasks, *who).groupBy(*who).agg(F.array_sort(F.collect_set("field")).alias("gave"))
    members = shared.filter("cluster is not null").select(*who, "source_id", "source_ref").repartition(tasks, *who).join(gave.hint("merge"), who, "left")
    fields = F.when(F.array_contains("gave", ""), F.array(F.lit("identity"), F.lit("geometry"))).otherwise(F.coalesce("gave", F.array(F.lit("corroboration"))))
    return merged, members.select("cluster", "doc_id", "source_id", "source_ref", fields.alias("fields"))
