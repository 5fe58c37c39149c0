"""Whole merged records: what fills what, clashing attributes, provenance, ties and empty input."""

from atrisk.operators import merge
from atrisk.plans import merge_queries
from atrisk.sources import fixtures as fx

PRIORITY = {"schools": 95, "facilities": 78, "osm": 50}
TYPES = {"doc_id": "long", "source_id": "string", "source_ref": "string", "name": "string", "category": "string", "lon": "double", "lat": "double", "confidence": "double", "phone": "array<string>", "email": "array<string>", "website": "string", "operator": "string", **{c: "double" for c in merge.CAPACITIES}, "basis": "string", "address": "map<string,string>", "attributes": "map<string,string>", "footprint_m2": "double", "geometry_kind": "string", "floors": "double"}


def run(spark, rows, clusters=None):
    records = spark.createDataFrame([tuple(r.get(c) for c in TYPES) for r in rows], ", ".join(f"{c} {t}" for c, t in TYPES.items()))
    labels = spark.createDataFrame([(r["doc_id"], (clusters or {}).get(r["doc_id"], 1)) for r in rows], "doc_id long, cluster long")
    merged, provenance = merge.merged_records(records, labels, PRIORITY)
    return {r["cluster"]: r.asDict(True) for r in merged.collect()}, {r["doc_id"]: r["fields"] for r in provenance.collect()}


def test_gaps_are_filled_in_order_of_priority(spark):
    got, fields = run(spark, [
        {"doc_id": 1, "source_id": "osm", "name": "Escola", "confidence": 0.6, "lon": 2.0, "phone": ["1", "2"], "footprint_m2": 900.0, "geometry_kind": "footprint", "floors": 3.0, "attributes": {"ref": "o", "wheelchair": "yes"}, "address": {"street": "C. Major", "city": "Vic"}},
        {"doc_id": 2, "source_id": "schools", "name": "", "confidence": 0.8, "lon": 2.1, "phone": ["2", "3", "3", None], "students": 0.0, "geometry_kind": "point", "attributes": {"ref": "s"}, "address": {"street": "", "postcode": "08500"}},
        {"doc_id": 3, "source_id": "facilities", "name": "Centre", "confidence": 0.7, "students": 200.0, "basis": "enrolled", "beds": 0.0, "attributes": {"ref": "f", "zone": None}, "address": {"city": "Vic (B)"}},
        {"doc_id": 4, "source_id": "osm", "name": "Late", "confidence": 0.5, "students": 1.0, "basis": "guess", "phone": ["1"], "attributes": {"ref": "o2"}},
        {"doc_id": 5, "source_id": "unknown", "confidence": None},
    ])
    m = got[1]
    assert (m["doc_id"], m["source_id"], m["lon"], m["name"]) == (2, "schools", 2.1, "Centre")
    assert m["phone"] == ["2", "3", "1"] and m["email"] == []
    assert (m["students"], m["basis"], m["beds"]) == (200.0, "enrolled", None)
    assert (m["footprint_m2"], m["geometry_kind"], m["floors"]) == (900.0, "footprint", 3.0)
    assert m["address"] == {"postcode": "08500", "city": "Vic (B)", "street": "C. Major"}
    assert m["attributes"] == {"ref": "s", "facilities:ref": "f", "osm:ref": "o", "zone": None, "wheelchair": "yes"}
    assert (m["merged_count"], m["confidence"]) == (5, 0.98)
    assert fields == {2: ["identity", "geometry"], 3: ["address.city", "capacity.students", "name"], 1: ["address.street", "contacts.phone", "floors", "footprint_m2"], 4: ["corroboration"], 5: ["corroboration"]}


def test_ties_single_records_and_bare_ones(spark):
    got, fields = run(spark, [
        {"doc_id": 9, "source_id": "osm", "confidence": 0.6, "website": "late"}, {"doc_id": 8, "source_id": "osm", "confidence": 0.6, "website": "first"},
        {"doc_id": 7, "source_id": "schools"},
    ], {7: 2})
    assert (got[1]["doc_id"], got[1]["website"], got[1]["confidence"]) == (8, "first", 0.66)
    assert (got[2]["confidence"], got[2]["merged_count"], got[2]["attributes"], got[2]["phone"], got[2]["address"]) == (0.5, 1, {}, [], {})
    assert fields == {8: ["identity", "geometry"], 9: ["corroboration"], 7: ["identity", "geometry"]}
    assert run(spark, []) == ({}, {})


def test_records_of_one_split_are_dealt_out_before_their_facts(spark, monkeypatch):
    tasks, facts = [], merge._facts

    def seen(ranked):
        tasks.append(ranked.rdd.glom().map(len).collect())
        return facts(ranked)

    monkeypatch.setattr(merge, "_facts", seen)
    merge.merged_records(*merge_queries._records(spark, "/root/testdata/sf0.001"), fx.SOURCES)
    assert max(tasks[0]) < 100  # of 150


def test_tasks_follow_the_rows_and_large_clusters_come_in_shares(spark, monkeypatch):
    """What a task holds doesn't grow with the input, and shares change no result."""
    rows = [{"doc_id": i, "source_id": ["osm", "schools", "facilities"][i % 3], "source_ref": str(i), "confidence": i % 7 / 10, "phone": [str(i % 5), str(i)], "beds": float(i % 2), "basis": f"b{i}", "attributes": {"ref": str(i), f"own{i % 4}": "x"}, "address": {"street": f"s{i}"} if i % 6 else {}} for i in range(120)]
    clusters = {i: 1 if i < 90 else i // 3 for i in range(120)}
    whole = run(spark, rows, clusters)
    monkeypatch.setattr(merge, "ROWS", 10)
    monkeypatch.setattr(merge, "SHARE", 8)
    tasks, facts = [], merge._facts

    def seen(ranked):
        tasks.append(ranked.rdd.glom().map(len).collect())
        return facts(ranked)

    monkeypatch.setattr(merge, "_facts", seen)
    assert run(spark, rows, clusters) == whole
    assert len(tasks[0]) == 12 and max(tasks[0]) < 60  # 90 are one cluster
