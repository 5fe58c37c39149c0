"""Odd rows of landed tables: empty, null, short and unreadable ones."""

from pyspark.sql import functions as F

from atrisk.functions import tag_rules
from atrisk.operators import landed


def test_header_is_found_or_file_left_out(spark):
    rows = [("a", 0, ["Registre", None, None, None, None]), ("a", 1, ["Códi", "Nom del centre", "x", "y", "z"]), ("a", 2, ["1", " Hospital ", None, "", "4"]), ("a", 3, []), ("b", 0, ["only", "two"]), ("b", 1, None)]
    df = spark.createDataFrame(rows, "file string, line int, cells array<string>")
    got = landed.messy_table(df, {"code": ("codi",), "name": ("nom",), "beds": ("llits",)}).orderBy("line").collect()
    assert [tuple(r) for r in got] == [("a", 2, "1", "Hospital", None), ("a", 3, None, None, None)]
    assert landed.messy_table(df.limit(0), {"code": ("codi",)}).count() == 0


def test_whole_name_beats_part(spark):
    df = spark.createDataFrame([(["codipostal", "codi"],), (["codipostal"],), ([],)], "n array<string>")
    assert [r[0] for r in df.select(landed.position_of(F.col("n"), "codi")).collect()] == [1, 0, None]


def test_phones_and_addresses(spark):
    df = spark.createDataFrame([("93 123 45 67; 0034931234567", None, "/example.cat"), (None, None, None), ("1234", "+44 20 7946 09", "http://"), ("", "", "")], "a string, b string, u string")
    got = df.select(landed.phones(F.col("a"), F.col("b")), landed.web_address(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(["+34931234567"], "https://example.cat"), ([], None), (["+4420794609"], None), ([], None)]


def test_elements_prefer_geometry_then_position(spark):
    rows = [("way", 1, 0, None, "a"), ("way", 1, 2, [1.0], "c"), ("way", 1, 1, [2.0], "b"), ("node", 1, 5, None, "e"), ("node", 1, 4, None, "d")]
    got = landed.elements(spark.createDataFrame(rows, "kind string, id long, position int, geometry array<double>, name string"))
    assert {(r.kind, r.name) for r in got.collect()} == {("way", "b"), ("node", "d")}


def test_shapes_of_short_and_flat_runs(spark):
    runs = [[], [(1.0, 1.0)], [(0.0, 0.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)], [(3.0, 4.0), (3.0, 4.0)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*runs, None])], "i int, p array<struct<x:double,y:double>>")
    got = [r[0] for r in df.orderBy("i").select(landed.feature_shape(F.col("p"))).collect()]
    assert got[0] is None and got[1] is None and got[5] is None
    assert tuple(got[2]) == ("line", 1.0, 0.0, None)
    assert tuple(got[3]) == ("footprint", 1.0, 0.0, 0.0)
    assert tuple(got[4]) == ("line", 3.0, 4.0, None)


def test_classes_without_tags(spark):
    df = spark.createDataFrame([(None,), ({},), ({"shop": ""},), ({"shop": None},), ({"highway": "steps"},)], "t map<string,string>")
    assert [tuple(r) for r in df.select(tag_rules.tag_class(F.col("t")), tag_rules.tag_class(F.col("t"), tag_rules.NETWORKS)).collect()] == [(None, None)] * 5


def test_warnings_of_unknown_facts(spark):
    facts = spark.createDataFrame([(None, 3)], "a int, b int")
    got = landed.warnings(facts, {"x": (F.col("a") > 1, F.lit("no")), "y": (F.col("b") > 1, F.lit("yes"))}).collect()
    assert [tuple(r) for r in got] == [(1, "y", "yes")]
