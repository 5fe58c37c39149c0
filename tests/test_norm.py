"""Text keys, numbers and coordinates of registries against plain Python."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from atrisk.functions import norm


def applied(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def plain_fold(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[^\w]+", " ", s.replace("·", "")).strip().lower()


def test_folding_matches_unicode_decomposition(spark):
    letters = ["".join(chr(c) for c in range(at, at + 32)) for at in [*range(0xA0, 0x600, 32), *range(0x1E00, 0x2000, 32)]]
    said = ["Instal·lacions  esportives", "Žižek", "Школа № 5", "Ακαδημία", "école", "ﬁn ½", "a_b-c", "", " "]
    got = applied(spark, norm.folded, said + letters)
    for text, have in zip(said + letters, got, strict=True):
        assert have == plain_fold(text), (text, have)


def test_name_keys(spark):
    a, b, c, d = applied(spark, norm.name_key, ["Hospital de Sant Joan de Déu, S.A.", "HOSPITAL SANT JOAN DEU", None, "Les Fundació SAU"])
    assert a == b == "deu hospital joan sant" and (c, d) == ("", "")


def test_numbers(spark):
    cases = {"1.234,5": 1234.5, "1,5": 1.5, "": None, "n/a": None, None: None, "1,234.5": 1234.5, "12 m": 12.0, "-3,25 %": -3.25, "1.234.567": None, "1.234.567,8": 1234567.8, "1e3": 1000.0, "-": None, "abc": None}
    assert applied(spark, norm.decimal, list(cases)) == list(cases.values())


def test_degrees(spark):
    got = applied(spark, norm.dms, ["42.0º 8.0' 33.0498''", "1.0º 4.0' 16.269''", "41.3872", "2,5", "", None, "41° 23' S", "2° O", "junk", '-1° 30\' 0" N'])
    want = [42.1425138, 1.0711858, 41.3872, 2.5, None, None, -(41 + 23 / 60), -2.0, None, -1.5]
    assert [g if g is None else pytest.approx(w, abs=1e-6) for g, w in zip(got, want, strict=True)] == want or all((g is None and w is None) or abs(g - w) < 1e-6 for g, w in zip(got, want, strict=True))


def test_plane_coordinates(spark):
    df = spark.createDataFrame([("438227", "4655818", None, None), ("1", "2", None, None), (None, None, "0", "0"), ("438227", "4655818", "2.1", "41.5"), ("438.227,0", "4.655.818,0", "999", "41")], "e string, n string, x string, y string")
    got = [tuple(r.at) if r.at else (None, None) for r in df.select(norm.coordinates(*(F.col(c) for c in ("x", "y", "e", "n"))).alias("at")).collect()]
    metres = lambda lon, lat: math.hypot((lon - 2.253505) * 111320 * math.cos(math.radians(lat)), (lat - 42.05198) * 111320)
    assert metres(*got[0]) < 5 and metres(*got[4]) < 5 and got[1:4] == [(None, None), (None, None), (2.1, 41.5)]


def test_names_are_cased_only_where_all_is_loud(spark):
    got = applied(spark, norm.title_case, ["ESCOLA  SANT JORDI CAP", "Escola de l'IES McKay", "CAP", None, "  ", "12345"])
    assert got == ["Escola Sant Jordi CAP", "Escola de l'IES McKay", "CAP", None, None, "12345"]
