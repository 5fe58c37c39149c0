"""Whole records of schools, social services and public facilities."""

from atrisk.operators import registers


def table(spark, rows):
    names = sorted({n for r in rows for n in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def test_schools(spark):
    school = {"curs": "2023/24", "codi_centre": " 080 ", "denominaci_completa": "ESCOLA SANT JORDI", "epri": "S", "coordenades_geo_x": "2,1", "coordenades_geo_y": "41.5", "adre_a": " C/ Major  3", "codi_postal": "08001", "nom_municipi": "BARCELONA", "tel_fon": "93 123 45 67 / 600111222", "e_mail_centre": "A@b.cat; c@d.cat, A@b.cat", "url": "escola.cat", "nom_titularitat": "Ajuntament"}
    rows = table(spark, [
        school, school | {"curs": "2022/23", "codi_centre": "old"}, school | {"codi_centre": None}, school | {"codi_centre": "x", "coordenades_geo_x": None, "coordenades_utm_x": None},
        {"curs": "2023/24", "codi_centre": "u", "denominaci_completa": "Escola Bressol del Mar", "eso": "1", "coordenades_utm_x": "440000", "coordenades_utm_y": "4600000"},
    ])
    counts = table(spark, [{"curs": "2023/24", "codi_centre": "080", "matr_cules_total": n, "unitats": "2"} for n in ("100", "25", None)] + [{"curs": "2022/23", "codi_centre": "080", "matr_cules_total": "999", "unitats": "9"}, {"curs": "2023/24", "codi_centre": "u", "matr_cules_total": "0", "unitats": "1"}])
    got = {r["source_ref"]: r.asDict(True) for r in registers.schools(rows, counts).collect()}
    assert set(got) == {"080", "u"}
    s = got["080"]
    assert (s["subcategory"], s["name"], s["lon"], s["lat"], s["confidence"]) == ("primary_school", "Escola Sant Jordi", 2.1, 41.5, 0.85)
    assert s["address"] == {"street": "C/ Major 3", "postcode": "08001", "municipality": "Barcelona", "comarca": None, "region": "Catalunya", "country": "ES"}
    assert s["contacts"] == {"phone": ["+34931234567", "+34600111222"], "email": ["a@b.cat", "c@d.cat"], "website": "https://escola.cat", "operator": "Ajuntament"}
    assert s["capacity"] == {"students": 125.0, "people": 140, "basis": "enrolment 2023/24 + 12% staff", "confidence": 0.75} and s["attributes"]["units"] == 6.0
    assert (got["u"]["subcategory"], got["u"]["capacity"]) == ("nursery", None) and 41 < got["u"]["lat"] < 42 and got["u"]["contacts"]["phone"] == []
    assert registers.schools(rows.limit(0), counts).count() == 0 and registers.schools(rows, counts.limit(0)).filter("capacity is not null").count() == 0


def test_social_services(spark):
    rows = table(spark, [
        {"registre": "S1", "tipologia": "Residència assistida per a gent gran", "nom": "LLAR DEL SOL", "adreca": "Pg. Nou 1", "municipi": "VIC", "capacitat": "60", "entitat_titular": "FUNDACIÓ NOVA"},
        {"registre": "S2", "tipologia": "Servei d'ajuda a domicili", "capacitat": "5"}, {"registre": " ", "tipologia": "Centre de dia"},
        {"registre": "S3", "tipologia": "Llar residència per a persones amb discapacitat", "capacitat": "0"},
    ])
    got = {r["source_ref"]: r.asDict(True) for r in registers.social_services(rows).collect()}
    assert {k: r["subcategory"] for k, r in got.items()} == {"S1": "care_home", "S3": "disability_home"}
    one = got["S1"]
    assert (one["capacity"]["places"], one["capacity"]["people"], one["contacts"], one["needs_geocoding"], one["lon"]) == (60.0, 60.0, {"operator": "Fundació Nova"}, True, None)
    assert one["address"]["municipality"] == "VIC" and got["S3"]["capacity"] is None
    assert registers.social_services(rows.limit(0)).count() == 0


def test_facilities(spark):
    rows = table(spark, [
        {"idequipament": "1", "categoria": "Turisme|Albergs", "nom": "", "alies": "ALBERG DEL BOSC", "longitud": "2.2", "latitud": "41.9", "tipus_via": "Carrer", "via": "Nou", "num": "7", "telefon1": "972000111", "telefon2": "0033 145678901", "email": "info@alberg.cat", "poblacio": "Olot"},
        {"idequipament": "2", "categoria": None, "nom": "Instal·lacions esportives Can Roca", "longitud": "0", "latitud": "0", "utmx": "440000", "utmy": "4600000"},
        {"idequipament": "3", "categoria": "Hotels", "longitud": "x"}, {"idequipament": None, "longitud": "2", "latitud": "41"},
    ])
    got = {r["source_ref"]: r.asDict(True) for r in registers.facilities(rows).collect()}
    assert set(got) == {"1", "2"}
    a = got["1"]
    assert (a["subcategory"], a["name"], a["address"]["street"], a["address"]["municipality"]) == ("hostel", "Alberg DEL Bosc", "Carrer Nou 7", "Olot")
    assert a["contacts"] == {"phone": ["+34972000111", "+33145678901"], "email": ["info@alberg.cat"], "website": None, "operator": None}
    assert got["2"]["subcategory"] not in ("other", None) and 41 < got["2"]["lat"] < 42
    assert registers.facilities(rows.limit(0)).count() == 0
