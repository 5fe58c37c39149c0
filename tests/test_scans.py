"""Written files: banners, orders of columns, odd lines, overlapping pages, and whole records."""

from pyspark.sql import functions as F

from atrisk.operators import holdings, landed
from atrisk.sources import scans

HEAD = "Denominación;Vía;Nombre vía;Núm. vía;Municipio;C. Postal;Teléfono;URL;Plazas;Titularidad;Latitud;Longitud;Última modificación"


def put(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_care_homes_from_province_files(spark, tmp_path):
    put(tmp_path, "2023_lleida.csv", f"Informes\r\nEspaña\r\n{HEAD}\r\nResidència Camí;C/;Major;3;Lleida;25001;973 10 20 30;example.cat;30;Pública;41,6;0,62;1/1/2023\r\n\r\n\"La \"\"Font\"\"; casa\";;;;;;;;;;;\r\n;C/;sense nom;1;x;;;;5;;1;1;\r\nCurta;C/\r\nLlarga;C/;a;1;x;1;;;x;;0;0;;més\r\n\"oberta;Av.;b;2\r\n", "iso-8859-1")
    put(tmp_path, "2023_girona.csv", "Plazas;Denominación;Longitud;Latitud\n3;Onyar;2,8;41,9\n", "iso-8859-1")
    put(tmp_path, "2023_soria.csv", "nothing here\na;b\n", "iso-8859-1")
    put(tmp_path, "2023_late.csv", "x\n" * 8 + HEAD + "\nlost;;\n", "iso-8859-1")
    put(tmp_path, "2023_empty.csv", "")
    rows, report = scans.delimited(spark, str(tmp_path), holdings.CARE_HOME_FIELDS, mark="Denominaci", part=r"\d+_([a-z]+)\.csv$")
    got = {r["name"]: r for r in rows.collect()}
    assert set(got) == {"Residència Camí", 'La "Font"; casa', None, "Curta", "Llarga", '"oberta', "Onyar"}
    assert [n for n, r in got.items() if r["irregular"]] == ["Curta", "Llarga", '"oberta'] or {n for n, r in got.items() if r["irregular"]} == {'La "Font"; casa', "Curta", "Llarga", '"oberta'}
    assert (got["Onyar"]["part"], got["Onyar"]["places"], got["Onyar"]["url"]) == ("girona", "3", None)
    files = {r["file"].rsplit("_", 1)[1]: (r["has_header"], r["rows"]) for r in report.collect()}
    assert files == {"lleida.csv": (True, 6), "girona.csv": (True, 1), "soria.csv": (False, 0), "late.csv": (False, 0)}
    homes = {r["name"]: r.asDict(True) for r in holdings.care_homes(rows).collect()}
    assert len(homes) == 6
    camí = homes["Residència Camí"]
    assert camí["source_ref"] == "lleida|Residència Camí|Lleida" and (camí["lon"], camí["lat"], camí["needs_geocoding"]) == (0.62, 41.6, False)
    assert camí["address"] == {"street": "C/ Major 3", "municipality": "Lleida", "postcode": "25001", "country": "ES"}
    assert camí["contacts"] == {"phone": ["+34973102030"], "website": "https://example.cat"} and (camí["capacity"]["places"], camí["capacity"]["people"]) == (30.0, 40)
    assert homes["Llarga"]["needs_geocoding"] and homes["Llarga"]["capacity"] is None and homes["Curta"]["address"]["street"] == "C/"


def test_delimited_rows_of_files_in_several_splits(spark, tmp_path):
    put(tmp_path, "1_big.csv", "banner\n" + "Denominación;Plazas\n" + "".join(f"casa {i};{i}\n" for i in range(5000)), "iso-8859-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, report = scans.delimited(spark, str(tmp_path), {"name": ("Denominacion",), "places": ("Plazas",)}, mark="Denominaci")
        assert rows.agg(F.sum(F.col("places").cast("int")), F.count_distinct("name")).first()[:] == (sum(range(5000)), 5000)
        assert report.first()["rows"] == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_overlapping_pages_and_unreadable_lines(spark, tmp_path):
    put(tmp_path, "page-1.json", '{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n{broken\n{"v": "no key"}\n')
    put(tmp_path, "page-2.json", '{"id": 2, "v": "later"}\n{"id": 3, "v": null, "more": 1}\n{"v": "no key"}\n')
    rows, bad = scans.json_pages(spark, str(tmp_path), "id bigint, v string", "id")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, None), (None, "no key"), (None, "no key")], key=repr)
    assert [(r["file"].rsplit("/", 1)[1], r["text"]) for r in bad.collect()] == [("page-1.json", "{broken")]


def test_pages_that_are_arrays(spark, tmp_path):
    put(tmp_path, "p1.json", '[{"id": 1, "v": "a"}\n,{"id": 2,\n "v": "b"}]')
    put(tmp_path, "p2.json", '[{"id": 2, "v": "c"}]')
    put(tmp_path, "p3.json", '[{"id": 7, ')
    rows, bad = scans.json_pages(spark, str(tmp_path), "id bigint, v string", "id", multi_line=True)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")] and bad.count() == 1


def test_gazetteer_lines(spark, tmp_path):
    def line(name, plain, others, lat, lon, code):
        return "\t".join(["1", name, plain, others, str(lat), str(lon), "P", code] + [""] * 8)

    text = "\n".join([line("Lleida", "Lleida", "Lerida,Lérida,Ll", 41.6, 0.6, "PPLA2"), line("Lleida", "Lleida", "", 41.61, 0.61, "ADM3"), line("Alfa", "Alfa", "Lérida", 1, 2, "PPLA2"), line("Beta", "Beta", "", "x", 2, "PPL"), line("Gamma", "Gamma", "", 1, 2, "MT"), "short\tline", line('"Quoted', "Q", "", 5, 6, "PPL")])
    got = {r["name"]: (r["lon"], r["lat"]) for r in scans.gazetteer_lines(spark, put(tmp_path, "ES.txt", text)).collect()}
    assert got == {"lleida": (0.61, 41.61), "lerida": (0.6, 41.6), "alfa": (2.0, 1.0), "quoted": (6.0, 5.0)}


def test_element_files(spark, tmp_path):
    put(tmp_path, "a.json", '{"version": 0.6,\n "elements": [{"type": "way", "id": 1, "center": {"lat": 41.0, "lon": 2.0}, "tags": {"name": "late"}},\n {"type": "node", "id": 1, "lat": 40.0, "lon": 1.0}]}')
    put(tmp_path, "b.json", '{"elements": [{"type": "way", "id": 1, "geometry": [{"lat": 41.0, "lon": 2.0}, {"lat": 41.1, "lon": 2.0}], "tags": {"name": "shape"}}]}')
    put(tmp_path, "c.json", '{"elements": [')
    put(tmp_path, "d.json", '{"elements": []}')
    got = {(r["kind"], r["id"]): r for r in landed.elements(scans.map_elements(spark, str(tmp_path))).collect()}
    assert set(got) == {("way", 1), ("node", 1)}
    assert got["way", 1]["tags"] == {"name": "shape"} and len(got["way", 1]["geometry"]) == 2
    assert (got["node", 1]["lon"], got["node", 1]["lat"], got["node", 1]["geometry"]) == (1.0, 40.0, None)


def herd(spark, rows):
    names = ["codi_rega", "estat_explotaci_", "esp_cie", "total_ub", "position", *holdings.HOLDING_TEXTS]
    at = {"latitud": "42.0º 8.0' 33.0498''", "longitud": "1.0º 30.0' 0.0''"}
    full = [tuple({**at, **r}.get(n) for n in names) for r in rows]
    return holdings.livestock(spark.createDataFrame(full, ", ".join(f"{n} {'int' if n == 'position' else 'string'}" for n in names)))


def test_a_holding_s_place_is_read_once(spark):
    from atrisk.plans import registry

    plan = registry.queries()["n10_livestock"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[NSEWO]") <= 4  # a test and a match for either figure


def test_livestock_counts_a_species_once(spark):
    got = {r["source_ref"]: r.asDict(True) for r in herd(spark, [
        {"codi_rega": " A ", "estat_explotaci_": "Activa", "esp_cie": "Boví", "total_ub": "100", "position": 1, "nom_explotaci": "MAS GRAN", "nom_municipi": "VIC"},
        {"codi_rega": "A", "estat_explotaci_": None, "esp_cie": "Boví", "total_ub": "100", "position": 2},
        {"codi_rega": "A", "estat_explotaci_": "", "esp_cie": "Gallines", "total_ub": "1.000,0", "position": 3},
        {"codi_rega": "A", "estat_explotaci_": "Baixa", "esp_cie": "Porcí", "total_ub": "9999", "position": 0},
        {"codi_rega": "B", "esp_cie": "Abelles", "total_ub": "12", "position": 4},
        {"codi_rega": "C", "esp_cie": "Gallines", "total_ub": "10", "position": 5, "latitud": None, "longitud": "x"},
        {"codi_rega": "D", "esp_cie": None, "total_ub": None, "position": 6, "latitud": None, "coor_x": "440000", "coor_y": "4600000", "marca_oficial": "Marca"},
        {"codi_rega": " ", "esp_cie": "Boví", "total_ub": "1", "position": 7},
    ]).collect()}
    assert set(got) == {"A", "B", "D"}
    a = got["A"]
    assert (a["subcategory"], a["name"], a["capacity"]["animals"], a["capacity"]["livestock_units"]) == ("mixed_livestock", "MAS Gran", 1100, 90.0)
    assert a["attributes"]["species"] == ["Boví", "Gallines"] and a["attributes"]["species_head_capacity"] == {"Boví": 100, "Gallines": 1000}
    assert (a["attributes"]["dominant_group"], a["attributes"]["sub_exploitations"]) == ("cattle", 3) and abs(a["lat"] - 42.142514) < 1e-6
    assert (got["B"]["subcategory"], got["B"]["capacity"]["livestock_units"]) == ("apiculture", None)
    assert (got["D"]["subcategory"], got["D"]["name"], got["D"]["capacity"]["animals"]) == ("mixed_livestock", "Marca", None) and 41 < got["D"]["lat"] < 42
    assert herd(spark, []).count() == 0
