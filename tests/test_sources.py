import io
import json
import sqlite3
import struct
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from zonalis.functions.wkb import decode, encode, from_wkb, to_wkb
from zonalis.sources import files, sinks
from zonalis.sources.spatial import GeoPackage, Shapefile, TiffTiles

SQUARE = [[[{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 0.0}]]]


def test_wkb_round_trip(spark):
    for kind, rings in (("POINT", [[[{"x": 1.5, "y": -2.0}]]]), ("LINESTRING", [[[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}]]]), ("POLYGON", SQUARE), ("MULTIPOLYGON", SQUARE * 2), ("MULTIPOINT", [[[{"x": 1.0, "y": 1.0}]], [[{"x": 2.0, "y": 1.0}]]])):
        got = decode(encode(kind, rings), 6372)
        assert (got["kind"], got["srid"], got["rings"]) == (kind, 6372, rings)
    assert decode(b"\x00" + struct.pack(">I2d", 0x20000001, 0, 0)[:4] + struct.pack(">i2d", 4326, 7.0, 8.0))["srid"] == 4326
    df = spark.createDataFrame([(encode("MULTIPOLYGON", SQUARE),), (None,)], "w binary").select("w", from_wkb(F.col("w"), 1).alias("g"))
    back = df.select("w", to_wkb(F.col("g")).alias("v"), F.col("g.bbox.xmax").alias("x")).collect()
    assert bytes(back[0]["v"]) == bytes(back[0]["w"]) and back[0]["x"] == 2.0 and back[1]["v"] is None


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ID,Nombre,X\n007,\"Peña, S.A.\",\n8,,z\n".encode("latin-1"))
    df = files.read_strings(spark, str(tmp_path / "a.csv"), ["nombre", "id"], "ISO-8859-1", empty_is_null=True, lower=True)
    assert rows(df) == [("Peña, S.A.", "007"), (None, "8")]
    assert {r["X"] for r in files.read_strings(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1").collect()} == {"", "z"}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("d/conjunto_de_datos_1.csv", "anio,valor\n2023,5\n2024,\n")
        sheet = io.BytesIO()
        with zipfile.ZipFile(sheet, "w") as x:
            x.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Jalisco</t></si></sst>')
            x.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1"><v>0</v></c></row><row><c r="A2"><v>14</v></c><c r="AB2" t="s"><v>0</v></c></row></sheetData></worksheet>')
        z.writestr("t.xlsx", sheet.getvalue())
    assert rows(files.zipped_csv(spark, str(tmp_path / "b.zip"), ["valor", "anio"])) == [("", "2024"), ("5", "2023")]
    assert rows(files.zipped_sheet(spark, str(tmp_path / "b.zip"), {0: "ent", 27: "name"}, 1)) == [("14", "Jalisco")]


def test_geojson_both_ways(spark, tmp_path):
    feature = lambda g, n: {"type": "Feature", "properties": {"name": n, "k": 1}, "geometry": g}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "p"), feature({"type": "Point", "coordinates": [1, 2]}, "q"), feature(None, "r")]}))
    df = files.read_geojson(spark, str(tmp_path / "g.json"), "name string, k int")
    got = {r["name"]: r["geom"] for r in df.collect()}
    assert got["p"]["kind"] == "MULTIPOLYGON" and got["q"]["rings"][0][0][0]["y"] == 2.0 and got["r"] is None
    out = json.loads(sinks.feature_collection(df.where("name <> 'q'"), "geom", ["name"], "name"))
    assert out["features"][0]["geometry"]["coordinates"] == [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]]] and out["features"][1]["geometry"] is None


def test_granule_links(spark):
    body = json.dumps({"feed": {"entry": [{"id": "a", "links": [{"href": "x/h07v06.txt"}, {"href": "prod-lads/h07v06.h5"}]}, {"id": "b", "links": [{"href": "prod-lads/h08v06.h5"}]}]}})
    assert rows(files.granule_links(spark.createDataFrame([(body,)], "body string"), "body", ".h5", "prod-lads", "h07v06")) == [("a", "prod-lads/h07v06.h5")]


def test_spatial_files(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "z.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, name TEXT, size REAL, geom BLOB)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom', 6372)")
    head = b"GP\0" + bytes([1 | 1 << 1]) + struct.pack("<i4d", 6372, 0, 2, 0, 2)
    db.executemany("INSERT INTO zones VALUES (?, ?, ?, ?)", [(i, f"z{i}", i / 2, head + encode("MULTIPOLYGON", SQUARE) if i % 2 else None) for i in range(1, 8)])
    db.commit()
    db.close()
    for source in (GeoPackage, Shapefile, TiffTiles):
        spark.dataSource.register(source)
    df = spark.read.format("geopackage").option("layer", "zones").option("rows", "3").load(str(tmp_path / "z.gpkg"))
    got = {r["fid"]: r for r in df.collect()}
    assert len(got) == 7 and got[3]["name"] == "z3" and got[3]["geom"]["srid"] == 6372 and got[2]["geom"] is None and got[1]["geom"]["rings"][0][0][1]["x"] == 2.0
    ring, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    shape = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(shape) // 2) + shape + struct.pack(">2i", 2, 2) + struct.pack("<i", 0))
    shapes = {r["shape_no"]: r["geom"] for r in spark.read.format("shapefile").option("srid", "6372").load(str(tmp_path / "s.shp")).collect()}
    assert len(shapes[1]["rings"]) == 1 and len(shapes[1]["rings"][0]) == 2 and shapes[2] is None
    import numpy as np

    band = np.arange(35, dtype="<f4").reshape(5, 7)
    tags = [(256, 3, 7), (257, 3, 5), (258, 3, 32), (259, 3, 1), (273, 4, 400), (278, 3, 5), (279, 4, 140), (339, 3, 3)]
    raw = b"II*\0" + struct.pack("<IH", 8, len(tags) + 2) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    raw += struct.pack("<HHII", 33550, 12, 3, 200) + struct.pack("<HHII", 33922, 12, 6, 240)
    raw = raw.ljust(200, b"\0") + struct.pack("<3d", 15.0, 15.0, 0.0)
    raw = raw.ljust(240, b"\0") + struct.pack("<6d", 0, 0, 0, 1000.0, 2000.0, 0)
    (tmp_path / "r.tif").write_bytes(raw.ljust(400, b"\0") + band.tobytes())
    tiles = {r["tile_id"]: r for r in spark.read.format("tifftiles").option("tile", "3").load(str(tmp_path / "r.tif")).collect()}
    assert len(tiles) == 6 and tiles["3_6"]["band"] == [27.0, 34.0] and (tiles["3_6"]["x0"], tiles["3_6"]["y0"]) == (1090.0, 1955.0)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "running", 1), ("b", "done", 2), (None, "x", 3)], "run string, status string, started int")
    new = spark.createDataFrame([("a", "done", 9), ("c", "running", 9), ("c", "running", 9), (None, "y", 9)], "run string, status string, started int")
    assert rows(sinks.upserted(old, new, ["run"], ["status"])) == [("a", "done", 1), ("b", "done", 2), ("c", "running", 9), (None, "y", 3)]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old.na.fill("z"), path, ["run"])
    sinks.replace_partitions(new.where("run = 'a'"), path, ["run"])
    assert {(r["run"], r["started"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2), ("z", 3)}
    twice = new.unionByName(spark.createDataFrame([("c", "late", 10), ("c", "none", None)], new.schema))
    assert rows(sinks.upserted(old, twice, ["run"], ["status"], latest="started"))[2] == ("c", "late", 10)
    assert rows(sinks.deleted(old, F.col("run") == "a")) == [("b", "done", 2), (None, "x", 3)]
    assert rows(sinks.updated(old, F.col("run") == "a", {"status": F.lit("done"), "started": F.col("started") + 1})) == [("a", "done", 2), ("b", "done", 2), (None, "x", 3)]
    assert sinks.altered(old, ("started", "gone"), {"run": "id"}, {"n": F.lit(1)}).columns == ["id", "status", "n"]
    sinks.view(old, "runs_seen")
    assert spark.sql("select count(*) from runs_seen where status = 'done'").first()[0] == 1
    sinks.write_csv(old, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    assert sinks.markdown_table(old.orderBy("started")).splitlines()[2] == "| a | running | 1 |"


def test_geopackage_both_ways(spark, tmp_path):
    kind = "struct<kind:string,srid:int,rings:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
    df = spark.createDataFrame([(1, "a", 0.5, ("MULTIPOLYGON", 6372, SQUARE, None)), (2, None, None, None)], f"fid bigint, na_me string, size double, shape {kind}")
    path = str(tmp_path / "out.gpkg")
    for _ in range(2):  # a layer is replaced
        sinks.write_geopackage(df, path, "zones", "shape")
    sinks.write_geopackage(df.limit(0), path, "none", "shape")
    spark.dataSource.register(GeoPackage)
    back = {r["fid"]: r for r in spark.read.format("geopackage").option("layer", "zones").load(path).collect()}
    assert len(back) == 2 and (back[1]["na_me"], back[1]["size"], back[1]["shape"]["srid"]) == ("a", 0.5, 6372) and back[2]["shape"] is None
    assert [[[tuple(q) for q in r] for r in p] for p in back[1]["shape"]["rings"]] == [[[(q["x"], q["y"]) for q in r] for r in p] for p in SQUARE]
    assert spark.read.format("geopackage").option("layer", "none").load(path).count() == 0


def test_models_are_kept(spark, tmp_path):
    from zonalis.operators import models

    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "k int, a double, y int")
    model = models.random_forest(df, ["a"], "y", trees=3, depth=3)
    sinks.save_model(model, str(tmp_path), "forest", ["a"], 0.4)
    back, features, threshold = sinks.load_model(str(tmp_path), "forest")
    assert (features, threshold) == (["a"], 0.4) and rows(models.scored(back, df, features)) == rows(models.scored(model, df, features))


def test_one_report_of_several():
    text = sinks.synthesis({"one": "# A\n![p](p.png) ![q](https://x/q.png)\n", "two": "## B"})
    assert text == "## A\n![p](one/p.png) ![q](https://x/q.png)\n\n---\n\n### B\n"


def test_pages_and_granules(spark):
    pages = spark.createDataFrame([(1, '[{"Id":"7","Nombre":"a"}]'), (2, '[{"Id":"8"},{"Id":"9"}]'), (3, "[]"), (4, '[{"Id":"10"}]')], "page int, body string")
    assert rows(files.paged_records(pages, "page", "body", "Id string, Nombre string")) == [(1, "7", "a"), (2, "8", None), (2, "9", None)]
    assert files.paged_records(pages.where("page < 3"), "page", "body", "Id string").count() == 3 and files.paged_records(pages.limit(0), "page", "body", "Id string").count() == 0
    links = spark.createDataFrame([("x/a.h5",), ("x/b.h5",)], "href string")
    assert rows(files.missing_granules(links, spark.createDataFrame([("a.h5",)], "name string"))) == [("x/b.h5",)]


def test_database_table(spark):
    url = "jdbc:derby:memory:zones;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(i, f"z{i}") for i in range(40)], "k int, name string")
    try:
        df.write.format("jdbc").options(url=url, dbtable="zones", driver=driver).mode("overwrite").save()
    except Exception as e:  # the database that comes with the library may be missing
        pytest.skip(str(e)[:80])
    got = files.read_jdbc(spark, url, "zones", "k", 0, 30, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 40 and files.read_jdbc(spark, url, "zones", driver=driver).where("k = 7").count() == 1


def lzw(data):
    """Packs as TIFF does; a table of its own for every 3,000 codes."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    table, word, width = {bytes([k]): k for k in range(256)}, b"", 9
    put(256, 9)
    size = 258
    for k in data:
        longer = word + bytes([k])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size > 3300:
            put(256, width)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        word = bytes([k])
    put(table[word], width)
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


@pytest.mark.parametrize("packing,predictor,big", [(1, 1, True), (5, 1, False), (5, 2, True), (8, 3, True), (8, 2, False)])
def test_packed_tiff(spark, tmp_path, packing, predictor, big):
    import zlib

    import numpy as np

    rng = np.random.default_rng(1)
    kind = "<f4" if predictor == 3 else "<i2"
    band = (np.cumsum(rng.integers(-3, 4, (60, 50)), axis=1) * (0.5 if predictor == 3 else 1)).astype(kind)
    if predictor == 2:
        raw = np.concatenate([band[:, :1], np.diff(band, axis=1)], 1).astype(kind).tobytes()
    elif predictor == 3:
        rows_ = band.astype(">f4").view(np.uint8).reshape(60, 50, 4).transpose(0, 2, 1).reshape(60, 200)
        raw = np.concatenate([rows_[:, :1], np.diff(rows_, axis=1)], 1).astype(np.uint8).tobytes()
    else:
        raw = band.tobytes()
    data = lzw(raw) if packing == 5 else zlib.compress(raw) if packing == 8 else raw
    tags = [(256, 3, 50), (257, 3, 60), (258, 3, 32 if predictor == 3 else 16), (259, 3, packing), (273, 4, 600), (278, 3, 60), (279, 4, len(data)), (317, 3, predictor), (339, 3, 3 if predictor == 3 else 2)]
    if big:
        head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in tags)
    else:
        head = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    (tmp_path / "p.tif").write_bytes(head.ljust(600, b"\0") + data)
    spark.dataSource.register(TiffTiles)
    got = np.zeros((60, 50))
    for r in spark.read.format("tifftiles").option("tile", "32").load(str(tmp_path / "p.tif")).collect():
        a, c = map(int, r["tile_id"].split("_"))
        got[a : a + r["nrows"], c : c + r["ncols"]] = np.array(r["band"]).reshape(r["nrows"], r["ncols"])
    assert (got == band).all()


@pytest.mark.parametrize("kind", ["MULTIPOLYGON"])
def test_features_lines(spark, kind):
    df = spark.createDataFrame([(1, (kind, 4326, SQUARE, None))], "k int, geom struct<kind:string,srid:int,rings:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>")
    assert json.loads(sinks.features(df, "geom", ["k"]).first()[0])["properties"] == {"k": 1}
