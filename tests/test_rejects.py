import csv
import io

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonalis.operators.rejects import DENUE_RULES, cells, load_denue, loadable, rejected

GOOD = ["7", "c", "n", "", "1", "s", "0 a 5 personas", "14", "039", "1", "1330", "2", "20.5", "-103.25", "2020-01"]


def record(**changes):
    f = dict(zip((r.column for r in DENUE_RULES), GOOD)) | changes
    return ",".join(f.values())


def frame(spark, texts):
    return spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "record_id bigint, source_file string, raw_record string").withColumn("received_at", F.lit(None).cast("timestamp_ntz"))


def test_good_and_bad_records(spark):
    good = [record(), record() + "\r", record(nombre_unidad='"a, ""b""\nc"'), record(latitud="", longitud=" "), record(denue_id=' "1'[:1] + "0012 "), record(latitud="+2.0E+01"), record(fecha_alta='""'), record(denue_id='"9"')]
    bad = {
        record(denue_id=""): "empty:denue_id", record(denue_id="0"): "out_of_range:denue_id", record(denue_id="2147483648"): "out_of_range:denue_id", record(denue_id="1.0"): "not_integer:denue_id",
        record(latitud="90.0001"): "out_of_range:latitud", record(longitud="NaN"): "not_decimal:longitud", record(latitud="1e400"): "out_of_range:latitud", record(latitud="٢٠"): "not_decimal:latitud",
        record(denue_id='"12\n"'): "not_integer:denue_id", record(latitud='"20.5\n"'): "not_decimal:latitud", record(denue_id="12\t"): "not_integer:denue_id",
        record(clee='a"b'): "quoting:clee", record(clee='"a"b'): "quoting:clee", record(fecha_alta='"open'): "quoting:fecha_alta", record() + ",x": "fields:16", "": "fields:1",
    }
    out = {r["raw_record"]: r["reasons"] for r in rejected(frame(spark, [*good, *bad])).collect()}
    assert set(out) == set(bad)
    for text, reason in bad.items():
        assert reason in out[text]


def test_edges(spark):
    raw = frame(spark, [record(), None, None, record(denue_id="x")]).withColumn("column", F.lit(1)).withColumn("kind", F.lit("a"))
    raw = raw.union(raw).withColumn("record_id", F.when(F.col("record_id") != 1, F.col("record_id")))
    bad = rejected(raw)
    assert rows(bad.select("record_id", "reasons")) == sorted([(None, ["fields:1"]), (2, ["fields:1"]), (3, ["not_integer:denue_id"])], key=lambda r: (r[0] is None, str(r[0])))
    assert [r["record_id"] for r in loadable(raw, bad).collect()] == [0, 0]
    assert rejected(raw.limit(0)).count() == 0
    assert load_denue(raw.limit(0), rejected(raw.limit(0))).count() == 0
    long = frame(spark, ['"' + '""' * 50_000 + '"' + "," * 14, "," * 40_000])
    assert {tuple(r["reasons"]) for r in rejected(long).collect()} == {("not_integer:denue_id",), ("fields:40001",)}


def test_loaded_values(spark):
    raw = frame(spark, [record(nombre_unidad='"a ""b"", c"', denue_id=" 12 ")])
    r = load_denue(raw, rejected(raw)).collect()[0]
    assert (r["denue_id"], r["nombre_unidad"], r["latitud"], r["geom"]["x"]) == (12, 'a "b", c', 20.5, -103.25)
    assert abs(r["x_6372"] - round(r["x_6372"] * 8) / 8) == 0


def test_plane_coordinates_up_to_the_poles(spark):
    raw = frame(spark, [record(latitud=lat) for lat in ("90", "-89.99", "-90", "0")])
    found = {r["latitud"]: r["x_6372"] for r in load_denue(raw, rejected(raw)).collect()}
    assert found.pop(-90.0) is None and all(x is not None for x in found.values()) and len(found) == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(st.sampled_from('ab,"\n\x01 é'), max_size=6), min_size=1, max_size=5), min_size=1, max_size=8))
def test_round_trip_of_quoted_fields(spark, table):
    texts = []
    for fields in table:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
        texts.append(out.getvalue())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cells(F.col("t")).alias("c"))
    for r in df.collect():
        assert [c["value"] for c in r["c"]] == table[r["i"]] and all(c["sound"] for c in r["c"])
