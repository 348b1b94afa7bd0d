"""Writing results: replace, delete-and-append by run, views, changed tables, models, and text formats."""

from __future__ import annotations

import json
import re
import sqlite3
import struct
from contextlib import closing
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.geometry import geojson
from zonalis.functions.wkb import to_wkb


def replace(df: DataFrame, path: str) -> None:
    """Drop and create."""
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Delete the runs that `df` holds, then append: only the partitions of its keys are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def view(df: DataFrame, name: str) -> None:
    """A view of the session: computed anew whenever it is read."""
    df.createOrReplaceTempView(name)


def deleted(df: DataFrame, which: Column) -> DataFrame:
    """`df` without the rows of which the condition holds; those where it is null stay."""
    return df.where(~F.coalesce(which, F.lit(False)))


def updated(df: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """`df` with new values in the rows of which the condition holds; all values see the old row."""
    hit = F.coalesce(which, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def altered(df: DataFrame, drop: tuple[str, ...] = (), rename: dict[str, str] | None = None, add: dict[str, Column] | None = None) -> DataFrame:
    """`df` with columns dropped (if they are there), renamed, then added, in that order."""
    return df.drop(*drop).withColumnsRenamed(rename or {}).withColumns(add or {})


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], update: list[str], latest: str | None = None) -> DataFrame:
    """`existing` with the `update` columns of matching `new` rows, and the `new` rows without a match.

    Keys compare null-safe.  Of several new rows of one key the one with the greatest `latest` counts, nulls least, and
    of equal ones the one whose columns are greatest in order.  Other columns of matched rows stay."""
    order = ([latest] if latest else []) + [c for c in new.columns if c != latest]
    one = new.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in new.columns])
    theirs = one.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_u_{c}") for c in update], F.lit(True).alias("_hit"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    changed = existing.join(theirs, on, "left").select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in existing.columns])
    mine = existing.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    added = one.join(mine, on, "left_anti")
    return changed.unionByName(added, allowMissingColumns=True).select(*existing.columns)


def features(df: DataFrame, geom: str, properties: list[str]) -> DataFrame:
    """(value): one GeoJSON feature per row, for a line-delimited text sink."""
    head = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'))
    return df.select(F.concat(head, F.coalesce(geojson(F.col(geom)), F.lit("null")), F.lit("}")).alias("value"))


def feature_collection(df: DataFrame, geom: str, properties: list[str], order: str) -> str:
    """One FeatureCollection as text, for results a caller knows to be small."""
    found = features(df.orderBy(order), geom, properties).toLocalIterator()
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in found) + "]}"


def write_geopackage(df: DataFrame, path: str, layer: str, geom: str = "geom", srid: int = 6372) -> None:
    """A layer of a GeoPackage file on the driver, for results a caller knows to be small; a layer of that name is
    replaced, others stay.  Whole numbers, reals and texts keep their kind, other columns are written as texts."""
    kinds = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL"}
    columns = {c: kinds.get(t, "TEXT") for c, t in df.dtypes if c != geom}
    rows = df.select(*[F.col(c) if k != "TEXT" else F.col(c).cast("string").alias(c) for c, k in columns.items()], to_wkb(F.col(geom)).alias("_wkb")).toLocalIterator()
    head = b"GP\0\1" + struct.pack("<i", srid)
    with closing(sqlite3.connect(path)) as db, db:
        # fixed values: the marks and tables the format asks for
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z INTEGER NOT NULL, m INTEGER NOT NULL)")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
        name = lambda c: '"' + c.replace('"', '""') + '"'
        db.execute(f"DROP TABLE IF EXISTS {name(layer)}")
        key = next(k for k in ("fid", "_fid", "__fid") if k not in {c.lower() for c in columns})
        db.execute(f"CREATE TABLE {name(layer)} ({key} INTEGER PRIMARY KEY, {', '.join(f'{name(c)} {k}' for c, k in columns.items())}, {name(geom)} BLOB)")
        places = ", ".join("?" * (len(columns) + 1))
        fill = f"INSERT INTO {name(layer)} ({', '.join(map(name, [*columns, geom]))}) VALUES ({places})"
        db.executemany(fill, ((*r[:-1], None if r[-1] is None else head + bytes(r[-1])) for r in rows))
        db.execute("INSERT OR REPLACE INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srid))
        db.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (layer, geom, srid))


def save_model(model, path: str, name: str, features: list[str], threshold: float | None = None) -> None:
    """A fitted model in a folder of its own, its features and threshold beside it, readable by load_model()."""
    model.write().overwrite().save(f"{path}/{name}")
    note = {"name": name, "kind": f"{type(model).__module__}.{type(model).__name__}", "features": features, "threshold": threshold}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.note")


def load_model(path: str, name: str) -> tuple:
    """(model, features, threshold) of a saved model."""
    note = json.loads(SparkSession.active().read.text(f"{path}/{name}.note").first()[0])
    module, kind = note["kind"].rsplit(".", 1)
    return getattr(import_module(module), kind).load(f"{path}/{name}"), note["features"], note["threshold"]


def synthesis(reports: dict[str, str]) -> str:
    """Several Markdown reports as one: their headings one level lower, their image links led to their folders."""
    out = []
    for folder, text in reports.items():
        text = re.sub(r"^(#+) ", r"#\1 ", text, flags=re.MULTILINE)
        out.append(re.sub(r"(!\[[^\]]*\]\()(?!https?:|/)([^)]+\))", rf"\g<1>{folder}/\g<2>", text).strip())
    return "\n\n---\n\n".join(out) + "\n"


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """The first rows of a result as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
