"""Readers of delimited, zipped, spreadsheet and JSON deliveries; schemas are stated, never inferred from data."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.wkb import GEOMETRY


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8", empty_is_null: bool = False, lower: bool = False, multi_line: bool = False) -> DataFrame:
    """A CSV with a header, every column a string; only `columns` if given.  Empty fields stay empty unless
    `empty_is_null`.  The header alone is read ahead of the query.  With `multi_line` quoted fields may hold line feeds,
    and then a file can't be split over tasks."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"')
    df = reader.option("nullValue", "").option("inferSchema", False).csv(path)
    # the parser knows no empty unquoted field
    df = df.select([F.nullif(c, F.lit("")).alias(c) for c in df.columns]) if empty_is_null else df.na.fill("")
    if lower:
        df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.select(*columns) if columns else df


def zipped_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member, content) of the first archive member whose name matches, one row per archive."""

    def run(batches):
        for batch in batches:
            out = {"path": [], "member": [], "content": []}
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in sorted(z.namelist()):
                        if fnmatch.fnmatch(m, pattern):
                            out["path"].append(name)
                            out["member"].append(m)
                            out["content"].append(z.read(m))
                            break
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary")


def zipped_csv(spark: SparkSession, path: str, columns: list[str], pattern: str = "*conjunto_de_datos*.csv", encoding: str = "utf-8") -> DataFrame:
    """The rows of the first matching CSV of each archive, as strings, by the names in its header."""
    import csv

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = csv.DictReader(io.StringIO(data.decode(encoding), newline=""))
                part = []
                for r in rows:
                    part.append({c: r.get(c) for c in columns})
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_pylist(part, schema=schema)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema=schema)

    schema = pa.schema([(c, pa.string()) for c in columns])
    return zipped_members(spark, path, pattern).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def sheet_rows(data: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[dict[int, str]]:
    """The rows of a worksheet as column number -> text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{space}row"):
            cells = {}
            for c in row.iter(f"{space}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
                number = 0
                for ch in letters:
                    number = number * 26 + ord(ch) - 64
                v, inline = c.find(f"{space}v"), c.find(f"{space}is")
                text = "".join(t.text or "" for t in inline.iter(f"{space}t")) if inline is not None else v.text if v is not None else None
                cells[number - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append(cells)
    return out


def zipped_sheet(spark: SparkSession, path: str, positions: dict[int, str], skip: int, pattern: str = "*.xlsx") -> DataFrame:
    """The worksheet rows after the first `skip`, the columns at `positions`, as strings."""
    schema = pa.schema([(c, pa.string()) for c in positions.values()])

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [{name: r.get(k) for k, name in positions.items()} for r in sheet_rows(data)[skip:]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return zipped_members(spark, path, pattern).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in positions.values()))


def read_geojson(spark: SparkSession, path: str, properties: str, srid: int = 4326) -> DataFrame:
    """The features of GeoJSON collections: their properties (a DDL of names and types) and `geom`, single kinds
    promoted to multi ones; features without a geometry keep a null one."""
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<properties:struct<{_struct(properties)}>,geometry:struct<type:string,coordinates:string>>>").json(path)
    one = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("_t"), F.col("f.geometry.coordinates").alias("_c"))
    point = "array<double>"
    as_ = lambda t: F.from_json("_c", t)
    polygons = (
        F.when(F.col("_t") == "MultiPolygon", as_(f"array<array<array<{point}>>>"))
        .when(F.col("_t") == "Polygon", F.array(as_(f"array<array<{point}>>")))
        .when(F.col("_t") == "MultiLineString", F.transform(as_(f"array<array<{point}>>"), lambda line: F.array(line)))
        .when(F.col("_t") == "LineString", F.array(F.array(as_(f"array<{point}>"))))
        .when(F.col("_t") == "MultiPoint", F.transform(as_(f"array<{point}>"), lambda p: F.array(F.array(p))))
        .when(F.col("_t") == "Point", F.array(F.array(F.array(as_(point)))))
    )
    rings = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))))
    kind = F.upper(F.when(F.startswith("_t", F.lit("Multi")), F.col("_t")).otherwise(F.concat(F.lit("Multi"), F.col("_t"))))
    geom = F.when(rings.isNotNull(), F.struct(kind.alias("kind"), F.lit(srid).alias("srid"), rings.alias("rings"), F.lit(None).cast(GEOMETRY.partition("bbox:")[2][:-1]).alias("bbox")))
    return one.withColumn("geom", geom).drop("_t", "_c")


def _struct(ddl: str) -> str:
    return ",".join(":".join(x.split()) for x in ddl.split(","))


def granule_links(responses: DataFrame, body: str, suffix: str, part: str, tile: str) -> DataFrame:
    """Of each entry of JSON search responses, the first link that ends in `suffix` and holds `part` and `tile`."""
    entries = responses.select(F.explode(F.from_json(body, "feed struct<entry:array<struct<id:string,links:array<struct<href:string>>>>>")["feed"]["entry"]).alias("e"))
    fits = lambda u: F.endswith(u, F.lit(suffix)) & F.contains(u, F.lit(part)) & F.contains(u, F.lit(tile))
    first = F.get(F.filter(F.col("e.links.href"), fits), F.lit(0))
    return entries.select(F.col("e.id").alias("id"), first.alias("href")).where("href is not null")


def paged_records(pages: DataFrame, page: str, body: str, record: str) -> DataFrame:
    """(page, record fields) of the stored responses of a paged interface: JSON arrays of objects with the fields of
    `record` (DDL), read up to the first page that holds none; a response that is no array counts as empty."""
    parsed = pages.select(F.col(page).alias("page"), F.from_json(body, f"array<struct<{_struct(record)}>>").alias("_r"))
    empty = parsed.where(F.coalesce(F.size("_r"), F.lit(0)) <= 0).agg(F.min("page").alias("_end"))
    upto = parsed.crossJoin(F.broadcast(empty)).where(F.col("_end").isNull() | (F.col("page") < F.col("_end")))  # one row
    return upto.select("page", F.inline("_r"))


def missing_granules(links: DataFrame, stored: DataFrame, href: str = "href", name: str = "name") -> DataFrame:
    """The links whose file (the last part of the path) isn't among the stored ones."""
    return links.join(stored.select(F.col(name).alias("_name")).distinct(), F.substring_index(href, "/", -1) == F.col("_name"), "left_anti")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: object = None, high: object = None, parts: int = 1, rows: int = 10_000, **properties: str) -> DataFrame:
    """A database table, or a query in brackets with a name; columns and filters go to the database.

    With a numeric or time `column` it is read in `parts` at once, cut evenly between `low` and `high`, rows beyond them
    included; without one by a single task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(rows), **properties)
    if column and parts > 1:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
