"""The p1 and p2 queries: loading with rejects, and points near points or inside regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.projection import EPSG_6372
from zonalis.operators.quadtree_join import point_targets, quadtree_join, region_targets
from zonalis.operators.rejects import DENUE_RULES, load_denue, rejected
from zonalis.plans.runtime import table

#: Metres within which a stop serves an establishment.
STOP_REACH = 400.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(table(spark, sf_dir, "denue_raw")).select("record_id")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(table(spark, sf_dir, "denue_raw")).select("record_id", F.array_join("reasons", "; ").alias("reason"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "denue_raw")
    return load_denue(raw, rejected(raw)).drop("geom")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = point_targets(table(spark, sf_dir, "gtfs_stops"), "stop_id", F.col("geom.x"), F.col("geom.y"), STOP_REACH)
    zones = region_targets(table(spark, sf_dir, "ageb"), "cvegeo", "geom")
    return quadtree_join(table(spark, sf_dir, "denue"), "denue_id", "x_6372", "y_6372", stops.unionByName(zones))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_rejects": p1_rejects, "p1_loaded": p1_loaded, "p2_found": p2_found,
}

_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_RECORD = rf"^{_FIELD}(?:,{_FIELD}){{14}}$"
_PARTS = "^" + ",".join([_FIELD] * 15) + "$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PARSED = f"""
WITH cut AS (
  SELECT *, CASE WHEN right(coalesce(raw_record, ''), 1) = chr(13) THEN left(raw_record, length(raw_record) - 1) ELSE coalesce(raw_record, '') END AS rec FROM denue_raw
), shaped AS (
  SELECT *, regexp_extract(rec, '{_PARTS}', [{", ".join(f"'f{i}'" for i in range(15))}]) AS f, regexp_full_match(rec, '{_RECORD}') AS whole FROM cut
), cells AS (
  SELECT *, {", ".join(f"CASE WHEN f.f{i}[1] = chr(34) THEN replace(f.f{i}[2:length(f.f{i}) - 1], chr(34) || chr(34), chr(34)) ELSE f.f{i} END AS c{i}" for i in range(15))} FROM shaped
), judged AS (
  SELECT *, whole AND regexp_full_match(trim(c0), '[0-9]+') AND coalesce(try_cast(trim(c0) AS DOUBLE) BETWEEN 1 AND 2147483647, false)
    AND (trim(c12) = '' OR (regexp_full_match(trim(c12), '{_NUMBER}') AND coalesce(try_cast(trim(c12) AS DOUBLE) BETWEEN -90 AND 90, false)))
    AND (trim(c13) = '' OR (regexp_full_match(trim(c13), '{_NUMBER}') AND coalesce(try_cast(trim(c13) AS DOUBLE) BETWEEN -180 AND 180, false))) AS good
  FROM cells)
"""  # fmt: skip

_NAMES = "[" + ", ".join(f"'{r.column}'" for r in DENUE_RULES) + "]"
#: Fields by toggling quotes, as a record with a quoting fault still has them, and each field's error.
_REASONS = f"""
WITH recs AS (
  SELECT record_id, raw_record, CASE WHEN right(coalesce(raw_record, ''), 1) = chr(13) THEN left(raw_record, length(raw_record) - 1) ELSE coalesce(raw_record, '') END AS rec FROM denue_raw
), split AS (
  SELECT *, string_split(array_to_string(list_transform(string_split(rec, chr(34)), lambda s, i: CASE WHEN i % 2 = 0 THEN replace(s, ',', chr(2)) ELSE s END), chr(34)), ',') AS parts FROM recs
), fields AS (
  SELECT record_id, raw_record, len(parts) AS n, unnest(range(len(parts))) AS pos, unnest(list_transform(parts, lambda p: replace(p, chr(2), ','))) AS c FROM split
), judged AS (
  SELECT *, CASE WHEN left(c, 1) = chr(34) THEN length(c) >= 2 AND right(c, 1) = chr(34) AND NOT contains(replace(substring(c, 2, greatest(length(c) - 2, 0)), chr(34) || chr(34), ''), chr(34))
    ELSE NOT contains(c, chr(34)) END AS sound FROM fields
), valued AS (
  SELECT *, trim(CASE WHEN sound AND left(c, 1) = chr(34) THEN replace(substring(c, 2, length(c) - 2), chr(34) || chr(34), chr(34)) ELSE c END) AS v,
    coalesce({_NAMES}[pos + 1], 'beyond') AS name FROM judged
), errors AS (
  SELECT record_id, raw_record, CASE WHEN pos = 0 AND n <> 15 THEN 'fields:' || n WHEN NOT sound THEN 'quoting:' || name WHEN n <> 15 THEN NULL
    WHEN pos = 0 AND v = '' THEN 'empty:denue_id' WHEN pos = 0 AND NOT regexp_full_match(v, '[0-9]+') THEN 'not_integer:denue_id'
    WHEN pos = 0 AND NOT coalesce(try_cast(v AS DOUBLE) BETWEEN 1 AND 2147483647, false) THEN 'out_of_range:denue_id'
    WHEN pos IN (12, 13) AND v <> '' AND NOT regexp_full_match(v, '{_NUMBER}') THEN 'not_decimal:' || name
    WHEN pos IN (12, 13) AND v <> '' AND NOT coalesce(abs(try_cast(v AS DOUBLE)) <= CASE pos WHEN 12 THEN 90 ELSE 180 END, false) THEN 'out_of_range:' || name END AS e FROM valued
)
SELECT record_id, array_to_string(list_sort(list_distinct(list(e))), '; ') AS reason FROM errors WHERE e IS NOT NULL GROUP BY record_id, raw_record
"""  # fmt: skip


def _sql_plane(lon: str, lat: str) -> tuple[str, str]:
    """The conic projection written out."""
    p, es = EPSG_6372, f"({EPSG_6372.ecc!r} * sin(radians({lat})))"
    rho = f"({p.scale!r} * power(tan(pi() / 4 - radians({lat}) / 2) / power((1 - {es}) / (1 + {es}), {p.ecc / 2!r}), {p.cone!r}))"
    theta = f"({p.cone!r} * radians({lon} - ({p.lon0!r})))"
    return f"{rho} * sin({theta}) + {p.false_east!r}", f"{p.rho0 + p.false_north!r} - {rho} * cos({theta})"


_X, _Y = _sql_plane("longitud", "latitud")
_LOADED = f"""{_PARSED}, loaded AS (SELECT record_id, source_file, trim(c0)::INTEGER AS denue_id,
  {", ".join(f"c{i} AS {r.column}" for i, r in enumerate(DENUE_RULES) if r.kind == "text")},
  nullif(trim(c12), '')::DOUBLE AS latitud, nullif(trim(c13), '')::DOUBLE AS longitud, received_at AS cargado_en FROM judged WHERE good)
SELECT *, CASE WHEN latitud > -90 THEN round(({_X}) * 8) / 8 END AS x_6372, CASE WHEN latitud > -90 THEN round(({_Y}) * 8) / 8 END AS y_6372 FROM loaded"""

_EDGES = """
WITH pts AS (SELECT DISTINCT denue_id, x_6372 AS x, y_6372 AS y FROM denue WHERE denue_id IS NOT NULL AND x_6372 IS NOT NULL AND y_6372 IS NOT NULL AND NOT isnan(x_6372) AND NOT isnan(y_6372)),
stops AS (SELECT DISTINCT stop_id, geom.x AS x, geom.y AS y FROM gtfs_stops WHERE geom.x IS NOT NULL AND geom.y IS NOT NULL),
near AS (SELECT DISTINCT denue_id, stop_id AS other_id FROM pts p JOIN stops s
  ON p.x BETWEEN s.x - 400 AND s.x + 400 AND p.y BETWEEN s.y - 400 AND s.y + 400 AND (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 160000),
polys AS (SELECT cvegeo, row_number() OVER () AS pid, part FROM (SELECT DISTINCT cvegeo, unnest(geom.rings) AS part FROM ageb)),
rings AS (SELECT cvegeo, pid, unnest(part) AS r FROM polys),
edges AS (SELECT cvegeo, pid, unnest(list_transform(range(1, len(r) + 1), lambda i: {'x1': r[i].x, 'y1': r[i].y, 'x2': r[i % len(r) + 1].x, 'y2': r[i % len(r) + 1].y})) AS e FROM rings),
boxes AS (SELECT pid, min(e.x1) AS xa, max(e.x1) AS xb, min(e.y1) AS ya, max(e.y1) AS yb FROM edges GROUP BY pid),
crossed AS (SELECT p.denue_id, p.x, p.y, b.pid, any_value(e.cvegeo) AS cvegeo, count(*) AS n
  FROM pts p JOIN boxes b ON p.x BETWEEN b.xa AND b.xb AND p.y BETWEEN b.ya AND b.yb JOIN edges e ON e.pid = b.pid
  WHERE (e.e.y1 > p.y) <> (e.e.y2 > p.y) AND p.x < (e.e.x2 - e.e.x1) * (p.y - e.e.y1) / (e.e.y2 - e.e.y1) + e.e.x1 GROUP BY p.denue_id, p.x, p.y, b.pid)
SELECT * FROM near UNION SELECT DISTINCT denue_id, cvegeo AS other_id FROM crossed WHERE n % 2 = 1
"""

ORACLES: dict[str, str] = {
    "p1_found": f"{_PARSED} SELECT record_id FROM judged WHERE NOT good",
    "p1_rejects": _REASONS,
    "p1_loaded": _LOADED,
    "p2_found": _EDGES,
}
