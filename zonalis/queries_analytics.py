"""Queries of the spatial and statistical operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions.projection import forward, inverse
from zonalis.functions.scalars import MUNICIPALITIES, SECTOR_PREFIXES, safe_corr
from zonalis.operators import line_supply, metrics, models, siting, weighting, zone_features
from zonalis.operators.quadtree_join import point_targets, quadtree_join
from zonalis.operators.ranking import stratified_split
from zonalis.plans.runtime import checkpointed
from zonalis.plans.runtime import table as T
from zonalis.queries_relational import _sql_jobs, _sql_sector, entropy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL shared by the oracles: plain planar geometry over edges -----------------------------------------------------

_LOCATED = """located AS (SELECT denue_id, scian_codigo, estrato_personal, x_6372 AS x, y_6372 AS y FROM (SELECT *, row_number() OVER (PARTITION BY denue_id
  ORDER BY cargado_en DESC NULLS LAST, scian_codigo DESC NULLS LAST, estrato_personal DESC NULLS LAST, x_6372 DESC NULLS LAST) AS k FROM denue WHERE denue_id IS NOT NULL) WHERE k = 1 AND x_6372 IS NOT NULL AND NOT isnan(x_6372))"""
_STOPS = "stops AS (SELECT DISTINCT stop_id, geom.x AS x, geom.y AS y FROM gtfs_stops WHERE geom.x IS NOT NULL AND geom.y IS NOT NULL AND stop_id IS NOT NULL)"
_ZONES = """polys AS (SELECT cvegeo, row_number() OVER () AS pid, part FROM (SELECT DISTINCT cvegeo, unnest(geom.rings) AS part FROM ageb)),
rings AS (SELECT cvegeo, pid, unnest(part) AS r FROM polys),
edges AS (SELECT cvegeo, pid, e.x1, e.y1, e.x2, e.y2 FROM (SELECT cvegeo, pid, unnest(list_transform(range(1, len(r) + 1), lambda i: {'x1': r[i].x, 'y1': r[i].y, 'x2': r[i % len(r) + 1].x, 'y2': r[i % len(r) + 1].y})) AS e FROM rings)),
boxes AS (SELECT pid, min(x1) AS xa, max(x1) AS xb, min(y1) AS ya, max(y1) AS yb FROM edges GROUP BY pid)"""


def _inside(points: str, key: str) -> str:
    return f"""inside AS (SELECT DISTINCT {key}, cvegeo AS ageb_id FROM (SELECT p.{key}, b.pid, any_value(e.cvegeo) AS cvegeo, count(*) AS n FROM {points} p
  JOIN boxes b ON p.x BETWEEN b.xa AND b.xb AND p.y BETWEEN b.ya AND b.yb JOIN edges e ON e.pid = b.pid
  WHERE (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY p.{key}, p.x, p.y, b.pid) WHERE n % 2 = 1)"""


_INSIDE_DENUE = f"WITH {_LOCATED}, {_ZONES}, {_inside('located', 'denue_id')}"
_INSIDE_STOPS = f"{_ZONES}, {_inside('stops', 'stop_id')}"
_STOP_DISTANCES = f"""WITH {_STOPS}, {_INSIDE_STOPS}, away AS (SELECT stop_id, cvegeo AS ageb_id, min(sqrt(power(x - x1 - t * dx, 2) + power(y - y1 - t * dy, 2))) AS d FROM (
  SELECT s.stop_id, s.x, s.y, e.cvegeo, e.x1, e.y1, e.x2 - e.x1 AS dx, e.y2 - e.y1 AS dy,
    greatest(0, least(1, coalesce(((s.x - e.x1) * (e.x2 - e.x1) + (s.y - e.y1) * (e.y2 - e.y1)) / nullif(power(e.x2 - e.x1, 2) + power(e.y2 - e.y1, 2), 0), 0))) AS t
  FROM stops s JOIN boxes b ON s.x BETWEEN b.xa - 2000 AND b.xb + 2000 AND s.y BETWEEN b.ya - 2000 AND b.yb + 2000 JOIN edges e ON e.pid = b.pid) GROUP BY stop_id, cvegeo),
dist AS (SELECT stop_id, ageb_id, CASE WHEN i.stop_id IS NOT NULL THEN 0 ELSE d END AS distance FROM away LEFT JOIN inside i USING (stop_id, ageb_id) WHERE d <= 2000 OR i.stop_id IS NOT NULL)"""
_ACCESS = """zones AS (SELECT DISTINCT cvegeo AS ageb_id FROM ageb WHERE cvegeo IS NOT NULL),
access AS (SELECT z.ageb_id, count(*) FILTER (WHERE distance <= 400) AS stops_400m, count(*) FILTER (WHERE distance <= 800) AS stops_800m, min(distance) AS min_stop_dist_m FROM zones z LEFT JOIN dist d USING (ageb_id) GROUP BY z.ageb_id)"""
_EMPLOYERS = f"big AS (SELECT *, {_sql_jobs('estrato_personal')} AS jobs, {_sql_sector('scian_codigo')} AS sector FROM located WHERE estrato_personal NOT IN ('0 a 5 personas', '6 a 10 personas'))"
_EMPLOYMENT = f"{_EMPLOYERS}, {_inside('big', 'denue_id').replace('inside AS', 'at_work AS')}, emp AS (SELECT ageb_id, count(*) AS total_establishments, sum(CASE WHEN jobs = 500 THEN 300 ELSE jobs END)::BIGINT AS employment_proxy FROM at_work JOIN big USING (denue_id) GROUP BY ageb_id)"
_TOPO = "topo AS (SELECT ageb_id, avg(slope_mean) AS slope_mean FROM ageb_topography WHERE slope_mean IS NOT NULL AND NOT isnan(slope_mean) AND slope_mean <> -9999 GROUP BY ageb_id)"
_SHAPES = "shapes AS (SELECT left(stop_id, 2) AS shape, stop_id || '|' || lpad(cast(x AS VARCHAR), 12, ' ') AS o, x, y FROM (SELECT DISTINCT stop_id, geom.x AS x, geom.y AS y FROM gtfs_stops WHERE geom.x IS NOT NULL))"
#: Lengths of the steps of the lines within 800 m of each zone: every edge's disc and rectangle cut an interval out of a
#: step, and so does the inside of the polygon; united over all parts of a zone.
_ROUTES = f"""{_SHAPES}, steps AS (SELECT row_number() OVER () AS sid, px AS ax, py AS ay, x AS bx, y AS by_, sqrt(power(x - px, 2) + power(y - py, 2)) AS l
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM shapes WINDOW w AS (PARTITION BY shape ORDER BY o)) WHERE px IS NOT NULL),
met AS (SELECT s.sid, b.pid, s.l, s.ax, s.ay, (s.bx - s.ax) / s.l AS ux, (s.by_ - s.ay) / s.l AS uy FROM steps s JOIN boxes b
  ON least(ax, bx) <= b.xb + 800 AND greatest(ax, bx) >= b.xa - 800 AND least(ay, by_) <= b.yb + 800 AND greatest(ay, by_) >= b.ya - 800 WHERE l > 0),
along AS (SELECT m.*, cvegeo, x1 - ax AS dx, y1 - ay AS dy, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS el, (x2 - x1) / nullif(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 0) AS ex,
  (y2 - y1) / nullif(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 0) AS ey FROM met m JOIN edges e USING (pid)),
turned AS (SELECT *, dx * ux + dy * uy AS fwd, dx * uy - dy * ux AS off, ux * ey - uy * ex AS r1, dy * ex - dx * ey AS a1, ux * ex + uy * ey AS r2, -dx * ex - dy * ey AS a2 FROM along),
cuts AS (SELECT sid, pid, 0.0 AS t FROM met UNION SELECT sid, pid, l FROM met UNION SELECT sid, pid, (dx * ey - dy * ex) / r1 FROM turned WHERE abs(r1) > 1e-12 AND (dx * ey - dy * ex) / r1 BETWEEN 0 AND l
  AND ((dx * ey - dy * ex) / r1 * ux - dx) * ex + ((dx * ey - dy * ex) / r1 * uy - dy) * ey BETWEEN -1e-6 AND el + 1e-6),
mids AS (SELECT c.sid, c.pid, t AS lo, lead(t) OVER (PARTITION BY c.sid, c.pid ORDER BY t) AS hi, m.ax, m.ay, m.ux, m.uy FROM cuts c JOIN met m ON c.sid = m.sid AND c.pid = m.pid),
within AS (SELECT k.sid, any_value(e.cvegeo) AS cvegeo, lo, hi FROM mids k JOIN edges e USING (pid) WHERE hi IS NOT NULL AND (e.y1 > ay + (lo + hi) / 2 * uy) <> (e.y2 > ay + (lo + hi) / 2 * uy)
  AND ax + (lo + hi) / 2 * ux < (e.x2 - e.x1) * (ay + (lo + hi) / 2 * uy - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY k.sid, k.pid, lo, hi HAVING count(*) % 2 = 1),
spans AS (SELECT sid, cvegeo, greatest(lo, 0) AS lo, least(hi, l) AS hi FROM (
  SELECT sid, cvegeo, l, fwd - sqrt(640000 - off * off) AS lo, fwd + sqrt(640000 - off * off) AS hi FROM turned WHERE abs(off) < 800
  UNION ALL SELECT sid, cvegeo, l, greatest(CASE WHEN abs(r1) < 1e-12 THEN CASE WHEN abs(a1) <= 800 THEN 0 ELSE 1e18 END ELSE least((-800 - a1) / r1, (800 - a1) / r1) END,
      CASE WHEN abs(r2) < 1e-12 THEN CASE WHEN a2 BETWEEN 0 AND el THEN 0 ELSE 1e18 END ELSE least(-a2 / r2, (el - a2) / r2) END),
    least(CASE WHEN abs(r1) < 1e-12 THEN 1e18 ELSE greatest((-800 - a1) / r1, (800 - a1) / r1) END, CASE WHEN abs(r2) < 1e-12 THEN 1e18 ELSE greatest(-a2 / r2, (el - a2) / r2) END) FROM turned WHERE el > 0
  UNION ALL SELECT sid, cvegeo, 1e18, lo, hi FROM within) WHERE least(hi, l) > greatest(lo, 0)),
reached AS (SELECT *, max(hi) OVER (PARTITION BY sid, cvegeo ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans),
supply AS (SELECT cvegeo AS ageb_id, sum(greatest(0, hi - greatest(lo, coalesce(upto, lo)))) / 1000 AS km FROM reached GROUP BY cvegeo)"""
_MASTER = f"""{_STOP_DISTANCES}, {_ACCESS}, {_LOCATED}, {_EMPLOYMENT}, {_TOPO}, {_ROUTES}, master AS (SELECT a.*, e.employment_proxy, coalesce(t.slope_mean, 0) AS slope_mean, coalesce(r.km, 0) AS route_km_800m
  FROM access a JOIN emp e USING (ageb_id) LEFT JOIN topo t USING (ageb_id) LEFT JOIN supply r USING (ageb_id))"""


def _sql_normalised(table: str, to: str, key: str) -> str:
    tops = ", ".join(f"max({c}) AS _{f}" for f, c, _ in siting.CRITERIA)
    each = ", ".join(f"CASE WHEN _{f} > 0 THEN {f'(_{f} - {c})' if less else c} / _{f} ELSE 0 END AS {f}" for f, c, less in siting.CRITERIA)
    return f"{to} AS (SELECT {key}, {each} FROM {table}, (SELECT {tops} FROM {table}))"


_NORM = f"{_MASTER}, {_sql_normalised('master', 'norm', 'ageb_id')}"
_NORMS = siting.FEATURES


def _sql_critic(table: str, columns: list[str]) -> str:
    r = lambda a, b: f"coalesce((SELECT covar_pop({a}, {b}) / nullif(sqrt(var_pop({a}) * var_pop({b})), 0) FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), 0)"
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS feature, (SELECT var_pop({a}) FROM {table}) AS variance, ({' + '.join(f'abs({r(min(a, b), max(a, b))})' for b in columns if b != a)}) / {len(columns) - 1} AS avg_abs_correlation" for a in columns
    )
    return f"""raw_weights AS ({rows}), weights AS (SELECT *, (CASE WHEN avg_abs_correlation > 0 THEN 1 - avg_abs_correlation ELSE 1 END) * coalesce(variance, 0.001) AS weight_unnormalized FROM raw_weights)"""


def _denue(s, d):
    return T(s, d, "denue")


def _stops(s, d):
    return T(s, d, "gtfs_stops")


def _zones(s, d):
    return T(s, d, "ageb")


# --- spatial joins and measures --------------------------------------------------------------------------------------


@query(f"{_INSIDE_DENUE} SELECT * FROM inside")
def jn_spatial_pip_within(s, d):
    return zone_features.zones_of(zone_features.located(_denue(s, d)), "denue_id", "x_6372", "y_6372", _zones(s, d))


@query(f"WITH {_STOPS}, {_INSIDE_STOPS} SELECT ageb_id, count(*) AS n FROM inside GROUP BY ageb_id")
def jn_spatial_pip_intersects(s, d):
    return zone_features.zones_of(zone_features.stop_points(_stops(s, d)), "stop_id", "x", "y", _zones(s, d), closed=True).groupBy("ageb_id").agg(F.count("*").alias("n"))


@query(f"{_STOP_DISTANCES} SELECT stop_id, ageb_id, round(distance, 4) AS distance FROM dist")
def jn_spatial_dwithin(s, d):
    return zone_features.stop_distances(_stops(s, d), _zones(s, d)).withColumn("distance", F.round("distance", 4))


_SELF = f"WITH {_STOPS} SELECT DISTINCT a.stop_id, b.stop_id AS other_id FROM stops a JOIN stops b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 160000"


@query(_SELF)
def jn_spatial_self(s, d):
    at = zone_features.stop_points(_stops(s, d))
    return quadtree_join(at, "stop_id", "x", "y", point_targets(at, "stop_id", F.col("x"), F.col("y"), 400.0)).distinct()


@query(f"SELECT stop_id, count(DISTINCT other_id) AS n FROM ({_SELF}) GROUP BY stop_id")
def jn_corr_scalar(s, d):
    return jn_spatial_self(s, d).groupBy("stop_id").agg(F.count_distinct("other_id").alias("n"))


_AREA = "list_sum(list_transform(geom.rings, lambda p: list_sum(list_transform(range(1, len(p) + 1), lambda k: (CASE WHEN k = 1 THEN 1 ELSE -1 END) * abs(list_sum(list_transform(range(1, len(p[k]) + 1), lambda i: (p[k][i].x - p[k][1].x) * (p[k][i % len(p[k]) + 1].y - p[k][1].y) - (p[k][i % len(p[k]) + 1].x - p[k][1].x) * (p[k][i].y - p[k][1].y)))) / 2))))"


@query(f"SELECT cvegeo, round({_AREA}, 2) AS area FROM ageb")
def geo_area(s, d):
    return _zones(s, d).select("cvegeo", F.round(G.area(F.col("geom")), 2).alias("area"))


@query("SELECT cvegeo, round(list_sum(list_transform(flatten(geom.rings), lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda i: sqrt(power(r[i].x - r[i % len(r) + 1].x, 2) + power(r[i].y - r[i % len(r) + 1].y, 2)))))), 3) AS length FROM ageb")
def geo_length(s, d):
    return _zones(s, d).select("cvegeo", F.round(G.perimeter(F.col("geom")), 3).alias("length"))


@query("SELECT cvegeo, p.x AS x, p.y AS y FROM (SELECT cvegeo, unnest(flatten(flatten(geom.rings))) AS p FROM ageb)")
def geo_dump_points(s, d):
    return _zones(s, d).select("cvegeo", F.explode(G.points_of(F.col("geom"))).alias("p")).select("cvegeo", "p.x", "p.y")


@query("SELECT cvegeo, len(flatten(geom.rings)) AS lines, len(flatten(flatten(geom.rings))) AS points FROM ageb")
def geo_boundary(s, d):
    return _zones(s, d).select("cvegeo", F.size(G.boundary(F.col("geom"))).cast("bigint").alias("lines"), F.size(G.points_of(F.col("geom"))).cast("bigint").alias("points"))


@query("""WITH p AS (SELECT cvegeo, geom.bbox AS b, list_transform(flatten(flatten(geom.rings)), lambda q: q.x) AS xs, list_transform(flatten(flatten(geom.rings)), lambda q: q.y) AS ys FROM ageb)
SELECT cvegeo, coalesce(b.xmin, list_min(xs)) AS xmin, coalesce(b.ymin, list_min(ys)) AS ymin, coalesce(b.xmax, list_max(xs)) AS xmax, coalesce(b.ymax, list_max(ys)) AS ymax FROM p""")
def geo_bbox(s, d):
    return _zones(s, d).select("cvegeo", G.bbox(F.col("geom")).alias("b")).select("cvegeo", "b.*")


@query("SELECT geom.kind AS kind, geom.srid AS srid, count(*) AS n FROM ageb GROUP BY 1, 2")
def geo_type(s, d):
    return _zones(s, d).groupBy(F.col("geom.kind").alias("kind"), F.col("geom.srid").alias("srid")).agg(F.count("*").alias("n"))


def _lines(s, d):
    at = zone_features.stop_points(_stops(s, d))
    return at.groupBy(F.left("stop_id", F.lit(2)).alias("shape")).agg(G.make_line(F.concat("stop_id", F.lit("|"), F.lpad(F.col("x").cast("string"), 12, " ")), F.col("x"), F.col("y")).alias("line"))


@query(f"WITH {_SHAPES} SELECT shape, count(*) AS points, round(coalesce(sum(sqrt(power(x - px, 2) + power(y - py, 2))), 0), 3) AS length FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM shapes WINDOW w AS (PARTITION BY shape ORDER BY o)) GROUP BY shape")
def geo_make_line(s, d):
    return _lines(s, d).select("shape", F.size("line").cast("bigint").alias("points"), F.round(G.line_length(F.col("line")), 3).alias("length"))


@query(f"""WITH {_SHAPES}, seg AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS l FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM shapes WINDOW w AS (PARTITION BY shape ORDER BY o))),
run AS (SELECT *, sum(coalesce(l, 0)) OVER (PARTITION BY shape ORDER BY o) AS upto, sum(coalesce(l, 0)) OVER (PARTITION BY shape) / 2 AS half FROM seg),
hit AS (SELECT shape, min_by(px + (x - px) * (half - upto + l) / l, o) AS x, min_by(py + (y - py) * (half - upto + l) / l, o) AS y FROM run WHERE l > 0 AND upto >= half GROUP BY shape)
SELECT shape, round(coalesce(h.x, f.x), 3) AS x, round(coalesce(h.y, f.y), 3) AS y FROM (SELECT shape, min_by(x, o) AS x, min_by(y, o) AS y FROM shapes GROUP BY shape) f LEFT JOIN hit h USING (shape)""")
def geo_interpolate(s, d):
    return _lines(s, d).select("shape", G.interpolate(F.col("line"), 0.5).alias("m")).select("shape", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query("SELECT denue_id, x_6372, y_6372, true AS round_trip FROM denue WHERE latitud IS NOT NULL AND longitud IS NOT NULL")
def geo_transform(s, d):
    """The stored plane coordinates, out of the geographic ones, and the way back within 1e-9 degrees."""
    x, y = forward(F.col("longitud"), F.col("latitud"))
    at = _denue(s, d).where("latitud is not null and longitud is not null").select("denue_id", "longitud", "latitud", x.alias("x"), y.alias("y"))
    lon, lat = inverse(F.col("x"), F.col("y"))
    back = (F.abs(lon - F.col("longitud")) < 1e-9) & (F.abs(lat - F.col("latitud")) < 1e-9)
    return at.select("denue_id", (F.round(F.col("x") * 8) / 8).alias("x_6372"), (F.round(F.col("y") * 8) / 8).alias("y_6372"), back.alias("round_trip"))


@query("SELECT cvegeo, true AS inside FROM ageb")
def geo_repr_point(s, d):
    """A point of every zone, and that it lies inside."""
    at = _zones(s, d).select("cvegeo", "geom", G.representative_point(F.col("geom")).alias("p"))
    return at.select("cvegeo", G.contains_point(F.col("geom"), F.col("p.x"), F.col("p.y")).alias("inside"))


_SIDES = """sides AS (SELECT DISTINCT cve_mun, pid, least_ AS a, most_ AS b FROM (SELECT cve_mun, pid, CASE WHEN (x1, y1) < (x2, y2) THEN [x1, y1] ELSE [x2, y2] END AS least_, CASE WHEN (x1, y1) < (x2, y2) THEN [x2, y2] ELSE [x1, y1] END AS most_
  FROM edges JOIN (SELECT DISTINCT cvegeo, cve_mun FROM ageb) USING (cvegeo) WHERE (x1, y1) <> (x2, y2)))"""


@query(f"WITH {_ZONES}, {_SIDES}, outer_ AS (SELECT cve_mun, a, b FROM sides GROUP BY ALL HAVING count(*) % 2 = 1) SELECT cve_mun, count(*) AS edges, round(sum(sqrt(power(a[1] - b[1], 2) + power(a[2] - b[2], 2))), 3) AS length FROM outer_ GROUP BY cve_mun")
def geo_dissolve(s, d):
    """The outer edges of the zones of each municipality: an edge that two zones share is inside.  Neighbours must have
    their edges point by point in common."""
    polygons = _zones(s, d).where("cvegeo is not null").select("cve_mun", F.explode("geom.rings").alias("p")).distinct()
    sides = polygons.select("cve_mun", F.explode(F.array_distinct(G.edges(F.struct(F.array("p").alias("rings"))))).alias("e"))
    outer = sides.groupBy("cve_mun", "e").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return outer.groupBy("cve_mun").agg(F.count("*").alias("edges"), F.round(F.sum(F.hypot(F.col("e.ax") - F.col("e.bx"), F.col("e.ay") - F.col("e.by"))), 3).alias("length"))


@query("SELECT cve_mun, count(*) AS polygons FROM (SELECT DISTINCT cve_mun, unnest(geom.rings) AS p FROM ageb) GROUP BY 1")
def agg_union_geom(s, d):
    return _zones(s, d).groupBy("cve_mun").agg(F.size(G.union_geom(F.col("geom"))).cast("bigint").alias("polygons"))


# --- zone and stop indicators ----------------------------------------------------------------------------------------


@query(f"{_STOP_DISTANCES}, {_ACCESS} SELECT ageb_id, stops_400m, stops_800m, round(min_stop_dist_m, 4) AS min_stop_dist_m FROM access")
def cmp_accessibility(s, d):
    return zone_features.accessibility(_stops(s, d), _zones(s, d)).withColumn("min_stop_dist_m", F.round("min_stop_dist_m", 4))


@query(f"""WITH {_LOCATED}, {_ZONES}, {_EMPLOYMENT}, zones AS (SELECT DISTINCT cvegeo AS ageb_id FROM ageb WHERE cvegeo IS NOT NULL)
SELECT z.ageb_id, count(b.denue_id) AS units, coalesce(sum(b.jobs), 0)::BIGINT AS jobs, {", ".join(f"count(*) FILTER (WHERE b.sector = '{x}') AS {x}" for x in SECTOR_PREFIXES)}
FROM zones z LEFT JOIN at_work w USING (ageb_id) LEFT JOIN big b USING (denue_id) GROUP BY z.ageb_id""")
def cmp_economic_activity(s, d):
    return zone_features.economic_activity(_denue(s, d), _zones(s, d))


@query(f"WITH {_LOCATED}, {_ZONES}, {_EMPLOYMENT} SELECT * FROM emp")
def cmp_employment(s, d):
    return zone_features.employment(_denue(s, d), _zones(s, d))


@query(f"WITH {_TOPO} SELECT ageb_id, round(slope_mean, 6) AS slope_mean FROM topo")
def cmp_topography(s, d):
    return zone_features.slopes(T(s, d, "ageb_topography")).withColumn("slope_mean", F.round("slope_mean", 6))


def _master(s, d):
    zones, stops = _zones(s, d), _stops(s, d)
    return checkpointed(zone_features.master(zone_features.accessibility(stops, zones), zone_features.employment(_denue(s, d), zones), T(s, d, "ageb_topography"), _supply(s, d)))


@query(f"{_MASTER} SELECT ageb_id, stops_400m, stops_800m, round(min_stop_dist_m, 4) AS min_stop_dist_m, employment_proxy, round(route_km_800m, 6) AS route_km_800m, round(slope_mean, 6) AS slope_mean FROM master")
def cmp_master_suitability(s, d):
    return _master(s, d).withColumns({"min_stop_dist_m": F.round("min_stop_dist_m", 4), "slope_mean": F.round("slope_mean", 6), "route_km_800m": F.round("route_km_800m", 6)})


def _normalised(s, d):
    return siting.normalised(_master(s, d), ["ageb_id"])


@query(f"{_NORM} SELECT ageb_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NORMS)} FROM norm")
def cmp_max_normalise(s, d):
    return _normalised(s, d).withColumns({c: F.round(c, 6) for c in _NORMS})


_WEIGHTS = f"{_NORM}, {_sql_critic('norm', _NORMS)}, share AS (SELECT *, weight_unnormalized / sum(weight_unnormalized) OVER () AS w FROM weights)"


@query(f"{_WEIGHTS} SELECT feature, round(variance, 8) AS variance, round(avg_abs_correlation, 8) AS avg_abs_correlation, round(w, 8) AS weight, rank() OVER (ORDER BY weight_unnormalized DESC) AS feature_rank FROM share")
def cmp_critic_sql(s, d):
    w = weighting.critic(_normalised(s, d), _NORMS)
    return w.select("feature", F.round("variance", 8).alias("variance"), F.round("avg_abs_correlation", 8).alias("avg_abs_correlation"), F.round("weight_normalized", 8).alias("weight"), F.col("feature_rank").cast("bigint").alias("feature_rank"))


_AT_STOPS = f"""near AS (SELECT a.stop_id, count(DISTINCT b.stop_id) AS stops_400m FROM stops a JOIN stops b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 160000 GROUP BY 1),
jobs_near AS (SELECT stop_id, sum(jobs)::BIGINT AS employment_proxy FROM (SELECT DISTINCT s.stop_id, b.denue_id, b.jobs FROM stops s JOIN big b ON power(s.x - b.x, 2) + power(s.y - b.y, 2) <= 160000) GROUP BY 1)"""


@query(f"""WITH {_STOPS}, {_LOCATED}, {_EMPLOYERS}, {_AT_STOPS} SELECT stop_id, coalesce(stops_400m, 0) AS stops_400m, coalesce(employment_proxy, 0) AS employment_proxy
  FROM (SELECT DISTINCT stop_id FROM stops) LEFT JOIN near USING (stop_id) LEFT JOIN jobs_near USING (stop_id)""")
def cmp_stop_features(s, d):
    return zone_features.stop_features(_denue(s, d), _stops(s, d))


@query(f"""{_WEIGHTS}, {_AT_STOPS}, named AS (SELECT stop_id, max(stop_name) AS stop_name FROM gtfs_stops WHERE stop_id IS NOT NULL GROUP BY 1),
joined AS (SELECT i.stop_id, n.stop_name, i.ageb_id, coalesce(k.stops_400m, 0) AS stops_400m, m.stops_800m, m.min_stop_dist_m, coalesce(j.employment_proxy, 0) AS employment_proxy, m.route_km_800m, m.slope_mean
  FROM inside i JOIN named n USING (stop_id) LEFT JOIN near k USING (stop_id) LEFT JOIN jobs_near j USING (stop_id) JOIN master m USING (ageb_id)),
{_sql_normalised('joined', 'scaled', 'stop_id, ageb_id')},
scored AS (SELECT stop_id, ageb_id, round({' + '.join(f"{c} * (SELECT w FROM share WHERE feature = '{c}')" for c in _NORMS)}, 9) AS s FROM scaled)
SELECT stop_id, stop_name, ageb_id, stops_400m, stops_800m, round(min_stop_dist_m, 2) AS min_stop_dist_m, employment_proxy, round(route_km_800m, 2) AS route_km_800m, round(slope_mean, 3) AS slope_mean,
  round(s, 4) AS npv_score, rank() OVER (ORDER BY s DESC) AS npv_rank, round(100 * percent_rank() OVER (ORDER BY s), 6) AS npv_percentile FROM joined JOIN scored USING (stop_id, ageb_id)""")
def cmp_station_audit(s, d):
    master = _master(s, d)
    weights = weighting.critic(siting.normalised(master, ["ageb_id"]), _NORMS)
    return siting.station_audit(_stops(s, d), zone_features.stop_features(_denue(s, d), _stops(s, d)), siting.holding(_stops(s, d), _zones(s, d)), master, weights)


@query(f"""{_INSIDE_DENUE}, lab AS (SELECT i.ageb_id, {_sql_sector('scian_codigo')} AS sector, {_sql_jobs('estrato_personal')} AS jobs FROM inside i JOIN located USING (denue_id)),
per AS (SELECT ageb_id, count(*) AS n, sum(jobs)::BIGINT AS jobs, count(*) FILTER (WHERE sector = 'retail') AS retail, count(*) FILTER (WHERE sector IN ('health', 'education', 'government')) AS service FROM lab GROUP BY 1),
mix AS (SELECT ageb_id, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(c / t * ln(c / t)) END AS e FROM (SELECT ageb_id, sector, count(*) AS c, sum(count(*)) OVER (PARTITION BY ageb_id) AS t FROM lab GROUP BY 1, 2) GROUP BY 1),
size AS (SELECT cvegeo AS ageb_id, greatest(max({_AREA}) / 1e6, 0.01) AS km2 FROM ageb WHERE cvegeo IS NOT NULL GROUP BY 1)
SELECT ageb_id, round(coalesce(n, 0) / km2, 4) AS p_poi_density, coalesce(jobs, 0) AS p_employment_proxy, round(coalesce(retail, 0) / km2, 4) AS p_retail_density, round(coalesce(service, 0) / km2, 4) AS p_service_density, round(coalesce(e, 0), 6) AS p_land_use_mix
FROM size LEFT JOIN per USING (ageb_id) LEFT JOIN mix USING (ageb_id)""")
def cmp_place_features(s, d):
    f = zone_features.place_features(_denue(s, d), _zones(s, d), entropy)
    return f.withColumns({c: F.round(c, 4) for c in ("p_poi_density", "p_retail_density", "p_service_density")} | {"p_land_use_mix": F.round("p_land_use_mix", 6)})


_LABELS = f"""held AS (SELECT DISTINCT ageb_id FROM inside), both_ AS (SELECT a.ageb_id, stops_400m, stops_800m, employment_proxy, CASE WHEN h.ageb_id IS NULL THEN 0 ELSE 1 END AS label
  FROM access a LEFT JOIN emp e USING (ageb_id) LEFT JOIN held h USING (ageb_id) WHERE h.ageb_id IS NULL OR e.ageb_id IS NOT NULL),
tiles AS (SELECT *, ntile(4) OVER (PARTITION BY label ORDER BY stops_400m + stops_800m NULLS LAST, ageb_id) AS accessibility_quartile, ntile(4) OVER (PARTITION BY label ORDER BY employment_proxy NULLS LAST, ageb_id) AS employment_quartile FROM both_),
picked AS (SELECT *, row_number() OVER (PARTITION BY accessibility_quartile, employment_quartile ORDER BY md5('42|' || ageb_id)) AS k FROM tiles WHERE label = 0),
labels AS (SELECT ageb_id, label, stops_400m, stops_800m, employment_proxy, accessibility_quartile, employment_quartile, 'existing_station' AS stratum, 'suitable' AS label_str FROM tiles WHERE label = 1
  UNION ALL SELECT ageb_id, label, stops_400m, stops_800m, employment_proxy, accessibility_quartile, employment_quartile, 'underserved_q' || accessibility_quartile || '_' || employment_quartile, 'unsuitable'
  FROM picked WHERE k <= greatest(1, (SELECT count(*) FROM tiles WHERE label = 1) // 16))"""


@query(f"{_STOP_DISTANCES}, {_ACCESS}, {_LOCATED}, {_EMPLOYMENT}, {_LABELS} SELECT * FROM labels")
def cmp_training_labels(s, d):
    zones = _zones(s, d)
    return siting.training_labels(zone_features.zone_ids(zones), siting.holding(_stops(s, d), zones), zone_features.accessibility(_stops(s, d), zones), zone_features.employment(_denue(s, d), zones))


_KM2 = f"size AS (SELECT cvegeo AS ageb_id, greatest(max({_AREA}) / 1e6, 0.01) AS km2 FROM ageb WHERE cvegeo IS NOT NULL GROUP BY 1)"


def _km2(s, d):
    return _zones(s, d).where("cvegeo is not null").groupBy(F.col("cvegeo").alias("ageb_id")).agg((F.max(G.area(F.col("geom"))) / 1e6).alias("km2"))


@query(f"""WITH {_TOPO}, {_KM2}, census AS (SELECT ageb_id, count(*) AS pop, count(*) FILTER (WHERE estrato_personal = '0 a 5 personas') + count(*) FILTER (WHERE estrato_personal = '6 a 10 personas') AS dependent,
  count(*) FILTER (WHERE estrato_personal LIKE '11 a%') AS active, count(*) FILTER (WHERE scian_codigo LIKE '46%') AS youth FROM denue WHERE length(ageb_id) = 13 GROUP BY 1)
SELECT z.ageb_id, coalesce(pop, 0)::DOUBLE AS pe_population, round(coalesce(pop, 0) / km2, 4) AS pe_pop_density, round(coalesce(slope_mean, 0), 6) AS pe_marginacion, round(coalesce(-slope_mean, 0), 6) AS pe_rezago,
  round(least(coalesce(dependent, 0) / greatest(coalesce(active, 0), 1), 5), 6) AS pe_dep_ratio, round(coalesce(youth, 0) / greatest(coalesce(pop, 0), 1), 6) AS pe_youth_share
FROM size z LEFT JOIN census USING (ageb_id) LEFT JOIN topo USING (ageb_id)""")
def cmp_people_features(s, d):
    """Establishments stand for inhabitants, their size classes for ages, slopes for the indices."""
    units = _denue(s, d).where("length(ageb_id) = 13")
    n = lambda c: F.count_if(c).cast("string")
    kind = F.col("estrato_personal")
    census = units.groupBy("ageb_id").agg(
        F.count("*").cast("string").alias("POBTOT"), n(kind == "0 a 5 personas").alias("POB0_14"), n(kind == "6 a 10 personas").alias("POB65_MAS"), n(kind.like("11 a%")).alias("POB15_64"), n(F.col("scian_codigo").like("46%")).alias("P_15A29")
    ).select("*", F.lit("000").alias("MZA"), F.substring("ageb_id", 1, 2).alias("ENTIDAD"), F.substring("ageb_id", 3, 3).alias("MUN"), F.substring("ageb_id", 6, 4).alias("LOC"), F.substring("ageb_id", 10, 4).alias("AGEB"))
    indices = zone_features.slopes(T(s, d, "ageb_topography")).select(F.col("ageb_id").alias("cve_ageb"), F.col("slope_mean").alias("im_2020"), (-F.col("slope_mean")).alias("irs_2020"))
    f = zone_features.people_features(census, indices, _km2(s, d))
    return f.withColumns({c: F.round(c, 4 if c == "pe_pop_density" else 6) for c in f.columns if c != "ageb_id"})


@query("""WITH lights AS (SELECT ageb_id, quantile_cont(slope_mean, 0.5) AS m FROM ageb_topography WHERE slope_mean > 0 AND NOT isnan(slope_mean) GROUP BY 1),
rides AS (SELECT '14' || lpad((user_id % 130)::VARCHAR, 3, '0') AS municipality, sum(value) AS v FROM events WHERE year(ts) = 2024 AND event_type ILIKE '%purch%' GROUP BY 1)
SELECT z.ageb_id, round(coalesce(m, 0), 6) AS v_ntl_median, round(coalesce(v, 0), 4) AS v_ridership_annual FROM (SELECT DISTINCT cvegeo AS ageb_id FROM ageb WHERE cvegeo IS NOT NULL) z LEFT JOIN lights USING (ageb_id) LEFT JOIN rides ON municipality = left(z.ageb_id, 5)""")
def cmp_vitality_features(s, d):
    """Slopes stand for light, events for rides."""
    lights = T(s, d, "ageb_topography").where("slope_mean > 0 and not isnan(slope_mean)").groupBy("ageb_id").agg(F.median("slope_mean").alias("median"))
    rides = T(s, d, "events").select(F.year("ts").alias("anio"), F.col("event_type").alias("variable"), (F.col("user_id") % 130).alias("cve_mun"), F.col("value").alias("valor"))
    f = zone_features.vitality_features(lights, rides, _zones(s, d), 2024, "%purch%")
    return f.select("ageb_id", F.round("v_ntl_median", 6).alias("v_ntl_median"), F.round("v_ridership_annual", 4).alias("v_ridership_annual"))


_CHECKED = ["stops_800m", "min_stop_dist_m", "employment_proxy", "route_km_800m", "slope_mean"]


def _sql_checks() -> str:
    spread = lambda c: " UNION ALL ".join(f"SELECT '{c}_{f}', {g}({c})::DOUBLE FROM master" for f, g in (("min", "min"), ("max", "max"), ("avg", "avg"), ("std", "stddev_pop")))
    nulls = " UNION ALL ".join(f"SELECT 'null_{c}', count(*) FILTER (WHERE {c} IS NULL)::DOUBLE FROM master" for c in _CHECKED)
    return f"""{_WEIGHTS}, {_LABELS}, checks(name, value) AS (SELECT 'stops', count(*)::DOUBLE FROM gtfs_stops UNION ALL SELECT 'zones', count(DISTINCT cvegeo) FROM ageb UNION ALL SELECT 'audited', count(*) FROM (SELECT DISTINCT stop_id, ageb_id FROM inside) JOIN master USING (ageb_id)
      UNION ALL SELECT 'weights', count(*) FROM weights UNION ALL SELECT 'weights_sum', sum(w) FROM share UNION ALL SELECT 'top_weight', max(w) FROM share UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'labelled_zones', count(DISTINCT ageb_id) FROM labels
      UNION ALL SELECT 'repeated_labels', count(*) - count(DISTINCT ageb_id) FROM labels UNION ALL SELECT 'label_' || label, count(*) FROM labels GROUP BY label UNION ALL SELECT 'master', count(*) FROM master UNION ALL {nulls} UNION ALL {spread('stops_800m')} UNION ALL {spread('min_stop_dist_m')} UNION ALL {spread('employment_proxy')}
      UNION ALL SELECT 'corr_stops_employment', corr(stops_800m, employment_proxy) FROM master UNION ALL SELECT 'corr_stops_routes', corr(stops_800m, route_km_800m) FROM master) SELECT name, round(value, 6) AS value FROM checks"""


@query(_sql_checks())
def cmp_db_checks(s, d):
    """The sanity checks of the base and derived tables, a row each."""
    master = _master(s, d)
    zones, labels, held = _zones(s, d), cmp_training_labels(s, d), siting.holding(_stops(s, d), _zones(s, d))
    weights = weighting.critic(siting.normalised(master, ["ageb_id"]), _NORMS)
    named = lambda **values: F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()])).alias("_r")
    stats = {f"{c}_{f}": g(c) for c in _CHECKED[:3] for f, g in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))}
    of_master = {"master": F.count("*"), **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in _CHECKED}, **stats,
                 "corr_stops_employment": safe_corr(F.col("stops_800m"), F.col("employment_proxy")), "corr_stops_routes": safe_corr(F.col("stops_800m"), F.col("route_km_800m"))}
    parts = [
        (_stops(s, d), {"stops": F.count("*")}), (zones, {"zones": F.count_distinct("cvegeo")}), (held.select("stop_id", "ageb_id").distinct().join(master, "ageb_id"), {"audited": F.count("*")}),
        (weights, {"weights": F.count("*"), "weights_sum": F.sum("weight_normalized"), "top_weight": F.max("weight_normalized")}), (master, of_master),
        (labels, {"labels": F.count("*"), "labelled_zones": F.count_distinct("ageb_id"), "repeated_labels": F.count("*") - F.count_distinct("ageb_id"), "label_0": F.count_if(F.col("label") == 0), "label_1": F.count_if(F.col("label") == 1)}),
    ]
    rows = []
    for df, values in parts:
        one = df.agg(*[v.alias(k) for k, v in values.items()])
        rows.append(one.select(named(**{k: F.col(k) for k in values})).select("_r.name", F.round("_r.value", 6).alias("value")))
    return reduce(DataFrame.unionByName, rows)


# --- weights over the sixteen indicators -----------------------------------------------------------------------------

_SIXTEEN = [
    "n_intersections_n", "n_street_density_n", "n_intersection_density_n", "p_poi_density_n", "p_employment_proxy_n", "p_retail_density_n", "p_service_density_n", "p_land_use_mix_n",
    "pe_population_n", "pe_pop_density_n", "pe_marginacion_n", "pe_rezago_n", "pe_dep_ratio_n", "pe_youth_share_n", "v_ntl_median_n", "v_ridership_annual_n",
]
_DIMENSIONS = {"n": "NODE", "p": "PLACE", "pe": "PEOPLE", "v": "VITALITY"}
_FILLED = "f AS (SELECT profile_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _SIXTEEN) + " FROM cluster_profiles)"
_EWM = f"""ent AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, 1 - (ln(sum({c} + 1e-6)) - sum(({c} + 1e-6) * ln({c} + 1e-6)) / sum({c} + 1e-6)) / ln(count(*)) AS d FROM f" for c in _SIXTEEN)}),
ewm AS (SELECT feature, d / sum(d) OVER () AS w FROM ent)"""
_CON = f"""con AS ({" UNION ALL ".join(f"SELECT '{a}' AS feature, stddev_samp({a}) * ({' + '.join(f'coalesce(1 - corr({min(a, b)}, {max(a, b)}), 0)' for b in _SIXTEEN if b != a)}) AS c FROM f" for a in _SIXTEEN)}),
crit AS (SELECT feature, c / sum(c) OVER () AS w FROM con)"""


def _sixteen(s, d):
    return T(s, d, "cluster_profiles").select("profile_id", *_SIXTEEN).na.fill(0.0)


@query(f"WITH {_FILLED}, {_CON} SELECT feature, round(w, 6) AS w FROM crit")
def cmp_critic_py(s, d):
    return weighting.critic_contrast(_sixteen(s, d), _SIXTEEN).select("feature", F.round("critic_weight", 6).alias("w"))


@query(f"WITH {_FILLED}, {_EWM} SELECT feature, round(w, 6) AS w FROM ewm")
def cmp_ewm(s, d):
    return weighting.entropy_weights(_sixteen(s, d), _SIXTEEN).select("feature", F.round("ewm_weight", 6).alias("w"))


@query(f"WITH {_FILLED}, {_EWM}, {_CON} SELECT feature, CASE split_part(feature, '_', 1) WHEN 'n' THEN 'NODE' WHEN 'p' THEN 'PLACE' WHEN 'pe' THEN 'PEOPLE' ELSE 'VITALITY' END AS dimension, round((e.w + c.w) / 2, 6) AS w FROM ewm e JOIN crit c USING (feature)")
def cmp_ensemble(s, d):
    return weighting.ensemble(_sixteen(s, d), _SIXTEEN, _DIMENSIONS).select("feature", "dimension", F.round("ensemble_weight", 6).alias("w"))


@query(f"WITH {_FILLED} SELECT profile_id, " + ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 8) AS {c}" for c in _SIXTEEN) + " FROM f")
def cmp_minmax(s, d):
    return weighting.minmax(T(s, d, "cluster_profiles").select("profile_id", *_SIXTEEN), _SIXTEEN).withColumns({c: F.round(c, 8) for c in _SIXTEEN})


@query(f"WITH {_FILLED}, {_EWM} SELECT profile_id, " + ", ".join(f"round({c} * (SELECT w FROM ewm WHERE feature = '{c}'), 8) AS {c}" for c in _SIXTEEN) + " FROM f")
def cmp_apply_weights(s, d):
    weights = weighting.entropy_weights(_sixteen(s, d), _SIXTEEN)
    wide = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "ewm_weight"))).alias("w"))  # one row of sixteen entries
    return _sixteen(s, d).crossJoin(F.broadcast(wide)).select("profile_id", *[F.round(F.col(c) * F.try_element_at("w", F.lit(c)), 8).alias(c) for c in _SIXTEEN])


# --- quality of scores -----------------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT run_id, class_lgbm::INT AS y, score_rf AS p FROM ageb_suitability_predictions WHERE class_lgbm IS NOT NULL AND score_rf IS NOT NULL AND NOT isnan(score_rf)), steps AS (SELECT run_id, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2), cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY run_id) AS P_, sum(n) OVER (PARTITION BY run_id) AS N_ FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY p DESC))"


def _scored(s, d):
    return T(s, d, "ageb_suitability_predictions").select("run_id", F.col("class_lgbm").cast("int").alias("y"), F.col("score_rf").alias("p"))


@query(f"WITH {_SCORED} SELECT run_id, max(N_)::BIGINT AS n, max(P_)::BIGINT AS positives, round(sum(pos * tp / seen) / nullif(max(P_), 0), 8) AS ap FROM cum GROUP BY run_id")
def mtr_ap(s, d):
    return metrics.ranking_metrics(_scored(s, d), ["run_id"], "y", "p").select("run_id", "n", "positives", F.round("ap", 8).alias("ap"))


@query(f"WITH {_SCORED}, ranked AS (SELECT run_id, y, rank() OVER (PARTITION BY run_id ORDER BY p) + (count(*) OVER (PARTITION BY run_id, p) - 1) / 2 AS r FROM s) SELECT run_id, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 8) AS auc FROM ranked GROUP BY run_id")
def mtr_roc_auc(s, d):
    return metrics.ranking_metrics(_scored(s, d), ["run_id"], "y", "p").select("run_id", F.round("auc", 8).alias("auc"))


@query(f"WITH {_SCORED}, f AS (SELECT run_id, p, CASE WHEN tp > 0 THEN 2 * tp / (seen + P_) ELSE 0 END AS f1 FROM cum) SELECT run_id, threshold, round(f1, 8) AS f1 FROM (SELECT run_id, p AS threshold, f1, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, p) AS k FROM f) WHERE k = 1")
def mtr_best_f1_threshold(s, d):
    return metrics.best_f1(_scored(s, d), ["run_id"], "y", "p").select("run_id", "threshold", F.round("f1", 8).alias("f1"))


@query("WITH c AS (SELECT run_id, count(*) FILTER (WHERE class_lgbm = 1 AND class_rf = 1) AS tp, count(*) FILTER (WHERE class_lgbm <> 1 AND class_rf = 1) AS fp, count(*) FILTER (WHERE class_lgbm = 1 AND class_rf <> 1) AS fn, count(*) AS n FROM ageb_suitability_predictions WHERE class_lgbm IS NOT NULL AND class_rf IS NOT NULL GROUP BY 1) SELECT run_id, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, round((n - fp - fn) / n, 8) AS accuracy FROM c")
def mtr_f1_p_r(s, d):
    m = metrics.binary_metrics(T(s, d, "ageb_suitability_predictions").select("run_id", "class_lgbm", "class_rf"), ["run_id"], "class_lgbm", "class_rf")
    return m.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1", "accuracy")})


@query("""WITH s AS (SELECT run_id, class_lgbm AS y, class_rf AS p FROM ageb_suitability_predictions WHERE class_lgbm IS NOT NULL AND class_rf IS NOT NULL), k AS (SELECT run_id, y AS c FROM s UNION SELECT run_id, p FROM s),
m AS (SELECT k.run_id, k.c, count(*) FILTER (WHERE y = c AND p = c) AS h, count(*) FILTER (WHERE y = c) AS t, count(*) FILTER (WHERE p = c) AS q FROM k JOIN s USING (run_id) GROUP BY 1, 2)
SELECT run_id, round(sum(h) / sum(t), 8) AS accuracy, round(avg(coalesce(h / nullif(q, 0), 0)), 8) AS macro_precision, round(avg(coalesce(h / nullif(t, 0), 0)), 8) AS macro_recall, round(avg(coalesce(2 * h / nullif(t + q, 0), 0)), 8) AS macro_f1 FROM m GROUP BY run_id""")
def mtr_macro(s, d):
    m = metrics.macro_metrics(T(s, d, "ageb_suitability_predictions").select("run_id", "class_lgbm", "class_rf"), ["run_id"], "class_lgbm", "class_rf")
    return m.withColumns({c: F.round(c, 8) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")})


@query(f"""WITH r AS (SELECT profile_id AS k, cluster_id AS c, [{", ".join(_SIXTEEN)}] AS at FROM cluster_profiles WHERE cluster_id IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _SIXTEEN)}),
d AS (SELECT x.k, x.c, y.c AS o, sum(list_distance(x.at, y.at)) AS d, count(*) AS n FROM r x CROSS JOIN r y GROUP BY 1, 2, 3),
s AS (SELECT k, max(CASE WHEN c = o AND n > 1 THEN d / (n - 1) END) AS a, min(CASE WHEN c <> o THEN d / n END) AS b FROM d GROUP BY k)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 8) AS silhouette FROM s""")
def mtr_silhouette(s, d):
    """By definition of all pairs: for tables of the size of the study area's."""
    return metrics.silhouette(T(s, d, "cluster_profiles"), "profile_id", "cluster_id", _SIXTEEN).select(F.round("silhouette", 8).alias("silhouette"))


@query("WITH a AS (SELECT run_id, avg(score_rf) AS x, avg(score_lgbm) AS y FROM ageb_suitability_predictions WHERE NOT isnan(score_rf) AND NOT isnan(score_lgbm) GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM a) SELECT round(corr(rx, ry), 8) AS rho, count(*) AS n FROM r")
def xai_spearman(s, d):
    """Rank correlation over one row per run."""
    per = T(s, d, "ageb_suitability_predictions").where(~F.isnan("score_rf") & ~F.isnan("score_lgbm")).groupBy("run_id").agg(F.avg("score_rf").alias("x"), F.avg("score_lgbm").alias("y"))
    r = per.select(F.rank().over(Window.orderBy("x")).alias("rx"), F.rank().over(Window.orderBy("y")).alias("ry"))
    return r.agg(F.round(safe_corr(F.col("rx"), F.col("ry")), 8).alias("rho"), F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT run_id, ageb_id, score_rf, threshold_rf FROM ageb_suitability_predictions WHERE score_rf IS NOT NULL AND NOT isnan(score_rf)) SELECT run_id, min(score_rf) AS lo, max(score_rf) AS hi, round(avg(score_rf), 8) AS mean, round(avg(CASE WHEN score_rf >= threshold_rf THEN 1.0 ELSE 0.0 END), 8) AS rate FROM p GROUP BY run_id")
def cmp_predict_surface(s, d):
    p = T(s, d, "ageb_suitability_predictions").where("score_rf is not null and not isnan(score_rf)").select("run_id", "ageb_id", "score_rf", "threshold_rf").distinct()
    rate = F.avg(F.when(F.col("score_rf") >= F.col("threshold_rf"), 1.0).otherwise(0.0))
    return p.groupBy("run_id").agg(F.min("score_rf").alias("lo"), F.max("score_rf").alias("hi"), F.round(F.avg("score_rf"), 8).alias("mean"), F.round(rate, 8).alias("rate"))




# --- further composites ----------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT cvegeo, cve_mun, geom.srid AS srid FROM ageb WHERE cve_ent = '14' AND cve_ageb NOT LIKE '%A%' AND cve_mun IN {MUNICIPALITIES}")
def cmp_base_ageb(s, d):
    keep = F.col("cve_mun").isin(*MUNICIPALITIES)
    return _zones(s, d).where((F.col("cve_ent") == "14") & ~F.col("cve_ageb").like("%A%") & keep).select("cvegeo", "cve_mun", F.col("geom.srid").alias("srid")).distinct()


@query(f"WITH {_SHAPES} SELECT shape, 'gtfs' AS source, count(*) AS points FROM shapes GROUP BY shape HAVING count(*) > 1 UNION ALL SELECT 'L4', 'line', 2")
def cmp_transit_routes(s, d):
    mine = _lines(s, d).where(F.size("line") > 1).select("shape", F.lit("gtfs").alias("source"), F.size("line").cast("bigint").alias("points")).distinct()
    return mine.unionByName(s.range(1).select(F.lit("L4").alias("shape"), F.lit("line").alias("source"), F.lit(2).cast("bigint").alias("points")))


def _supply(s, d):
    return line_supply.route_supply(_lines(s, d), "shape", "line", _zones(s, d), "cvegeo", "geom", 800.0)


@query(f"WITH {_ZONES}, {_ROUTES} SELECT ageb_id AS region, round(km, 6) AS route_km_within_800m FROM supply")
def cmp_route_supply(s, d):
    """Kilometres of lines within 800 m of each zone."""
    return _supply(s, d).withColumn("route_km_within_800m", F.round("route_km_within_800m", 6))


@query(f"{_STOP_DISTANCES}, {_ACCESS}, {_ROUTES} SELECT a.ageb_id, stops_400m, stops_800m, round(min_stop_dist_m, 4) AS min_stop_dist_m, round(coalesce(km, 0), 6) AS route_km_within_800m FROM access a LEFT JOIN supply USING (ageb_id)")
def cmp_features_transport(s, d):
    supply = _supply(s, d).withColumnRenamed("region", "ageb_id")
    joined = zone_features.accessibility(_stops(s, d), _zones(s, d)).join(supply, "ageb_id", "left").na.fill(0.0, ["route_km_within_800m"])
    return joined.withColumns({"min_stop_dist_m": F.round("min_stop_dist_m", 4), "route_km_within_800m": F.round("route_km_within_800m", 6)})


@query(f"""WITH {_SHAPES}, seg AS (SELECT shape || '|' || o AS edge, (x + px) / 2 AS x, (y + py) / 2 AS y, sqrt(power(x - px, 2) + power(y - py, 2)) AS l FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM shapes WINDOW w AS (PARTITION BY shape ORDER BY o)) WHERE px IS NOT NULL),
nodes AS (SELECT o AS node, x, y, length(o) % 6 AS street_count FROM shapes), {_ZONES}, {_inside('nodes', 'node').replace('inside AS', 'at_nodes AS')}, {_inside('seg', 'edge').replace('inside AS', 'at_edges AS')},
n AS (SELECT ageb_id, count(*) AS n, count(*) FILTER (WHERE street_count >= 4) AS n4 FROM at_nodes JOIN (SELECT DISTINCT node, street_count FROM nodes) USING (node) GROUP BY 1), e AS (SELECT ageb_id, sum(l) AS l FROM at_edges JOIN seg USING (edge) GROUP BY 1),
size AS (SELECT cvegeo AS ageb_id, greatest(max({_AREA}) / 1e6, 0.01) AS km2 FROM ageb WHERE cvegeo IS NOT NULL GROUP BY 1)
SELECT ageb_id, round(coalesce(n, 0) / km2, 4) AS n_intersections, round(coalesce(n4, 0) / km2, 4) AS n_intersection_density, round(coalesce(l, 0) / km2, 2) AS n_street_density FROM size LEFT JOIN n USING (ageb_id) LEFT JOIN e USING (ageb_id)""")
def cmp_node_features(s, d):
    """Stops stand for crossings and the steps between them for streets."""
    order = F.concat("stop_id", F.lit("|"), F.lpad(F.col("x").cast("string"), 12, " "))
    nodes = zone_features.stop_points(_stops(s, d)).select(order.alias("node"), "x", "y", (F.length(order) % 6).alias("street_count"), F.left("stop_id", F.lit(2)).alias("shape"))
    w = Window.partitionBy("shape").orderBy("node")
    steps = nodes.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px is not null")
    edges = steps.select(F.concat("shape", F.lit("|"), "node").alias("edge"), F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")).alias("length"), ((F.col("x") + F.col("px")) / 2).alias("x"), ((F.col("y") + F.col("py")) / 2).alias("y"))
    f = zone_features.node_features(nodes.drop("shape"), edges, _zones(s, d))
    return f.withColumns({"n_intersections": F.round("n_intersections", 4), "n_intersection_density": F.round("n_intersection_density", 4), "n_street_density": F.round("n_street_density", 2)})


_FRAME = ["stops_800m", "min_stop_dist_m", "employment_proxy", "route_km_800m", "slope_mean"]


@query(f"{_MASTER}, {_LABELS} SELECT ageb_id, label, label_str, l.stops_400m::DOUBLE AS stops_400m, {', '.join(f'round(coalesce(m.{c}, 0), 4) AS {c}' for c in _FRAME)} FROM labels l JOIN master m USING (ageb_id)")
def cmp_training_frame(s, d):
    """The labelled zones of the master table with its criteria as numbers, 0 where there is none."""
    return _frame(s, d).withColumns({c: F.round(c, 4) for c in _FRAME})


def _frame(s, d):
    joined = cmp_training_labels(s, d).select("ageb_id", "label", "label_str", F.col("stops_400m").cast("double").alias("stops_400m")).join(_master(s, d).drop("stops_400m"), "ageb_id")
    return joined.select("ageb_id", "label", "label_str", "stops_400m", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _FRAME])


_CRITERIA = ["stops_400m", *_FRAME]
_FRAME_SQL = f"""{_MASTER}, {_LABELS}, frame AS (SELECT ageb_id, label, l.stops_400m::DOUBLE AS stops_400m, {', '.join(f'coalesce(m.{c}, 0)::DOUBLE AS {c}' for c in _FRAME)} FROM labels l JOIN master m USING (ageb_id))"""


@query(f"""{_FRAME_SQL}, parted AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(ageb_id), ageb_id) <= round(count(*) OVER (PARTITION BY label) * 0.2) AS held, {', '.join(f'round({c}, 6) AS r_{c}' for c in _CRITERIA)} FROM frame)
SELECT (SELECT count(*) FROM (SELECT {', '.join(f'r_{c}' for c in _CRITERIA)} FROM parted WHERE NOT held INTERSECT SELECT {', '.join(f'r_{c}' for c in _CRITERIA)} FROM parted WHERE held)) AS shared_vectors,
  (SELECT count(*) FROM (SELECT 1 FROM parted GROUP BY {', '.join(f'r_{c}' for c in _CRITERIA)} HAVING count(DISTINCT label) > 1)) AS conflicting_vectors, count(ageb_id) - count(DISTINCT ageb_id) AS repeated_keys, round(avg(label), 8) AS positive_rate FROM parted""")
def cmp_leakage(s, d):
    """The training frame against its held-out fifth."""
    frame = stratified_split(_frame(s, d).withColumns({c: F.round(c, 6) for c in _CRITERIA}), "label", "ageb_id", 0.2)
    return models.leakage_report(frame.where("not held").drop("held"), frame.where("held").drop("held"), "ageb_id", _CRITERIA, "label").withColumn("positive_rate", F.round("positive_rate", 8))


@query(f"""{_FRAME_SQL}, sides AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, '{d}' AS direction, round({s}{c}, 6) AS v, label FROM frame" for c in ("stops_400m", *_FRAME) for d, s in (("positive", ""), ("negative", "-")))}),
per AS (SELECT feature, direction, v, sum(label) AS p, count(*) AS n FROM sides GROUP BY 1, 2, 3), run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY feature, direction) AS pos FROM per WINDOW w AS (PARTITION BY feature, direction ORDER BY v DESC)),
ap AS (SELECT feature, direction, sum(p * tp / seen) / max(pos) AS ap FROM run GROUP BY 1, 2), best AS (SELECT feature, max(ap) AS best_pr_auc FROM ap GROUP BY 1)
SELECT b.feature, max(a.direction) AS best_direction, round(b.best_pr_auc, 8) AS best_pr_auc, b.best_pr_auc > 0.98 AS flagged FROM best b JOIN ap a ON a.feature = b.feature AND a.ap = b.best_pr_auc GROUP BY b.feature, b.best_pr_auc""")
def cmp_leakage_univariate(s, d):
    """How well each criterion alone ranks the labels."""
    return models.univariate(_frame(s, d).withColumns({c: F.round(c, 6) for c in _CRITERIA}), _CRITERIA, "label").withColumn("best_pr_auc", F.round("best_pr_auc", 8))


@query(f"SELECT cluster_id, count(*) AS size, {', '.join(f'round(avg({c}), 8) AS {c}' for c in _SIXTEEN)}, 'Typology ' || chr(65 + cluster_id) AS typology_name FROM cluster_profiles WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def cmp_cluster_profiles(s, d):
    found = models.cluster_profiles(T(s, d, "cluster_profiles").where("cluster_id is not null"), _SIXTEEN)
    return found.withColumns({c: F.round(c, 8) for c in _SIXTEEN})


@query(f"""WITH {_FILLED}, {_EWM}, m AS ({" UNION ALL ".join(f"SELECT cluster_id, '{c}' AS feature, round(avg({c}), 10) AS v FROM cluster_profiles WHERE cluster_id IS NOT NULL GROUP BY 1" for c in _SIXTEEN)}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY v DESC, feature) AS k FROM m) SELECT cluster_id, k, feature, round(w, 6) AS w FROM r JOIN ewm USING (feature) WHERE k <= 3""")
def cmp_phase5_drivers(s, d):
    """The three leading features of each class with their weights, joined by exact name."""
    means = T(s, d, "cluster_profiles").where("cluster_id is not null").groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in _SIXTEEN])
    long = means.select("cluster_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 10).alias("v")) for c in _SIXTEEN])).alias("r")).select("cluster_id", "r.*")
    top = long.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("v"), "feature"))).where("k <= 3")
    return top.join(weighting.entropy_weights(_sixteen(s, d), _SIXTEEN), "feature").select("cluster_id", F.col("k").cast("bigint").alias("k"), "feature", F.round("ewm_weight", 6).alias("w"))


def _rows(s, rows: list[dict]) -> DataFrame:
    """A row per fold or model."""
    return s.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def _forest(rows, trees: int = 300):
    return models.random_forest(rows, _CRITERIA, "label", trees=trees)


def _kept_frame(s, d):
    # one partition: a few hundred rows, which every level of every tree reads
    return checkpointed(_frame(s, d).coalesce(1))


@query(None)
def ml_rf_binary(s, d):
    """The forest over the training frame: its quality in five stratified folds."""
    return _rows(s, models.cross_validated(_kept_frame(s, d), "ageb_id", "label", _CRITERIA, _forest))


@query(None)
def ml_lgbm_binary(s, d):
    """Boosted trees over four fifths of the training frame, judged by the fifth that was held out."""
    frame = checkpointed(stratified_split(_frame(s, d), "label", "ageb_id", 0.2).coalesce(1))
    train, test = frame.where("not held"), frame.where("held")
    model = models.boosted(train, _CRITERIA, "label")
    return _rows(s, [{"model": "boosted", **models.evaluated(model, test, _CRITERIA, "label", models.best_threshold(model, train, _CRITERIA, "label"))}])


@query(None)
def ml_label_shuffle(s, d):
    """Mean average precision of the forest where the labels were dealt out anew, and whether that is suspicious."""
    frame = checkpointed(models.shuffled_labels(_kept_frame(s, d), "ageb_id", "label").coalesce(1))
    found = models.cross_validated(frame, "ageb_id", "label", _CRITERIA, _forest, folds=3)
    mean, rate = sum(r["pr_auc"] for r in found) / 3, frame.agg(F.avg("label")).first()[0]
    return _rows(s, [{"model": "random_forest", "mean_pr_auc": mean, "positive_rate": rate, "flagged": mean > max(rate + 0.12, 0.65)}])


@query(None)
def ml_predict_surface(s, d):
    """Every zone of the master table scored by the forest, and its class at the forest's best threshold."""
    frame = _kept_frame(s, d)
    model = _forest(frame)
    threshold = models.best_threshold(model, frame, _CRITERIA, "label")
    clean = _master(s, d).na.fill(0)
    return models.scored(model, clean, _CRITERIA).select("ageb_id", "score", (F.col("score") >= threshold).cast("int").alias("class"), F.lit(threshold).alias("threshold"))


@query(f"{_FRAME_SQL} SELECT count(*) AS n, true AS adds_up FROM frame")
def xai_tree_shap(s, d):
    """Whether base and contributions add up to the forest's score in every row."""
    frame = _kept_frame(s, d)
    model = _forest(frame)
    both = models.explained(model, frame, "ageb_id", _CRITERIA).join(models.scored(model, frame, _CRITERIA).select("ageb_id", "score"), "ageb_id")
    total = sum((F.col(c) for c in _CRITERIA), F.col("base"))
    return both.agg(F.count("*").alias("n"), F.bool_and(F.abs(total - F.col("score")) < 1e-9).alias("adds_up"))


@query(None)
def cmp_shap_vs_critic(s, d):
    """Mean contributions of forest and boosted trees beside the criterion weights, joined by name: criteria that enter the
    weights inverted have other names there and drop out."""
    frame = _kept_frame(s, d)
    found = [models.importance(models.explained(m, frame, "ageb_id", _CRITERIA, value), _CRITERIA) for m, value in ((_forest(frame), 1), (models.boosted(frame, _CRITERIA, "label", rounds=BOOSTED_HERE), None))]
    return models.against_weights(found, weighting.critic(_normalised(s, d), _NORMS))


#: Rounds of the boosted model whose contributions are only ranked.
BOOSTED_HERE = 100


def _typed(s, d):
    clean = T(s, d, "cluster_profiles").select("profile_id", *_SIXTEEN).na.fill(0.0)
    return clean, checkpointed(models.kmeans(clean, _SIXTEEN, 4).select("profile_id", "cluster_id", *_SIXTEEN))


@query(None)
def ml_kmeans(s, d):
    return _typed(s, d)[1].select("profile_id", "cluster_id")


@query(None)
def ml_rf_multi(s, d):
    """A forest over the typologies that clustering found: means of five stratified folds."""
    found = models.cross_validated_forest(_typed(s, d)[1], "profile_id", "cluster_id", _SIXTEEN)
    return _rows(s, [{"model": "random_forest", **found}])


@query(None)
def xai_class_drivers(s, d):
    """The ten leading features of a forest of the typologies, and the three leading ones of each typology."""
    typed = _typed(s, d)[1]
    model = models.forest_of_classes(typed, "profile_id", "cluster_id", _SIXTEEN, trees=60, depth=8)
    per = models.class_importance(model, typed, "profile_id", _SIXTEEN, {k: f"Typology {chr(65 + k)}" for k in range(4)})
    placed = per.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mean_abs_shap"), "feature")))  # sixteen rows a class
    return placed.where("place <= 3 or (class = 'total' and place <= 10)")


@query("SELECT count(*) AS n, true AS uncorrelated, true AS descending, true AS within_total FROM cluster_profiles")
def ml_pca2(s, d):
    """What two principal components must hold: no correlation, the first spread no less, both within the total spread."""
    clean = T(s, d, "cluster_profiles").select("profile_id", *_SIXTEEN).na.fill(0.0)
    found, shares = models.principal_components(clean, _SIXTEEN)
    one = found.agg(F.count("*").alias("n"), F.covar_samp("pc1", "pc2").alias("c"), F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), sum((F.var_samp(c) for c in _SIXTEEN), F.lit(0.0)).alias("all"))
    near = F.abs(F.col("v1") / F.col("all") - shares[0]) + F.abs(F.col("v2") / F.col("all") - shares[1]) < 1e-9
    return one.select("n", (F.abs("c") < 1e-9).alias("uncorrelated"), (F.col("v1") >= F.col("v2")).alias("descending"), (near & (F.col("v1") + F.col("v2") <= F.col("all"))).alias("within_total"))
