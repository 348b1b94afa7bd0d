"""Measures and parts of geometries as native column expressions.

A geometry is struct<kind, srid, rings: polygons -> rings -> points, bbox>; a line is an array of points.  Rings may or
may not repeat their first point and may run either way; the first ring of a polygon is the outer one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a ring, by cross products of its edges around its first point (which keeps digits)."""
    x0, y0, n = ring[0]["x"], ring[0]["y"], F.size(ring)
    steps = F.transform(ring, lambda p, i: (p["x"] - x0) * (F.get(ring, (i + 1) % n)["y"] - y0) - (F.get(ring, (i + 1) % n)["x"] - x0) * (p["y"] - y0))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def area(geom: Column) -> Column:
    """Area of all polygons, their holes left out."""
    per_ring = lambda r, i: F.when(i == 0, F.abs(ring_area2(r))).otherwise(-F.abs(ring_area2(r)))
    per_polygon = F.flatten(F.transform(geom["rings"], lambda p: F.transform(p, per_ring)))
    return F.aggregate(per_polygon, F.lit(0.0), lambda a, b: a + b) / 2


def line_length(points: Column) -> Column:
    steps = F.transform(points, lambda p, i: F.when(i == 0, 0.0).otherwise(F.hypot(p["x"] - F.get(points, i - 1)["x"], p["y"] - F.get(points, i - 1)["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)


def perimeter(geom: Column) -> Column:
    closed = lambda r: line_length(F.concat(r, F.array(r[0])))
    return F.aggregate(F.flatten(F.transform(geom["rings"], lambda p: F.transform(p, closed))), F.lit(0.0), lambda a, b: a + b)


def points_of(geom: Column) -> Column:
    """All points of a geometry, ring after ring."""
    return F.flatten(F.flatten(geom["rings"]))


def boundary(geom: Column) -> Column:
    """The rings as lines."""
    return F.flatten(geom["rings"])


def bbox(geom: Column) -> Column:
    """The box as stored, or measured where none is."""
    p = points_of(geom)
    measured = F.struct(
        F.array_min(p["x"]).alias("xmin"), F.array_min(p["y"]).alias("ymin"), F.array_max(p["x"]).alias("xmax"), F.array_max(p["y"]).alias("ymax")
    )
    return F.coalesce(geom["bbox"], measured)


def multi(polygon: Column) -> Column:
    """A polygon (rings) as a multipolygon (polygons)."""
    return F.array(polygon)


def make_line(order: Column, x: Column, y: Column) -> Column:
    """Aggregate: the points of a group in `order` as a line; the lines of a source are bounded by its shapes."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x"), y.alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def interpolate(points: Column, share: float = 0.5) -> Column:
    """The point at `share` of a line's length; the first point of a line without length."""
    seg = F.transform(points, lambda p, i: F.when(i == 0, 0.0).otherwise(F.hypot(p["x"] - F.get(points, i - 1)["x"], p["y"] - F.get(points, i - 1)["y"])))
    total = F.aggregate(seg, F.lit(0.0), lambda a, b: a + b) * share
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("i"), points[0]["x"].alias("x"), points[0]["y"].alias("y"), F.lit(False).alias("found"))

    def step(a: Column, d: Column) -> Column:
        p, q = F.get(points, a["i"] - 1), F.get(points, a["i"])
        here = (~a["found"]) & (d > 0) & (a["done"] + d >= total)
        t = (total - a["done"]) / F.when(d > 0, d)
        return F.struct(
            (a["done"] + d).alias("done"), (a["i"] + 1).alias("i"),
            F.when(here, p["x"] + (q["x"] - p["x"]) * t).otherwise(a["x"]).alias("x"),
            F.when(here, p["y"] + (q["y"] - p["y"]) * t).otherwise(a["y"]).alias("y"), (a["found"] | here).alias("found"),
        )

    end = F.aggregate(seg, start, step)
    return F.struct(end["x"].alias("x"), end["y"].alias("y"))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against every polygon (holes excluded), inside one expression; edges are undefined."""

    def crossed(ring: Column) -> Column:
        n = F.size(ring)
        hits = F.transform(
            ring,
            lambda p, i: F.when(
                ((p["y"] > y) != (F.get(ring, (i + 1) % n)["y"] > y))
                & (x < (F.get(ring, (i + 1) % n)["x"] - p["x"]) * (y - p["y"]) / F.when(F.get(ring, (i + 1) % n)["y"] != p["y"], F.get(ring, (i + 1) % n)["y"] - p["y"]) + p["x"]), 1
            ).otherwise(0),
        )
        return F.aggregate(hits, F.lit(0), lambda a, b: a + b)

    return F.exists(geom["rings"], lambda poly: F.aggregate(F.transform(poly, crossed), F.lit(0), lambda a, b: a + b) % 2 == 1)


def geojson(geom: Column) -> Column:
    """A multipolygon as a GeoJSON geometry, every ring closed."""
    closed = lambda r: F.when((r[0]["x"] == F.get(r, F.size(r) - 1)["x"]) & (r[0]["y"] == F.get(r, F.size(r) - 1)["y"]), r).otherwise(F.concat(r, F.array(r[0])))
    coordinates = F.transform(geom["rings"], lambda p: F.transform(p, lambda r: F.transform(closed(r), lambda q: F.array(q["x"], q["y"]))))
    return F.when(geom["rings"].isNotNull(), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))))


def edges(geom: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of all rings, each edge from its lesser to its greater end, closed rings or not;
    edges without length are left out."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def edge(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % n)
            first = (p["x"] < q["x"]) | ((p["x"] == q["x"]) & (p["y"] < q["y"]))
            a, b = (F.when(first, p).otherwise(q), F.when(first, q).otherwise(p))
            return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

        return F.filter(F.transform(ring, edge), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))

    return F.flatten(F.transform(F.flatten(geom["rings"]), of_ring))


def union_geom(geom: Column) -> Column:
    """Aggregate: the distinct polygons of a group as one list of polygons; for groups known to be small."""
    return F.array_distinct(F.flatten(F.collect_list(geom["rings"])))


def representative_point(geom: Column) -> Column:
    """A point inside the first polygon: the middle of the widest stretch inside, on the level halfway between the two
    middle heights of its points.  Null without an area."""
    geom = F.struct(F.slice(geom["rings"], 1, 1).alias("rings"))
    heights = F.array_sort(F.array_distinct(points_of(geom)["y"]))
    k = F.floor(F.size(heights) / 2).cast("int")
    level = (F.get(heights, k - 1) + F.get(heights, k)) / 2
    across = F.filter(edges(geom), lambda e: (e["ay"] > level) != (e["by"] > level))
    xs = F.array_sort(F.transform(across, lambda e: e["ax"] + (level - e["ay"]) * (e["bx"] - e["ax"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"])))
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("x")))
    widest = F.array_max(stretches)
    return F.when(widest["x"].isNotNull(), F.struct(widest["x"].alias("x"), level.alias("y")))
