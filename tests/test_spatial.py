import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions.projection import forward, inverse
from zonalis.functions.rtree import StrTree, inside
from zonalis.operators import quadtree_join as QJ

GEOM = "struct<kind:string,srid:int,rings:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
L_SHAPE = [[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]]
HOLED = [[(10, 0), (20, 0), (20, 10), (10, 10), (10, 0)], [(12, 2), (12, 8), (18, 8), (18, 2)]]


def zones(spark, parts):
    data = [(k, ("MULTIPOLYGON", 6372, [[[(float(x), float(y)) for x, y in ring] for ring in p] for p in polygons], None)) for k, polygons in parts]
    return spark.createDataFrame(data, f"cvegeo string, geom {GEOM}")


def points(spark, at):
    return spark.createDataFrame([(i, None if p is None else float(p[0]), None if p is None else float(p[1])) for i, p in enumerate(at)], "pid int, x double, y double")


def test_concave_and_holed_regions(spark):
    z = zones(spark, [("L", [L_SHAPE]), ("H", [HOLED]), ("two", [[[(30, 0), (31, 0), (31, 1), (30, 1)]], [[(40, 0), (41, 0), (41, 1), (40, 1)]]])])
    p = points(spark, [(1, 1), (3, 1), (1, 3), (3, 3), (5, 1), (11, 1), (15, 5), (30.5, 0.5), (40.5, 0.5), (2, 3), None, (float("nan"), 1)])
    found = lambda *a: rows(QJ.quadtree_join(p, "pid", "x", "y", QJ.region_targets(z, "cvegeo", "geom", *a)))
    assert found() == [(0, "L"), (1, "L"), (2, "L"), (5, "H"), (7, "two"), (8, "two")]
    assert (9, "L") in found(0.0)  # on the edge
    assert {x for x in found(1.0) if x[1] == "L"} == {(0, "L"), (1, "L"), (2, "L"), (3, "L"), (4, "L"), (9, "L")}


@pytest.mark.parametrize("group", [7, 60, 100_000])
def test_against_brute_force_with_a_hot_spot(spark, group):
    rnd = random.Random(5)
    at = [(rnd.randrange(0, 4000) / 8, rnd.randrange(0, 4000) / 8) for _ in range(250)] + [(100.0, 100.0)] * 120 + [(1e7, 1e7)]
    others = [(rnd.randrange(0, 4000) / 8, rnd.randrange(0, 4000) / 8) for _ in range(60)] + [(103.0, 104.0)]
    p, t = points(spark, at), spark.createDataFrame([(f"t{i}", x, y) for i, (x, y) in enumerate(others)], "tid string, x double, y double")
    t = t.union(t.limit(5))  # repeated rows
    got = rows(QJ.quadtree_join(p.withColumn("other_id", F.lit(1)).withColumn("leaf", F.lit(2)), "pid", "x", "y", QJ.point_targets(t, "tid", F.col("x"), F.col("y"), 5.0), group, distances=True))
    want = sorted(((i, f"t{j}", math.dist(a, b)) for i, a in enumerate(at) for j, b in enumerate(others) if math.dist(a, b) <= 5.0), key=lambda r: tuple(map(str, r)))
    assert [(a, b, round(c, 9)) for a, b, c in got] == [(a, b, round(c, 9)) for a, b, c in want]
    assert any(r[0] >= 250 for r in got)


def test_groups_keep_their_size_at_any_number_of_points():
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.uniform(0, 1e5, (20_000, 2)), np.full((10_000, 2), 777.0)])
    for n in (30_000, 10**8, 10**10):
        tree = QJ.tree_of(at, n)
        cells = np.clip(np.floor((at - [tree.x0, tree.y0]) / (tree.size / 2**QJ.BITS)), 0, 2**QJ.BITS - 1).astype(np.int64)
        leaf = np.searchsorted(tree.starts, QJ._spread_np(cells[:, 0]) | (QJ._spread_np(cells[:, 1]) << 1), side="right") - 1
        held = np.bincount(leaf, minlength=len(tree.starts)) * (n / len(at)) / tree.salts
        assert held.max() <= 2 * QJ.GROUP_POINTS and len(tree.starts) <= QJ.MAX_LEAVES


def test_empty_sides(spark):
    p, z = points(spark, [(1, 1)]), zones(spark, [("L", [L_SHAPE])])
    assert QJ.quadtree_join(p.limit(0), "pid", "x", "y", QJ.region_targets(z, "cvegeo", "geom")).count() == 0
    assert QJ.quadtree_join(p, "pid", "x", "y", QJ.region_targets(z.limit(0), "cvegeo", "geom")).count() == 0


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 100, (500, 2))
    boxes = np.column_stack([low, low + rng.uniform(0, 9, (500, 2))])
    asked = np.column_stack([low[:80], low[:80] + 3])
    q, e = StrTree(boxes).meeting(asked)
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(boxes) if a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]}
    assert set(zip(q.tolist(), e.tolist())) == want and len(q) == len(want)
    assert not inside(np.array([1.0]), np.array([1.0]), np.empty((0, 4))).any()


def test_native_geometry(spark):
    z = zones(spark, [("L", [L_SHAPE]), ("H", [HOLED])])
    r = {x["cvegeo"]: x for x in z.select("cvegeo", G.area(F.col("geom")).alias("a"), G.perimeter(F.col("geom")).alias("p"), G.contains_point(F.col("geom"), F.lit(15.0), F.lit(5.0)).alias("c"),
                                         G.contains_point(F.col("geom"), F.lit(1.0), F.lit(3.0)).alias("d"), G.geojson(F.col("geom")).alias("j")).collect()}
    assert (r["L"]["a"], r["L"]["p"], r["L"]["d"], r["H"]["a"], r["H"]["p"], r["H"]["c"]) == (12, 16, True, 64, 64, False)
    assert r["L"]["j"].startswith('{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[4.0,0.0]')


def test_projection(spark):
    one = spark.createDataFrame([(-102.0, 12.0), (-103.5, 20.5), (-90.0, 30.0)], "lon double, lat double")
    x, y = forward(F.col("lon"), F.col("lat"))
    at = one.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = inverse(F.col("x"), F.col("y"))
    out = at.select("*", lon.alias("l"), lat.alias("a")).collect()
    assert abs(out[0]["x"] - 2_500_000) < 1e-6 and abs(out[0]["y"]) < 1e-6
    assert all(abs(r["l"] - r["lon"]) < 1e-10 and abs(r["a"] - r["lat"]) < 1e-10 for r in out)
