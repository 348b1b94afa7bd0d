import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_spatial import zones
from zonalis.operators import line_supply, models, raster


def tile(spark, parts):
    return spark.createDataFrame(parts, "tile_id string, x0 double, y0 double, dx double, dy double, ncols int, nrows int, nodata double, band array<float>")


def plane(x0, y0, n, a, b, c=100.0):
    return [float(c + a * (x0 + (i % n + 0.5) * 10) + b * (y0 - (i // n + 0.5) * 10)) for i in range(n * n)]


def test_slope_of_a_plane_across_tiles(spark):
    a, b = 0.3, -0.4
    parts = [(f"{x}_{y}", float(x), float(y), 10.0, -10.0, 5, 5, -9999.0, plane(x, y, 5, a, b)) for x in (0, 50) for y in (100, 50)]
    parts[0][8][12] = -9999.0
    t = tile(spark, parts)
    cells = raster.pixels(t)
    assert cells.count() == 99
    got = raster.slope(cells).collect()
    assert len(got) == 64 - 9 and all(abs(r["slope"] - math.degrees(math.atan(0.5))) < 1e-3 for r in got)
    z = zones(spark, [("A", [[[(0, 0), (100, 0), (100, 100), (0, 100)]]]), ("tiny", [[[(1, 1), (2, 1), (2, 2), (1, 2)]]])])
    means = {r["ageb_id"]: r["slope_mean"] for r in raster.zonal_slope(t, z).collect()}
    assert set(means) == {"A"} and abs(means["A"] - math.degrees(math.atan(0.5))) < 1e-3
    stats = raster.zonal_statistics(t, z, above=0).collect()[0]
    values = sorted(v for p in parts for v in p[8] if v > 0)
    assert abs(stats["median"] - np.median(values)) < 1e-3 and abs(stats["max"] - values[-1]) < 1e-3
    by_tile = raster.mean_of_tile_means(t, z).collect()[0]["mean"]
    assert abs(by_tile - np.mean([np.mean([v for v in p[8] if v > -9999]) for p in parts])) < 1e-3
    assert raster.slope(raster.pixels(t.limit(0))).count() == 0


def test_length_near_a_region_against_sampling(spark):
    rnd = random.Random(2)
    shape = [[(0, 0), (40, 0), (40, 20), (20, 20), (20, 40), (0, 40)], [(5, 5), (5, 10), (10, 10), (10, 5)]]
    edges = np.array([(a[0], a[1], b[0], b[1]) for ring in shape for a, b in zip(ring, ring[1:] + ring[:1])], float)
    from zonalis.functions.rtree import edge_distance2, inside

    for _ in range(60):
        seg = tuple(rnd.uniform(-30, 70) for _ in range(4))
        t = (np.arange(20_000) + 0.5) / 20_000
        x, y = seg[0] + t * (seg[2] - seg[0]), seg[1] + t * (seg[3] - seg[1])
        near = inside(x, y, edges) | (edge_distance2(x, y, edges) <= 25)
        assert abs(line_supply.near_length(seg, edges, 5.0) - near.mean() * math.dist(seg[:2], seg[2:])) < 0.05
    z = zones(spark, [("Z", [shape]), ("far", [[[(900, 900), (901, 900), (901, 901)]]])])
    lines = spark.createDataFrame([("r", [(-100.0, 30.0), (100.0, 30.0), (100.0, 500.0)]), ("s", [(-100.0, 30.0), (100.0, 30.0)]), ("one", [(0.0, 0.0)])], "route string, line array<struct<x:double,y:double>>")
    got = {(r["region"], r["route"]): r["metres"] for r in line_supply.length_near_regions(lines, "route", "line", z, "cvegeo", "geom", 5.0, cell=16.0).collect()}
    assert set(got) == {("Z", "r"), ("Z", "s")} and all(abs(v - 30) < 1e-9 for v in got.values())
    assert abs(line_supply.route_supply(lines, "route", "line", z, "cvegeo", "geom", 5.0).collect()[0]["route_km_within_800m"] - 0.06) < 1e-9
    assert line_supply.merged_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]]


def test_length_near_neighbouring_parts_counts_once(spark):
    square = lambda x: [[(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]]
    z = zones(spark, [("two", [square(0), square(14)]), ("one", [square(0)])])
    lines = spark.createDataFrame([("a", [(-100.0, 5.0), (100.0, 5.0)]), ("back", [(-100.0, 5.0), (100.0, 5.0), (-100.0, 5.0), (100.0, 5.0)]), ("a", [(-100.0, 5.0), (100.0, 5.0)])], "route string, line array<struct<x:double,y:double>>")
    got = {(r["region"], r["route"]): r["metres"] for r in line_supply.length_near_regions(lines, "route", "line", z, "cvegeo", "geom", 5.0, cell=16.0).collect()}
    # 'two' reaches from -5 to 29, its parts' surroundings share 9 to 15
    want = {("two", "a"): 68, ("two", "back"): 102, ("one", "a"): 40, ("one", "back"): 60}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(9)
    data = [(i, c % 2, c, *(rnd.gauss(m, 0.3) for m in ((0, 0, 1), (4, 0, 2), (0, 5, 3))[c])) for i in range(150) for c in [rnd.choice([0, 0, 0, 1, 1, 2])]]
    return spark.createDataFrame(data, "k int, y int, c int, a double, b double, z double").persist()


def test_clusters_and_components(blobs):
    found = models.kmeans(blobs, ["a", "b"], 3, starts=3)
    sizes = {r["cluster_id"]: (r["n"], r["kinds"]) for r in found.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("c").alias("kinds")).collect()}
    assert {k for _, k in sizes.values()} == {1} and sizes[0][0] >= sizes[1][0] >= sizes[2][0]
    assert {r["typology_name"] for r in models.cluster_profiles(found, ["a"]).collect()} == {"Typology A", "Typology B", "Typology C"}
    k, scores = models.select_k(blobs, "k", ["a", "b"], range(2, 5), starts=2)
    assert k == 3 and scores[3] > 0.7
    pcs, shares = models.principal_components(blobs, ["a", "b", "z"])
    x = np.array(blobs.select("a", "b", "z").collect())
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(shares, w[:2] / w.sum()) and abs(pcs.agg(F.avg("pc1")).first()[0]) < 1e-9


def test_contributions_add_up(blobs):
    features = ["a", "b", "z"]
    forest = models.random_forest(blobs, features, "y", trees=5, depth=4)
    scored = {r["k"]: r["score"] for r in models.scored(forest, blobs, features).collect()}
    explained = models.explained(forest, blobs, "k", features)
    for r in explained.collect():
        assert abs(r["base"] + sum(r[f] for f in features) - scored[r["k"]]) < 1e-9
    assert {r["feature"] for r in models.importance(explained, features).collect()} == set(features)
    boosted = models.boosted(blobs, features, "y", rounds=4, depth=2, share=1.0)
    assert models.scored(boosted, blobs, features).where((F.col("score") >= 0.5) == (F.col("y") == 1)).count() > 140
    by_hand = _shapley_by_subsets(models.leaves(forest), blobs.select(*features).limit(3).collect(), 3)
    got = models.shapley(np.array(blobs.select(*features).limit(3).collect()), models.leaves(forest))[0]
    assert np.allclose(by_hand, got)


def _shapley_by_subsets(paths, rows, n):
    from itertools import combinations

    def value(x, known):
        return sum(v * math.prod(float(low < x[f] <= high) if f in known else z for f, low, high, z in path) for v, path in paths)

    out = np.zeros((len(rows), n))
    for i, x in enumerate(rows):
        for f in range(n):
            rest = [g for g in range(n) if g != f]
            for size in range(n):
                for s in combinations(rest, size):
                    out[i, f] += math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n) * (value(x, {*s, f}) - value(x, set(s)))
    return out


def test_leakage_report(spark):
    a = spark.createDataFrame([(1, 0.5, 1), (2, 0.6, 0), (3, 0.7, 1)], "k int, f double, y int")
    b = spark.createDataFrame([(4, 0.5, 0), (3, 0.9, 1)], "k int, f double, y int")
    r = models.leakage_report(a, b, "k", ["f"], "y").first()
    assert (r["shared_vectors"], r["conflicting_vectors"], r["repeated_keys"]) == (1, 1, 1) and abs(r["positive_rate"] - 0.6) < 1e-12

