import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm.density_peaks import clusters, described, plan_cells

FEATURES = ["f0", "f1", "f2"]


def frame(spark, at):
    return spark.createDataFrame([(i, *map(float, p)) if p else (i, None, 0.0, 0.0) for i, p in at], "pid bigint, f0 double, f1 double, f2 double").withColumn("id", F.lit("x")).withColumn("label", F.lit(0))


def components(at, radius):
    at = [(i, p) for i, p in at if p]
    group = {i: i for i, _ in at}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, p in at:
        for j, q in at:
            if i < j and math.dist(p, q) <= radius:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i, _ in at}


@pytest.mark.parametrize("chunk,least", [(25, 10), (25, 10**9), (100_000, 40)])
def test_groups_are_the_components(spark, chunk, least):
    rnd = random.Random(7)
    at = []
    for k in range(12):  # tight groups, one of them with a third of all rows
        c = [rnd.random() for _ in range(3)]
        at += [[x + rnd.gauss(0, 0.004) for x in c] for _ in range(120 if k == 0 else 15)]
    at += [[0.1 * i / 2, 2.0, 2.0] for i in range(30)]  # a chain, which has several peaks
    # a dense place whose neighbours lie within reach on one side, and two dense places side by side
    at += [[5.0 + rnd.gauss(0, 0.006), 1.0, 1.0] for _ in range(70)] + [[5.02 + 0.02 * i, 1.0, 1.0] for i in range(6)]
    at += [[7.0 + d + rnd.gauss(0, 0.006), 0.0, rnd.gauss(0, 0.006)] for d in (0, 0.07) for _ in range(60)]
    at += [at[3]] * 6 + [[9.0, 9.0, 9.0], None]
    rnd.shuffle(at)
    at = list(enumerate(at))
    found = clusters(frame(spark, at).repartition(3), "pid", FEATURES, 0.06, chunk, least)
    assert {r["pid"]: r["group_id"] for r in found.collect()} == components(at, 0.06)
    density = {r["pid"]: r["density"] for r in found.collect()}
    apart = {r["pid"]: r["apart"] for r in found.collect()}
    near = {i: [math.dist(p, q) ** 2 for _, q in at if q and math.dist(p, q) <= 0.06] for i, p in at if p}
    assert all(math.isclose(apart[i], sum(d), rel_tol=1e-6, abs_tol=1e-9) for i, d in near.items())
    assert density == {i: sum(math.dist(p, q) <= 0.06 for _, q in at if q) for i, p in at if p}
    sizes = {r["group_id"]: (r["size"], r["typical"]) for r in described(found, "pid").collect()}
    assert sum(n for n, _ in sizes.values()) == len(density) and all(len(t) == min(n, 3) for n, t in sizes.values())


def test_edges(spark):
    none = frame(spark, [(1, [0, 0, 0])]).limit(0)
    assert clusters(none, "pid", FEATURES, 0.1).count() == 0
    same = frame(spark, [(5, [1, 1, 1]), (3, [1, 1, 1]), (9, [1, 1, 1]), (4, None), (8, [float("nan"), 1, 1])])
    same = same.union(same.where("pid = 9").withColumn("pid", F.lit(None).cast("bigint")))
    assert {(r["pid"], r["group_id"], r["density"]) for r in clusters(same, "pid", FEATURES, 0.1).collect()} == {(3, 3, 3), (5, 3, 3), (9, 3, 3)}


def test_cells_hold_neighbours_alone():
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.uniform(0, 1, (300, 4)), rng.normal(0.5, 0.004, (200, 4)), rng.normal(0.9, 0.004, (100, 4))])
    centres = plan_cells(at, 50.0, 0.08, 500)
    assert len(centres) == 2 and np.abs(centres - [[0.5] * 4, [0.9] * 4]).max() < 0.01
    assert len(plan_cells(at, 50.0, 0.08, 10**6)) == 0 and len(plan_cells(at[:0], 1.0, 0.08, 5)) == 0


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr("zonalis.llm.density_peaks.HEAVY", 20)
    df = frame(spark, [(i, [1, 1, 1]) for i in range(60)] + [(60 + i, [1, 1, 1.01 + i]) for i in range(5)])
    found = {(r["pid"], r["group_id"], r["density"]) for r in clusters(df, "pid", FEATURES, 0.1).collect()}
    assert found == {(i, 0, 61) for i in range(61)} | {(60 + i, 60 + i, 1) for i in range(1, 5)}
