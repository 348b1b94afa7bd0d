"""The exact silhouette by blocks: against all pairs, far from the origin, with equal rows, and for many clusters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import metrics


def by_hand(data):
    x, c = np.array([r[2:] for r in data]), np.array([r[1] for r in data])
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(len(x)):
        own = (c == c[i]).sum() - 1
        a = d[i, c == c[i]].sum() / own if own else None
        b = min((d[i, c == o].mean() for o in set(c) if o != c[i]), default=None)
        out.append(0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def rows(n, far=0.0, seed=1):
    rnd = random.Random(seed)
    data = [(i, c, c + rnd.gauss(far, 0.5), rnd.gauss(far, 1), rnd.choice([far, far + 1e-7])) for i in range(n) for c in [rnd.choice([0, 0, 1, 2])]]
    data += [(n + i, 5, *data[0][2:]) for i in range(40)] + [(n + 100, 7, far + 3.0, far, far)]  # equal rows in a cluster of their own, and one alone
    return data


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_blocks_against_all_pairs(spark, monkeypatch, far):
    monkeypatch.setattr(metrics, "TILE", (16, 64))
    data = rows(700, far)
    df = spark.createDataFrame([*data, (900, None, 0.0, 0.0, 0.0), (901, 1, None, 0.0, 0.0), (902, 1, float("nan"), 0.0, 0.0)], "k int, c int, a double, b double, z double")
    for block in (32_768, 90):
        assert metrics.silhouette(df, "k", "c", ["a", "b", "z"], block).first()[0] == pytest.approx(by_hand(data), abs=1e-9)


def test_many_clusters_none_and_one(spark, monkeypatch):
    data = rows(200)
    df = spark.createDataFrame(data, "k int, c int, a double, b double, z double")
    few = metrics.silhouette(df, "k", "c", ["a", "b", "z"]).first()[0]
    monkeypatch.setattr(metrics, "FEW_CLUSTERS", 2)
    assert metrics.silhouette(df, "k", "c", ["a", "b", "z"]).first()[0] == pytest.approx(few, abs=1e-12)
    monkeypatch.undo()
    assert metrics.silhouette(df.limit(0), "k", "c", ["a", "b"]).first()[0] is None
    assert metrics.silhouette(df.withColumn("c", F.lit(1)), "k", "c", ["a", "b"]).first()[0] == 0.0


def test_rows_move_as_blocks(spark, monkeypatch):
    """Every row used to be copied by itself to each block of two thousand, which no table of a million rows could bear."""
    seen = []
    monkeypatch.setattr(metrics, "_sums_of_pairs", lambda *a: seen.append(a))
    parts = metrics._sums_of_blocks(spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("c"), F.array(F.rand(1)).alias("at")), 5000, [0.5], 2000)
    assert parts.count() == 15_000 and parts.agg(F.sum("n")).first()[0] == 5000 * 5000 and not seen
