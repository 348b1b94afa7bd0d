"""The forest of several classes: its splits, its independence of how rows lie, and what larger tables get."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import forest, models


@pytest.fixture(scope="module")
def typed(spark):
    rnd = random.Random(4)
    data = [(i, c, c * 3 + rnd.gauss(0, 0.4), rnd.choice([None, float("nan"), 0.5, 1.0]), float(i == 7)) for i in range(240) for c in [rnd.choice([0, 0, 1, 2])]]
    return spark.createDataFrame(data, "k int, c int, a double, b double, flag double").persist()


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 32, (300, 1)).astype(np.uint8), rng.integers(0, 3, 300)
    y[bins[:, 0] > 20] = 1
    tree = forest.grown(bins, y, 3, 1, 2, np.random.default_rng(8))
    drawn = np.bincount(np.random.default_rng(8).integers(300, size=300), minlength=300)
    gini = lambda s: (n := np.bincount(y[s], drawn[s], 3)).sum() - (n**2).sum() / n.sum()
    worth = {c: gini(bins[:, 0] <= c) + gini(bins[:, 0] > c) for c in range(31)}
    assert len(tree.feature) == 3 and worth[int(tree.cut[0])] == pytest.approx(min(worth.values()))
    assert tree.stats[0].sum() == 300 and np.allclose(tree.stats[1] + tree.stats[2], tree.stats[0])


def test_nodes_in_pieces_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 32, (2000, 6)).astype(np.uint8), rng.integers(0, 4, 2000)
    whole = forest.grown(bins, y, 4, 16, 2, np.random.default_rng(1))
    monkeypatch.setattr(forest, "ENTRIES", 1000)
    cut = forest.grown(bins, y, 4, 16, 2, np.random.default_rng(1))
    assert all(np.array_equal(getattr(whole, f), getattr(cut, f)) for f in ("feature", "cut", "left", "right", "stats"))
    leaves = np.flatnonzero(whole.feature < 0)
    assert whole.stats[leaves].sum() == 2000 and whole.stats[leaves].sum(1).min() >= 2 and set(whole.leaf(bins)) <= set(leaves)


def test_bins_keep_the_order_of_values(typed):
    rows = forest.gathered(typed, "k", "c", ["a", "b", "flag"])
    x = np.array([[v if v is not None and v == v else 0.0 for v in r] for r in typed.orderBy("k").select("a", "b", "flag").collect()])
    for i, cuts in enumerate(rows.cuts):
        assert all(np.array_equal(x[:, i] <= c, rows.bins[:, i] <= j) for j, c in enumerate(cuts))
    assert len(rows.cuts[0]) == 31 and len(rows.cuts[1]) == 2 and rows.cuts[2].tolist() == [0.5]
    assert [rows.classes[c] for c in rows.y] == [r["c"] for r in typed.orderBy("k").collect()]


def test_folds_cover_every_row_however_rows_lie(spark, typed):
    features = ["a", "b", "flag"]

    def found(df):
        placed = df.withColumn("fold", F.col("k") % 3)
        return sorted(map(tuple, forest.held_out(spark, forest.gathered(placed, "k", "c", features, F.col("fold")), 3, 60, 16).collect()))

    one = found(typed)
    assert len(one) == 240 and sum(label == p for _, label, p in one) > 220 and one == found(typed.repartition(7))
    got = models.cross_validated_forest(typed, "k", "c", features, folds=3, trees=60)
    assert set(got) == {"accuracy", "macro_precision", "macro_recall", "macro_f1"} and got["macro_f1"] > 0.9


def test_larger_tables_go_to_the_library(typed, monkeypatch):
    monkeypatch.setattr(forest, "BYTES", 100)
    assert forest.gathered(typed, "k", "c", ["a", "b"]) is None
    assert models.cross_validated_forest(typed, "k", "c", ["a", "b"], folds=2, trees=3, depth=3)["macro_f1"] > 0.9


def test_contributions_to_several_classes(spark, typed):
    features = ["a", "b", "flag"]
    rows = forest.gathered(typed, "k", "c", features)
    found = forest.trained(spark, rows, 9, 6)
    x = np.array(typed.select(*forest.clean(features)).orderBy("k").collect())
    phi, base = models.shapley(x, found.leaves([2, 0, 7]))
    shares = sum(t.stats[leaf] / t.stats[leaf].sum(1, keepdims=True) for t in found.trees for leaf in [t.leaf(rows.bins)]) / 9
    assert phi.shape == (240, 3, 3) and np.allclose(base + phi.sum(1), np.column_stack([shares[:, 2], shares[:, 0], np.zeros(240)]))
    per = {(r["feature"], r["class"]): r["mean_abs_shap"] for r in models.class_importance(found, typed.repartition(5), "k", features, {2: "two", 0: "none"}).collect()}
    want = np.abs(phi).mean(0)
    assert all(abs(per[f, c] - want[i, j]) < 1e-12 for i, f in enumerate(features) for j, c in enumerate(("two", "none")))
    assert len(per) == 9 and abs(per["a", "total"] - want[0, :2].sum()) < 1e-12


def test_contributions_by_table_and_by_row_equal_those_over_subsets():
    from test_raster_lines_models import _shapley_by_subsets

    rng = random.Random(1)
    paths = []
    for _ in range(40):
        fs = rng.sample(range(5), rng.randrange(6))
        paths.append((rng.random(), [(f, *sorted(rng.choice([-np.inf, 0.2, 0.5, 0.8, np.inf]) for _ in "ab"), rng.random()) for f in fs]))
    x = np.array([[rng.choice([0.2, 0.5, 0.7, 0.9]) for _ in range(5)] for _ in range(60)])
    many, few = models.shapley(x, paths), models.shapley(x[:3], paths)
    assert np.allclose(many[0][:3], few[0]) and np.allclose(many[1], few[1])
    assert np.allclose(few[0], _shapley_by_subsets(paths, x[:3], 5))


def test_one_pass_for_all_classes(spark, typed):
    """A pass per class over all leaves took minutes over ten thousand rows."""
    found = forest.trained(spark, forest.gathered(typed, "k", "c", ["a", "b", "flag"]), 5, 4)
    plan = models.class_importance(found, typed, "k", ["a", "b", "flag"], {0: "x", 1: "y", 2: "z"})
    assert plan.count() == 12
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (calls.add(1), v)[1], "double").asNondeterministic()
    models.class_importance(found, typed.withColumn("a", counted("a")), "k", ["a", "b", "flag"], {0: "x", 1: "y", 2: "z"}).count()
    assert calls.value == 240
