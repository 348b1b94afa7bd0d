import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from zonalis.llm import quantiles as Q
from zonalis.llm.cutoff import cutoffs, kept, latest_scores
from zonalis.plans.runtime import keyed_join


def within(values, answers, bound):
    values = sorted(values)
    for p, v in answers:
        rank = max(1, math.ceil(p * len(values) - 1e-9))
        low, high = sum(x < v for x in values) + 1, sum(x <= v for x in values)
        assert low - bound <= rank <= high + bound, (p, v, rank, low, high, bound)


def test_bound_holds_and_days_merge(spark, monkeypatch):
    monkeypatch.setattr(Q, "SIZE", 32)
    monkeypatch.setattr(Q, "FAN", 4)
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.7 else "cold", i % 3, rnd.choice([rnd.gauss(0, 1), 0.5])) for i in range(20_000)]
    data += [("one", 0, 7.0), ("none", 0, None), ("none", 1, float("nan")), (None, 0, 1.0), (None, 0, 2.0)]
    df = spark.createDataFrame(data, "g string, day int, v double").repartition(9).withColumn("level", F.lit(1)).withColumn("n", F.lit("x"))
    fractions = [0.0, 0.05, 0.5, 0.99, 1.0]
    # the workers import the module anew, so its constants there are the usual ones: exact for few values
    whole = Q.quantiles(df, ["g"], "v", fractions).collect()
    days = Q.build_sketches(df, ["g", "day"], "v")
    merged = Q.query_sketches(Q.merge_sketches(days, ["g"]), ["g"], fractions).collect()
    for found in (whole, merged):
        for g in ("hot", "cold", "one", None):
            mine = [r for r in found if r["g"] == g]
            values = [v for k, _, v in data if k == g]
            assert {r["n"] for r in mine} == {len(values)} and len(mine) == len(fractions)
            within(values, [(r["fraction"], r["value"]) for r in mine], mine[0]["rank_error_bound"])
        assert not [r for r in found if r["g"] == "none"]
    assert Q.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_thousand_files_of_one_key(spark):
    rnd = random.Random(4)
    schema = spark.createDataFrame([("k", 0.0)], "g string, v double")
    one = Q.build_sketches(schema, ["g"], "v").collect()[0].asDict()
    files, values = [], []
    for k in range(1000):
        mine = sorted(rnd.gauss(0, 1) for _ in range(9))
        values += mine
        files.append({**one, "sketch": rnd.getrandbits(62), "vals": mine, "n": 9})
    stored = spark.createDataFrame(files, "g string, sketch bigint, level int, weight bigint, vals array<double>, n bigint, error bigint")
    nodes, parts = Q.nodes_of(stored, ["g"])
    assert 16 < parts < 1000 and max(r["count"] for r in nodes.groupBy("_key", "_part").count().collect()) <= Q.MERGE_FAN
    found = Q.query_sketches(Q.merge_sketches(stored, ["g"]), ["g"], [0.05, 0.5, 0.99]).collect()
    assert {r["n"] for r in found} == {9000}
    within(values, [(r["fraction"], r["value"]) for r in found], found[0]["rank_error_bound"])
    # two builds over different files of a key don't share a number
    two = Q.build_sketches(schema, ["g"], "v").union(Q.build_sketches(schema, ["g"], "v"))
    assert two.select("sketch").distinct().count() == 2 and Q.merge_sketches(two, ["g"]).agg(F.sum("n")).first()[0] == 2
    assert Q.merge_sketches(stored.limit(0), ["g"]).count() == 0


def test_sketch_alone_with_small_buffers(monkeypatch):
    monkeypatch.setattr(Q, "SIZE", 16)
    monkeypatch.setattr(Q, "FAN", 5)
    rnd = random.Random(2)
    values = [rnd.random() ** 3 for _ in range(30_000)]
    parts = []
    import numpy as np

    for k in range(7):
        s = Q.Sketch()
        s.add(np.array(values[k::7]))
        parts.append(s)
    whole = Q.Sketch()
    for s in parts:
        for level, _, vals, n, error in s.rows():
            whole.merge_row(level, vals, n, error)
    all_ = sorted((v, w) for _, w, vals, _, _ in whole.rows() for v in vals.tolist())
    assert whole.n == len(values) == sum(w for _, w in all_)
    assert whole.error < 0.2 * len(values)
    total, answers = 0, []
    for v, w in all_:
        total += w
        answers.append((total / len(values), v))
    within(values, answers[::37], whole.error)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_cutoffs_against_brute_force(spark, monkeypatch, limit):
    # without a broadcast the join is salted
    monkeypatch.setattr("zonalis.llm.cutoff.keyed_join", lambda *a: keyed_join(*a, limit=limit))
    rnd = random.Random(3)
    data = []
    for run, n in (("big", 3000), ("small", 5), ("ties", 400), ("none", 0), ("untargeted", 9)):
        data += [(run, f"z{i}", rnd.choice([0.1, 0.2, 0.3]) if run == "ties" else round(rnd.random(), 3), i % 4, 1) for i in range(n)]
    data += [(r, z, s / 2, t + 10, 1) for r, z, s, t, _ in data[::5]] + data[::9]  # scored again later; repeated rows
    data += [("small", "z0", None, 99, 1), ("ties", "z1", float("nan"), 99, 1), (None, "z", 0.5, 1, 1)]
    df = spark.createDataFrame(data, "run string, zone string, score double, at int, n int").repartition(5)
    targets = spark.createDataFrame([("big", 33), ("small", 50), ("ties", 40), ("none", 10), ("gone", 5), ("big", None)], "run string, pct int")
    latest = latest_scores(df, ["run", "zone"], "score", "at")
    best = {}
    for r, z, s, t, _ in data:
        ok = s is not None and s == s
        best[r, z] = max(best.get((r, z), (-1, False, 0.0)), (t, ok, s if ok else 0.0))
    want = {}
    for run, pct in (("big", 33), ("small", 50), ("ties", 40)):
        scores = [s for (r, _), (_, ok, s) in best.items() if r == run and ok]
        cut = max(c for c in scores if sum(x >= c for x in scores) * 100 >= pct * len(scores))
        want[run] = (len(scores), cut, sum(x >= cut for x in scores), scores.count(cut))
    found = cutoffs(latest, "run", "score", targets, "pct")
    assert {r["run"]: (r["n"], r["cutoff"], r["kept"], r["ties"]) for r in found.collect()} == want
    assert kept(latest, "run", "score", found).count() == sum(w[2] for w in want.values())
    assert cutoffs(latest.limit(0), "run", "score", targets, "pct").count() == 0
    assert rows(cutoffs(latest, "run", "score", targets.limit(0), "pct")) == []
