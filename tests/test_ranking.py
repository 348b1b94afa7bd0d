import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from zonalis.operators.ranking import percent_rank_ascending, positions, running_sums, stratified_folds, stratified_split, tile
from zonalis.plans.runtime import keyed_join


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    made = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.0, 2.0, rnd.random()])) for i in range(400)] + [(400, "one", 5.0)]
    return spark.createDataFrame(made, "k int, g string, v double").repartition(5).persist()


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_are_those_of_windows(data, parts):
    for groups in (["g"], []):
        w = Window.partitionBy(*groups).orderBy(F.col("v").asc_nulls_last(), "k")
        want = data.select("k", F.row_number().over(w).alias("p"), F.ntile(7).over(w).alias("t"))
        assert rows(positions(data, groups, ["v", "k"], parts=parts).select("k", F.col("_position"), tile(7))) == rows(want)
        down, up = Window.partitionBy(*groups).orderBy(F.col("v").desc_nulls_last()), Window.partitionBy(*groups).orderBy(F.col("v").asc_nulls_first())
        want = data.select("k", F.rank().over(down), F.round(F.percent_rank().over(up), 9))
        assert rows(positions(data, groups, ["v"], True, parts).select("k", "_rank", F.round(percent_rank_ascending(), 9))) == rows(want)
    assert positions(data.limit(0), ["g"], ["v"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_are_those_of_windows(data, parts):
    w = Window.partitionBy("g").orderBy(F.desc("k"))
    want = data.select("k", F.sum("k").over(w), F.sum("k").over(Window.partitionBy("g")))
    assert rows(running_sums(data, ["g"], "k", ["k"], True, parts).select("k", "run_k", "all_k")) == rows(want)


def test_folds_and_split(data):
    sizes = {}
    for r in stratified_folds(data, "g", "k", 4).groupBy("g", "fold").count().collect():
        sizes.setdefault(r["g"], []).append(r["count"])
    assert all(max(n) - min(n) <= 1 and (g == "one" or len(n) == 4) for g, n in sizes.items())
    held = {r["g"]: (r["h"], r["n"]) for r in stratified_split(data, "g", "k", 0.25).groupBy("g").agg(F.count_if("held").alias("h"), F.count("*").alias("n")).collect()}
    assert all(abs(h - n / 4) <= 0.5 for h, n in held.values())


def test_keyed_join_of_a_hot_key(spark, data):
    per = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "g string, w int")
    for how in ("inner", "left"):
        assert rows(keyed_join(data, per, "g", 3, how, limit=0).select("k", "w")) == rows(data.join(per, "g", how).select("k", "w"))
