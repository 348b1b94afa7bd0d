import random
from collections import Counter

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.operators import models, siting, weighting
from zonalis.operators.raster import projected


def test_labels_over_all_strata(spark):
    rnd = random.Random(1)
    zones = spark.createDataFrame([(f"z{i:03d}",) for i in range(300)], "ageb_id string")
    held = spark.createDataFrame([(f"s{i}", f"z{i % 90:03d}") for i in range(200)], "stop_id string, ageb_id string")
    access = spark.createDataFrame([(f"z{i:03d}", rnd.randint(0, 5), rnd.randint(0, 9)) for i in range(290)], "ageb_id string, stops_400m int, stops_800m int")
    jobs = spark.createDataFrame([(f"z{i:03d}", rnd.randint(0, 90)) for i in range(10, 260)], "ageb_id string, employment_proxy int")
    got = siting.training_labels(zones, held, access, jobs).collect()
    kinds = Counter((r["label"], r["label_str"], r["stratum"].startswith("underserved_q")) for r in got)
    # ten of the ninety zones with stops lack employment; a sixteenth of eighty is asked of each stratum
    assert kinds[1, "suitable", False] == 80 and len({r["ageb_id"] for r in got}) == len(got)
    strata = Counter(r["stratum"] for r in got if r["label"] == 0)
    assert max(strata.values()) <= 5 and len(strata) >= 12
    assert all(r["stratum"] == f"underserved_q{r['accessibility_quartile']}_{r['employment_quartile']}" for r in got if r["label"] == 0)
    assert siting.training_labels(zones.limit(0), held, access, jobs).count() == 0


def test_audit_of_stops(spark):
    stops = spark.createDataFrame([("a", "A"), ("a", "Á"), ("b", None), ("c", "C"), (None, "x")], "stop_id string, stop_name string")
    of_stop = spark.createDataFrame([("a", 4, 10), ("b", 2, 10), ("c", 2, 0)], "stop_id string, stops_400m int, employment_proxy int")
    held = spark.createDataFrame([("a", "z"), ("a", "z"), ("b", "z"), ("c", "y")], "stop_id string, ageb_id string")
    master = spark.createDataFrame([("z", 8, 0.0, 3.0, 2.0), ("w", 99, 1.0, 1.0, 1.0)], "ageb_id string, stops_800m int, min_stop_dist_m double, route_km_800m double, slope_mean double")
    weights = spark.createDataFrame([(f, 1 / 6) for f in siting.FEATURES], "feature string, weight_normalized double")
    got = {r["stop_id"]: r for r in siting.station_audit(stops, of_stop, held, master, weights).collect()}
    # the zone of c isn't in the master table; the nearest distance is 0 throughout, the slope the largest
    assert set(got) == {"a", "b"} and got["a"]["stop_name"] == "Á"
    assert (got["a"]["npv_score"], got["b"]["npv_score"]) == (round(4 / 6, 4), round(3.5 / 6, 4))
    assert (got["a"]["npv_rank"], got["a"]["npv_percentile"], got["b"]["npv_rank"], got["b"]["npv_percentile"]) == (1, 100.0, 2, 0.0)


def test_published_weights_follow_from_their_statistics(spark):
    # fixed values: variance, mean |r| and weight of published criteria
    published = {
        "slope_inverted": (0.021599661224767117, 0.08904347677431693, 0.2908916920839077), "route_km_800m": (0.027948621700239158, 0.3331163242521836, 0.2755479664081504),
        "stops_800m": (0.015425016800423928, 0.4475205995529496, 0.12598779166605054), "employment_proxy": (0.010484405640428622, 0.25536163004753243, 0.11541864049900878),
        "stops_400m": (0.011953833885751755, 0.4263328205843703, 0.10138038786158671), "min_dist_inverted": (0.007660554759787865, 0.19848392977299797, 0.0907735214812959),
    }
    rng = np.random.default_rng(4)
    base = rng.normal(size=500)
    made = {f: base * rng.uniform(0, 1) + rng.normal(size=500) for f in published}
    df = spark.createDataFrame([tuple(float(made[f][i]) for f in published) for i in range(500)], list(published))
    got = {r["feature"]: r for r in weighting.critic(df, list(published)).collect()}
    share = lambda rows_: {f: v * (1 - r) / sum(v * (1 - r) for v, r in rows_.values()) for f, (v, r) in rows_.items()}
    assert all(abs(w - published[f][2]) < 1e-12 for f, w in share({f: p[:2] for f, p in published.items()}).items())
    assert all(abs(w - got[f]["weight_normalized"]) < 1e-12 for f, w in share({f: (r["variance"], r["avg_abs_correlation"]) for f, r in got.items()}).items())
    r = np.corrcoef(np.array(list(made.values())))
    assert all(abs((abs(r[i]).sum() - 1) / 5 - got[f]["avg_abs_correlation"]) < 1e-9 for i, f in enumerate(published))


def test_folds_thresholds_and_shuffled_labels(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, (i % 3 == 0) + rnd.gauss(0, 0.2), rnd.random()) for i in range(150)], "k int, y int, a double, b double").coalesce(1).persist()
    fit = lambda rows_: models.random_forest(rows_, ["a", "b"], "y", trees=5, depth=4)
    found = models.cross_validated(df, "k", "y", ["a", "b"], fit, folds=3)
    assert [r["fold"] for r in found] == [1, 2, 3] and all(49 <= r["n"] <= 51 and r["pr_auc"] > 0.8 for r in found)
    dealt = models.shuffled_labels(df, "k", "y")
    assert dealt.agg(F.sum("y")).first()[0] == 50 and dealt.select("k", "a").exceptAll(df.select("k", "a")).count() == 0
    assert dealt.join(df.select("k", F.col("y").alias("was")), "k").where("y <> was").count() > 30
    alone = {r["feature"]: r for r in models.univariate(df, ["a", "b"], "y").collect()}
    assert alone["a"]["best_direction"] == "positive" and alone["a"]["best_pr_auc"] > 0.9 > alone["b"]["best_pr_auc"]
    typed = df.withColumn("c", F.when(F.col("a") > 0.5, 2).when(F.col("b") > 0.5, 1).otherwise(0))
    forest = lambda rows_: models.random_forest(rows_, ["a", "b"], "c", trees=5, depth=4)
    assert models.cross_validated_classes(typed, "k", "c", ["a", "b"], forest, folds=3)["macro_f1"] > 0.9
    model = forest(typed)
    per = {(r["feature"], r["class"]): r["mean_abs_shap"] for r in models.class_importance(model, typed, "k", ["a", "b"], {0: "x", 1: "y", 2: "z"}).collect()}
    assert abs(per["a", "total"] - sum(per["a", c] for c in "xyz")) < 1e-9 and per["a", "z"] > per["b", "z"]
    boosted = models.boosted_multiclass(typed, ["a", "b"], "c", rounds=4, depth=3)
    assert models.classified(boosted, typed, ["a", "b"]).where("predicted = c").count() > 140
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.1)], "feature string, weight_normalized double")
    beside = models.against_weights([models.importance(models.explained(fit(df), df, "k", ["a", "b"]), ["a", "b"])], weights).collect()
    assert {r["feature"] for r in beside} == {"a", "b"} and all(r["rho"] == 1.0 for r in beside)


def test_inner_points_and_outer_edges(spark):
    geom = "struct<kind:string,srid:int,rings:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
    holed = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 1), (2, 9), (8, 9), (8, 1)]]
    u = [[(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (1, 1), (1, 9), (0, 9)]]
    far = [[(90, 90), (91, 90), (91, 91)]]
    shapes = {"holed": [holed], "u": [u], "two": [u, far], "flat": [[[(0, 0), (5, 0)]]], "none": []}
    df = spark.createDataFrame([(k, ("MULTIPOLYGON", 1, [[[(float(x), float(y)) for x, y in r] for r in p] for p in ps], None)) for k, ps in shapes.items()], f"k string, geom {geom}")
    at = df.select("k", "geom", G.representative_point(F.col("geom")).alias("p"))
    got = {r["k"]: r["i"] for r in at.select("k", G.contains_point(F.col("geom"), F.col("p.x"), F.col("p.y")).alias("i"), "p").collect()}
    assert got["holed"] and got["u"] and got["two"]
    assert {r["k"] for r in at.where("p is null").collect()} == {"flat", "none"}
    assert {r["k"]: r["n"] for r in df.select("k", F.size(G.edges(F.col("geom"))).alias("n")).collect()} == {"holed": 8, "u": 8, "two": 11, "flat": 2, "none": 0}


def test_cells_in_the_plane(spark):
    cells = spark.createDataFrame([(0, 0, -102.0, 12.0, 5.0)], "col int, row int, x double, y double, z double")
    r = projected(cells).first()
    assert abs(r["x"] - 2_500_000) < 1e-6 and abs(r["y"]) < 1e-6 and r["z"] == 5.0
    assert rows(projected(cells.limit(0))) == []
