"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.cutoff import cutoffs, kept, latest_scores
from zonalis.llm.density_peaks import clusters, described
from zonalis.llm.leakage import leaked
from zonalis.llm.mojibake import garbled, restored
from zonalis.llm.packing import audit, filling, pack, token_counts
from zonalis.llm.quantiles import build_sketches, merge_sketches, quantiles, query_sketches
from zonalis.plans.runtime import checkpointed, table

FRACTIONS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: The value that stands for no slope.
NO_DATA = -9999.0


def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "ageb_topography").where(F.col("slope_mean") != NO_DATA)
    return t.select(F.substring("ageb_id", 3, 3).alias("key"), F.to_date("loaded_at").alias("day"), F.col("slope_mean").alias("value"))


def _nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_profiles").select(F.col("cluster_id").cast("string").alias("key"), F.col("v_ntl_median_n").alias("value"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and percentiles of both columns per group; the slopes' sketches are built per loading day and then merged."""
    days = checkpointed(build_sketches(_slopes(spark, sf_dir), ["key", "day"], "value"))  # as they would be kept from day to day
    slopes = query_sketches(merge_sketches(days, ["key"]), ["key"], FRACTIONS).withColumn("measure", F.lit("slope_mean"))
    nights = quantiles(_nights(spark, sf_dir), ["key"], "value", FRACTIONS).withColumn("measure", F.lit("v_ntl_median_n"))
    return slopes.unionByName(nights)


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each answer of p3_percentiles keeps its bound, by the true ranks counted over the whole columns."""
    found = p3_percentiles(spark, sf_dir)
    values = _slopes(spark, sf_dir).select("key", "value", F.lit("slope_mean").alias("measure")).unionByName(
        _nights(spark, sf_dir).withColumn("measure", F.lit("v_ntl_median_n"))
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    answers = found.groupBy("measure", "key", "n", "rank_error_bound").agg(F.collect_list(F.struct("fraction", F.col("value").alias("v"))).alias("asked"))
    on = answers.withColumnsRenamed({"measure": "_m", "key": "_k"})
    counted = values.join(F.broadcast(on), (F.col("measure") == F.col("_m")) & F.col("key").eqNullSafe(F.col("_k")))
    counts = [F.count_if(F.col("value") < F.col("asked")[i]["v"]).alias(f"lt{i}") for i in range(len(FRACTIONS))]
    counts += [F.count_if(F.col("value") <= F.col("asked")[i]["v"]).alias(f"le{i}") for i in range(len(FRACTIONS))]
    per = counted.groupBy("measure", "key", "n", "rank_error_bound", "asked").agg(F.count("*").alias("rows"), *counts)
    rank = lambda i: F.greatest(F.ceil(F.col("asked")[i]["fraction"] * F.col("n") - 1e-9), F.lit(1))
    holds = [(F.col(f"lt{i}") + 1 - F.col("rank_error_bound") <= rank(i)) & (F.col(f"le{i}") + F.col("rank_error_bound") >= rank(i)) for i in range(len(FRACTIONS))]
    every = holds[0]
    for h in holds[1:]:
        every = every & h
    return per.select("measure", "key", "n", (every & (F.col("n") == F.col("rows"))).alias("within_bound"), (F.col("rank_error_bound") <= F.col("n") * 0.005).alias("bound_small"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(latest_scores(table(spark, sf_dir, "ageb_suitability_predictions"), ["run_id", "ageb_id"], "score_rf", "created_at"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _latest(spark, sf_dir)
    found = cutoffs(latest, "run_id", "score_rf", table(spark, sf_dir, "cutoff_targets"), "keep_pct")
    return kept(latest, "run_id", "score_rf", found).select("run_id", "ageb_id")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff, kept size and ties per run beside the threshold the run recorded (its most recent one)."""
    latest = _latest(spark, sf_dir)
    found = cutoffs(latest, "run_id", "score_rf", table(spark, sf_dir, "cutoff_targets"), "keep_pct")
    recorded = table(spark, sf_dir, "ageb_suitability_predictions").where(F.col("threshold_rf").isNotNull()).groupBy("run_id").agg(
        F.max(F.struct("created_at", "threshold_rf"))["threshold_rf"].alias("threshold_rf")
    )
    return found.join(recorded, "run_id", "left")


#: Profiles at most so far apart are alike.
ALIKE = 0.08
FEATURES = [
    "n_intersections_n", "n_street_density_n", "n_intersection_density_n", "p_poi_density_n", "p_employment_proxy_n", "p_retail_density_n",
    "p_service_density_n", "p_land_use_mix_n", "pe_population_n", "pe_pop_density_n", "pe_marginacion_n", "pe_rezago_n", "pe_dep_ratio_n",
    "pe_youth_share_n", "v_ntl_median_n", "v_ridership_annual_n",
]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "cluster_profiles"), "profile_id", FEATURES, ALIKE)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("group_id <> profile_id").select(F.col("group_id").alias("profile_id_a"), F.col("profile_id").alias("profile_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's size and its three most typical profiles."""
    found = checkpointed(_groups(spark, sf_dir))
    return described(found, "profile_id").select("group_id", "size", F.array_join("typical", ",").alias("typical"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), "doc_id", table(spark, sf_dir, "container_sizes"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every text, or piece of a text above the capacity, goes in each kind of container."""
    return _packed(spark, sf_dir)


def p6_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filling(_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every token is placed once, no container is overfull and no text that fits is cut."""
    sizes, kinds = _sizes(spark, sf_dir), table(spark, sf_dir, "container_sizes")
    return audit(checkpointed(pack(sizes, "doc_id", kinds)), sizes, kinds, "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_percentiles": p3_percentiles, "p3_audit": p3_audit, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_cutoffs": p5_cutoffs,
    "p6_containers": p6_containers, "p6_filling": p6_filling, "p6_audit": p6_audit, "p7_found": p7_found, "p8_found": p8_found, "p8_restored": p8_restored,
}

_LATEST = """
WITH ranked AS (SELECT run_id, ageb_id, CASE WHEN isnan(score_rf) THEN NULL ELSE score_rf END AS s,
    row_number() OVER (PARTITION BY run_id, ageb_id ORDER BY created_at DESC NULLS LAST, CASE WHEN isnan(score_rf) THEN NULL ELSE score_rf END DESC NULLS LAST) AS k
  FROM ageb_suitability_predictions),
latest AS (SELECT run_id, ageb_id, s FROM ranked WHERE k = 1 AND s IS NOT NULL),
reach AS (SELECT run_id, s, count(*) OVER (PARTITION BY run_id) AS n, count(*) OVER (PARTITION BY run_id ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY run_id, s) AS ties FROM latest),
cut AS (SELECT run_id, n, max(s) AS cutoff FROM reach JOIN cutoff_targets USING (run_id) WHERE r * 100 >= keep_pct * n GROUP BY run_id, n)
"""

_DISTANCE = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in FEATURES)
_SOUND = " AND ".join(f"{f} IS NOT NULL AND NOT isnan({f})" for f in FEATURES)
_COMPONENTS = f"""
WITH RECURSIVE rows AS (SELECT * FROM cluster_profiles WHERE {_SOUND}),
near AS (SELECT a.profile_id AS x, b.profile_id AS y, sqrt({_DISTANCE}) AS d FROM rows a JOIN rows b ON sqrt({_DISTANCE}) <= {ALIKE}),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
grouped AS (SELECT x AS profile_id, min(y) AS group_id FROM reach GROUP BY x)
"""

ORACLES: dict[str, str] = {
    "p4_found": _COMPONENTS + "SELECT group_id AS profile_id_a, profile_id AS profile_id_b FROM grouped WHERE group_id <> profile_id",
    "p4_groups": _COMPONENTS + """, stand AS (SELECT x, count(*) AS n, round(sum(d * d), 9) AS apart FROM near GROUP BY x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, apart, profile_id) AS k FROM grouped JOIN stand ON x = profile_id)
SELECT group_id, count(*) AS size, string_agg(profile_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3) AS typical FROM ranked GROUP BY group_id""",
    "p3_audit": """
WITH v AS (SELECT 'slope_mean' AS measure, substr(ageb_id, 3, 3) AS key, slope_mean AS x FROM ageb_topography WHERE slope_mean <> -9999
  UNION ALL SELECT 'v_ntl_median_n', cast(cluster_id AS VARCHAR), v_ntl_median_n FROM cluster_profiles)
SELECT measure, key, count(*) AS n, true AS within_bound, true AS bound_small FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY measure, key""",
    "p6_audit": """
SELECT container, (SELECT count(*) FROM documents) AS texts, true AS whole, 0 AS overfull, 0 AS split FROM container_sizes WHERE capacity_tokens > 0 GROUP BY container""",
    "p5_found": _LATEST + "SELECT run_id, ageb_id FROM latest JOIN cut USING (run_id) WHERE s >= cutoff",
    "p5_cutoffs": _LATEST + """, shown AS (SELECT run_id, max_by(threshold_rf, created_at) AS threshold_rf FROM ageb_suitability_predictions WHERE threshold_rf IS NOT NULL GROUP BY run_id)
SELECT DISTINCT c.run_id, c.n, c.cutoff, r.r AS kept, r.ties, t.threshold_rf FROM cut c JOIN reach r ON r.run_id = c.run_id AND r.s = c.cutoff LEFT JOIN shown t ON t.run_id = c.run_id""",
}
