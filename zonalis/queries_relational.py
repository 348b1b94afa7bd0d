"""Queries of the relational operators: expressions, filters, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.functions.scalars import (
    JOBS_BY_CLASS,
    SECTOR_PREFIXES,
    SMALL_CLASSES,
    clip,
    first_prefix,
    mapped,
    nan_to_null,
    number_or,
    safe_corr,
    safe_ratio,
    zfill,
)
from zonalis.operators.ranking import percent_rank_ascending, positions, stratified_folds, stratified_split, tile
from zonalis.plans.runtime import table as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql_jobs(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in JOBS_BY_CLASS.items()) + " ELSE 0 END"


def _sql_sector(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'{column} LIKE {chr(39)}{p}%{chr(39)}' for p in ps)} THEN '{n}'" for n, ps in SECTOR_PREFIXES.items()) + " ELSE 'other' END"


# --- projections and expressions -------------------------------------------------------------------------------------


@query("SELECT denue_id AS id, clee, nombre_unidad AS nombre, CAST(latitud AS FLOAT) AS lat, CAST(scian_codigo AS BIGINT) AS clase FROM denue")
def prj_rename_cast(s, d):
    return T(s, d, "denue").select(F.col("denue_id").alias("id"), "clee", F.col("nombre_unidad").alias("nombre"), F.col("latitud").cast("float").alias("lat"), F.col("scian_codigo").cast("bigint").alias("clase"))


@query("SELECT DISTINCT stop_id, 'gtfs' AS source, 1 AS label FROM gtfs_stops")
def prj_literals(s, d):
    return T(s, d, "gtfs_stops").select("stop_id", F.lit("gtfs").alias("source"), F.lit(1).alias("label")).distinct()


@query("SELECT denue_id, coalesce(nullif(razon_social, ''), nombre_unidad, clee) AS a, coalesce(razon_social, nombre_unidad) AS b FROM denue")
def prj_coalesce_nullif(s, d):
    return T(s, d, "denue").select("denue_id", F.coalesce(F.nullif("razon_social", F.lit("")), "nombre_unidad", "clee").alias("a"), F.coalesce("razon_social", "nombre_unidad").alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 10 THEN 20 WHEN l_quantity <= 20 THEN 40 WHEN l_quantity <= 30 THEN 75 WHEN l_quantity <= 40 THEN 175 ELSE 0 END AS jobs FROM lineitem")
def prj_case_map(s, d):
    q = F.col("l_quantity")
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(q <= 10, 20).when(q <= 20, 40).when(q <= 30, 75).when(q <= 40, 175).otherwise(0).alias("jobs"))


@query(f"SELECT denue_id, cargado_en IS NULL AS unloaded, {_sql_jobs('estrato_personal')} AS jobs FROM denue")
def prj_dict_map(s, d):
    return T(s, d, "denue").select("denue_id", F.col("cargado_en").isNull().alias("unloaded"), mapped(F.col("estrato_personal"), JOBS_BY_CLASS).alias("jobs"))


@query(f"SELECT denue_id, scian_codigo, {_sql_sector('scian_codigo')} AS sector FROM denue")
def prj_prefix_class(s, d):
    return T(s, d, "denue").select("denue_id", "scian_codigo", first_prefix(F.col("scian_codigo"), SECTOR_PREFIXES).alias("sector"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal / CASE WHEN c_nationkey < 0.01 THEN 0.01 ELSE c_nationkey END > 5 THEN 5 ELSE c_acctbal / CASE WHEN c_nationkey < 0.01 THEN 0.01 ELSE c_nationkey END END, 6) AS ratio FROM customer")
def prj_safe_ratio(s, d):
    return T(s, d, "customer").select("c_custkey", F.round(safe_ratio(F.col("c_acctbal"), F.col("c_nationkey"), 0.01, 5.0), 6).alias("ratio"))


@query("SELECT profile_id, coalesce(cluster_id, 0) AS cluster_id, coalesce(p_poi_density_n, 0) AS poi FROM cluster_profiles")
def prj_fillna0(s, d):
    return T(s, d, "cluster_profiles").select("profile_id", "cluster_id", F.col("p_poi_density_n").alias("poi")).na.fill(0)


@query("SELECT run_id, ageb_id, CASE WHEN isnan(score_rf) THEN NULL ELSE score_rf END AS score FROM ageb_suitability_predictions")
def prj_nan_to_null(s, d):
    return T(s, d, "ageb_suitability_predictions").select("run_id", "ageb_id", nan_to_null(F.col("score_rf")).alias("score"))


@query("SELECT denue_id, coalesce(try_cast(fecha_alta AS DOUBLE), 0) AS number FROM denue WHERE fecha_alta IS NULL OR fecha_alta NOT LIKE '%e%'")
def prj_coerce_numeric(s, d):
    return T(s, d, "denue").where("fecha_alta is null or fecha_alta not like '%e%'").select("denue_id", number_or(F.col("fecha_alta")).alias("number"))


@query("SELECT p_partkey, p_size + p_retailprice AS total FROM part")
def prj_optional_column(s, d):
    df = T(s, d, "part")
    total = F.col("p_total") if "p_total" in df.columns else F.col("p_size") + F.col("p_retailprice")
    return df.select("p_partkey", total.alias("total"))


@query("SELECT c_custkey, round(CAST(c_acctbal AS DECIMAL(38, 10)), 1)::DOUBLE AS r1, round(CAST(c_acctbal AS DECIMAL(38, 10)), 0)::DOUBLE AS r0, round_even(c_acctbal, 0) AS even FROM customer")
def prj_round(s, d):
    exact = F.col("c_acctbal").cast("decimal(38,10)")
    return T(s, d, "customer").select("c_custkey", F.round(exact, 1).cast("double").alias("r1"), F.round(exact, 0).cast("double").alias("r0"), F.bround("c_acctbal", 0).alias("even"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 100000")
def prj_bind_params(s, d):
    return s.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice >= :least", args={"priority": "1-URGENT", "least": 100000}, orders=T(s, d, "orders"))


@query("SELECT CASE WHEN abs(sum(w) - 1) < 0.0001 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM (SELECT c_acctbal / sum(c_acctbal) OVER () AS w FROM customer)")
def prj_null_test(s, d):
    c = T(s, d, "customer")
    total = c.agg(F.sum("c_acctbal").alias("t"))
    w = c.crossJoin(F.broadcast(total)).select((F.col("c_acctbal") / F.col("t")).alias("w"))  # one row
    return w.agg(F.when(F.abs(F.sum("w") - 1) < 1e-4, "PASS").otherwise("FAIL").alias("verdict"), F.count("*").alias("n"))


@query("SELECT denue_id, CASE WHEN length(ageb_id) >= 13 THEN ageb_id ELSE lpad(ageb_id, 13, '0') END AS padded, cve_ent || CASE WHEN length(cve_mun) >= 3 THEN cve_mun ELSE lpad(cve_mun, 3, '0') END AS municipality FROM denue")
def prj_zfill(s, d):
    return T(s, d, "denue").select("denue_id", zfill(F.col("ageb_id"), 13).alias("padded"), F.concat("cve_ent", zfill(F.col("cve_mun"), 3)).alias("municipality"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT cvegeo, count(*) AS n FROM ageb WHERE cve_mun IN ('039', '070', '097', '098', '101', '120') GROUP BY cvegeo")
def flt_in_list(s, d):
    return T(s, d, "ageb").where(F.col("cve_mun").isin("039", "070", "097", "098", "101", "120")).groupBy("cvegeo").agg(F.count("*").alias("n"))


@query("SELECT denue_id, estrato_personal FROM denue WHERE estrato_personal NOT IN ('0 a 5 personas', '6 a 10 personas')")
def flt_not_in_null(s, d):
    return T(s, d, "denue").where(~F.col("estrato_personal").isin(*SMALL_CLASSES)).select("denue_id", "estrato_personal")


@query("SELECT cvegeo FROM ageb WHERE cve_ageb NOT LIKE '%A%' UNION ALL SELECT clee FROM denue WHERE scian_codigo LIKE '46%'")
def flt_like(s, d):
    zones = T(s, d, "ageb").where(~F.col("cve_ageb").like("%A%")).select("cvegeo")
    return zones.union(T(s, d, "denue").where(F.startswith("scian_codigo", F.lit("46"))).select("clee"))


@query("SELECT stop_id, stop_name FROM gtfs_stops WHERE stop_name ILIKE '%calle%'")
def flt_ilike(s, d):
    return T(s, d, "gtfs_stops").where(F.col("stop_name").ilike("%calle%")).select("stop_id", "stop_name")


@query("SELECT denue_id, longitud, latitud FROM denue WHERE longitud BETWEEN -103.4 AND -103.3 AND latitud BETWEEN 20.6 AND 20.7 AND cve_ent = '14'")
def flt_range(s, d):
    return T(s, d, "denue").where(F.col("longitud").between(-103.4, -103.3) & F.col("latitud").between(20.6, 20.7) & (F.col("cve_ent") == "14")).select("denue_id", "longitud", "latitud")


@query("SELECT run_id, ageb_id, score_lgbm FROM ageb_suitability_predictions WHERE score_rf IS NOT NULL AND score_lgbm IS NOT NULL")
def flt_null(s, d):
    return T(s, d, "ageb_suitability_predictions").where("score_rf is not null and score_lgbm is not null").select("run_id", "ageb_id", "score_lgbm")


@query("SELECT DISTINCT cvegeo FROM ageb WHERE geom.kind IN ('POLYGON', 'MULTIPOLYGON')")
def flt_geomtype(s, d):
    return T(s, d, "ageb").where(F.col("geom.kind").isin("POLYGON", "MULTIPOLYGON")).select("cvegeo").distinct()


@query("SELECT scian_codigo, count(*) AS n FROM denue WHERE left(scian_codigo, 2) IN ('46', '61') OR scian_codigo LIKE '931%' GROUP BY scian_codigo")
def flt_left_prefix(s, d):
    return T(s, d, "denue").where(F.left("scian_codigo", F.lit(2)).isin("46", "61") | F.startswith("scian_codigo", F.lit("931"))).groupBy("scian_codigo").agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jn_inner_equi(s, d):
    joined = T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def jn_left_equi(s, d):
    n = T(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return T(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.units, b.slopes FROM (SELECT ageb_id AS k, count(*) AS units FROM denue WHERE ageb_id IS NOT NULL GROUP BY 1) a FULL OUTER JOIN (SELECT ageb_id AS k, count(slope_mean) AS slopes FROM ageb_topography WHERE ageb_id IS NOT NULL GROUP BY 1) b ON a.k = b.k")
def jn_full_outer(s, d):
    a = T(s, d, "denue").where("ageb_id is not null").groupBy(F.col("ageb_id").alias("k")).agg(F.count("*").alias("units"))
    b = T(s, d, "ageb_topography").where("ageb_id is not null").groupBy(F.col("ageb_id").alias("k")).agg(F.count("slope_mean").alias("slopes"))
    return a.join(b, "k", "full")


@query("SELECT s_suppkey, round(s_acctbal / m, 8) AS share FROM supplier CROSS JOIN (SELECT max(s_acctbal) AS m FROM supplier)")
def jn_cross(s, d):
    top = T(s, d, "supplier").agg(F.max("s_acctbal").alias("m"))
    return T(s, d, "supplier").crossJoin(F.broadcast(top)).select("s_suppkey", F.round(F.col("s_acctbal") / F.col("m"), 8).alias("share"))  # one row


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def jn_anti_not_in(s, d):
    return T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def jn_semi_exists(s, d):
    return T(s, d, "supplier").join(T(s, d, "lineitem").where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT k, 'zones' AS only_in FROM (SELECT cvegeo AS k FROM ageb EXCEPT SELECT ageb_id FROM ageb_topography) UNION ALL SELECT k, 'slopes' FROM (SELECT ageb_id AS k FROM ageb_topography EXCEPT SELECT cvegeo FROM ageb)")
def jn_anti_set_diff(s, d):
    zones, slopes = T(s, d, "ageb").select(F.col("cvegeo").alias("k")).distinct(), T(s, d, "ageb_topography").select(F.col("ageb_id").alias("k")).distinct()
    return zones.join(slopes, "k", "left_anti").withColumn("only_in", F.lit("zones")).union(slopes.join(zones, "k", "left_anti").withColumn("only_in", F.lit("slopes")))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('O')")
def jn_left_then_where(s, d):
    return T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").where(~F.col("o_orderstatus").isin("O")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def jn_left_on_filter(s, d):
    done = T(s, d, "orders").where("o_orderstatus = 'F'")
    return T(s, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("WITH z AS (SELECT DISTINCT cvegeo FROM ageb), m AS (SELECT cve_mun, count(*) AS n FROM denue GROUP BY cve_mun) SELECT cvegeo, n FROM z LEFT JOIN m ON substr(cvegeo, 3, 3) = cve_mun")
def jn_broadcast_municipality(s, d):
    per = T(s, d, "denue").groupBy("cve_mun").agg(F.count("*").alias("n"))
    return T(s, d, "ageb").select("cvegeo").distinct().join(per, F.substring("cvegeo", 3, 3) == F.col("cve_mun"), "left").select("cvegeo", "n")


@query("SELECT p_partkey, round(p_size * (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey < 10) + p_retailprice * (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey >= 10), 4) AS score FROM part")
def jn_lookup_scalar(s, d):
    weights = T(s, d, "supplier").agg(F.avg(F.when(F.col("s_nationkey") < 10, F.col("s_acctbal"))).alias("a"), F.avg(F.when(F.col("s_nationkey") >= 10, F.col("s_acctbal"))).alias("b"))
    return T(s, d, "part").crossJoin(F.broadcast(weights)).select("p_partkey", F.round(F.col("p_size") * F.col("a") + F.col("p_retailprice") * F.col("b"), 4).alias("score"))  # one row


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT cve_mun, count(*) FILTER (WHERE scian_codigo LIKE '31%' OR scian_codigo LIKE '32%' OR scian_codigo LIKE '33%') AS manufacturing, count(*) FILTER (WHERE scian_codigo LIKE '46%') AS retail, count(*) FILTER (WHERE scian_codigo LIKE '61%') AS education, count(*) AS n FROM denue GROUP BY cve_mun")
def agg_count_filter(s, d):
    sector = first_prefix(F.col("scian_codigo"), SECTOR_PREFIXES)
    return T(s, d, "denue").groupBy("cve_mun").agg(*[F.count_if(sector == x).alias(x) for x in ("manufacturing", "retail", "education")], F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def agg_count_record(s, d):
    return T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT cve_mun, count(latitud) AS located, count(razon_social) AS named, count(*) AS n FROM denue GROUP BY cve_mun")
def agg_count_col(s, d):
    return T(s, d, "denue").groupBy("cve_mun").agg(F.count("latitud").alias("located"), F.count("razon_social").alias("named"), F.count("*").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def agg_count_distinct(s, d):
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query(f"SELECT cve_mun, sum({_sql_jobs('estrato_personal')}) AS jobs FROM denue GROUP BY cve_mun")
def agg_sum_case(s, d):
    return T(s, d, "denue").groupBy("cve_mun").agg(F.sum(mapped(F.col("estrato_personal"), JOBS_BY_CLASS)).alias("jobs"))


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 6) AS mean, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_min_max_avg(s, d):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return T(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.round(revenue, 2).alias("revenue")
    )


@query("SELECT event_type, round(var_pop(value), 6) AS var_p, round(stddev_pop(value), 6) AS sd_p, round(stddev_samp(value), 6) AS sd_s FROM events GROUP BY event_type")
def agg_variance(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.round(F.var_pop("value"), 6).alias("var_p"), F.round(F.stddev_pop("value"), 6).alias("sd_p"), F.round(F.stddev_samp("value"), 6).alias("sd_s"))


@query("SELECT l_suppkey, round(coalesce(covar_pop(l_quantity, l_extendedprice) / nullif(sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)), 0), 0), 6) AS r FROM lineitem GROUP BY l_suppkey")
def agg_corr(s, d):
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(safe_corr(F.col("l_quantity"), F.col("l_extendedprice"), 0.0), 6).alias("r"))


_MATRIX = ["n_street_density_n", "p_poi_density_n", "pe_marginacion_n", "v_ntl_median_n"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cluster_profiles WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :]))
def agg_corr_matrix(s, d):
    """All pairs in one pass, then one row per pair."""
    pairs = [(a, b) for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :]]
    one = T(s, d, "cluster_profiles").agg(*[safe_corr(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{k}", 6).alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


@query("SELECT denue_id, count(*) AS n FROM denue GROUP BY denue_id HAVING count(*) > 1")
def agg_having(s, d):
    return T(s, d, "denue").groupBy("denue_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT " + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in ("razon_social", "latitud", "ageb_id", "estrato_personal")) + ", count(*) AS n FROM denue")
def agg_null_count(s, d):
    return T(s, d, "denue").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("razon_social", "latitud", "ageb_id", "estrato_personal")], F.count("*").alias("n"))


@query("SELECT coalesce(estrato_personal, '<NULL>') AS class, left(scian_codigo, 3) AS branch, count(*) AS n FROM denue GROUP BY 1, 2")
def agg_group_ordinal(s, d):
    return s.sql("SELECT coalesce(estrato_personal, '<NULL>') AS class, left(scian_codigo, 3) AS branch, count(*) AS n FROM {denue} GROUP BY 1, 2", denue=T(s, d, "denue"))


@query("SELECT count(*) AS conflicting FROM (SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size HAVING count(DISTINCT p_type) > 1)")
def agg_nunique_by_vector(s, d):
    return T(s, d, "part").groupBy("p_brand", "p_size").agg(F.count_distinct("p_type").alias("k")).where("k > 1").agg(F.count("*").alias("conflicting"))


@query("SELECT user_id, count(*) FILTER (WHERE value >= 50) AS large, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS deeds FROM events GROUP BY user_id")
def agg_custom_lambda(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 50).alias("large"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("deeds"))


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, entropy): natural-log entropy of the category's shares per key, nulls not counted; 0 for one category.

    Counts per category first, so the shuffle carries one row per key and category.
    """
    counts = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("_c"))
    total, weighted = F.sum("_c"), F.sum(F.col("_c") * F.log(F.col("_c").cast("double")))
    return counts.groupBy(*keys).agg(F.when(F.count("*") <= 1, 0.0).otherwise(F.log(total.cast("double")) - weighted / total).alias("entropy"))


@query(f"""WITH c AS (SELECT cve_mun, {_sql_sector('scian_codigo')} AS k, count(*) AS c FROM denue GROUP BY 1, 2), t AS (SELECT cve_mun, sum(c) AS t, count(*) AS kinds FROM c GROUP BY 1)
SELECT cve_mun, round(CASE WHEN any_value(kinds) <= 1 THEN 0 ELSE -sum(c / t * ln(c / t)) END, 6) AS entropy FROM c JOIN t USING (cve_mun) GROUP BY cve_mun""")
def agg_entropy(s, d):
    labelled = T(s, d, "denue").select("cve_mun", first_prefix(F.col("scian_codigo"), SECTOR_PREFIXES).alias("sector"))
    return entropy(labelled, ["cve_mun"], "sector").withColumn("entropy", F.round("entropy", 6))


@query("SELECT ageb_id, round(median(slope_mean), 6) AS mid, round(avg(slope_mean), 6) AS mean, max(slope_mean) AS top FROM ageb_topography WHERE slope_mean > 0 AND NOT isnan(slope_mean) GROUP BY ageb_id")
def agg_median(s, d):
    sound = T(s, d, "ageb_topography").where((F.col("slope_mean") > 0) & ~F.isnan("slope_mean"))
    return sound.groupBy("ageb_id").agg(F.round(F.median("slope_mean"), 6).alias("mid"), F.round(F.avg("slope_mean"), 6).alias("mean"), F.max("slope_mean").alias("top"))


@query("SELECT run_id, round(avg(p_poi_density_n), 9) AS poi, round(avg(pe_marginacion_n), 9) AS marginacion FROM cluster_profiles GROUP BY run_id")
def agg_groupby_mean(s, d):
    return T(s, d, "cluster_profiles").groupBy("run_id").agg(F.round(F.avg("p_poi_density_n"), 9).alias("poi"), F.round(F.avg("pe_marginacion_n"), 9).alias("marginacion"))


@query("SELECT run_id, class_rf, count(*) AS n, sum(class_lgbm)::BIGINT AS agreed, round(avg(CASE WHEN isnan(score_lgbm) THEN NULL ELSE score_lgbm END), 6) AS mean FROM ageb_suitability_predictions GROUP BY run_id, class_rf")
def agg_multi_level(s, d):
    return T(s, d, "ageb_suitability_predictions").groupBy("run_id", "class_rf").agg(F.count("*").alias("n"), F.sum("class_lgbm").alias("agreed"), F.round(F.avg(nan_to_null(F.col("score_lgbm"))), 6).alias("mean"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS hi FROM events GROUP BY event_type")
def agg_describe(s, d):
    q = [F.round(F.percentile("value", p), 6).alias(f"q{k}") for k, p in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return T(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("lo"), *q, F.max("value").alias("hi"))


@query("SELECT scian_nombre, count(*) AS n FROM denue GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 25")
def agg_value_counts(s, d):
    return T(s, d, "denue").groupBy("scian_nombre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("scian_nombre").asc_nulls_last()).limit(25)


@query("SELECT user_id % 25 AS municipality, round(sum(value), 4) AS total FROM events WHERE year(ts) = 2024 AND event_type ILIKE '%purch%' GROUP BY 1")
def agg_ridership_year(s, d):
    return T(s, d, "events").where((F.year("ts") == 2024) & F.col("event_type").ilike("%purch%")).groupBy((F.col("user_id") % 25).alias("municipality")).agg(F.round(F.sum("value"), 4).alias("total"))


# --- windows ---------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier")
def win_sum_over_all(s, d):
    return T(s, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey")), 8).alias("share"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS FIRST) AS r FROM part")
def win_rank_desc(s, d):
    return T(s, d, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc_nulls_first())).alias("r"))


@query("SELECT run_id, ageb_id, created_at IS NULL AS u, round(100 * percent_rank() OVER (PARTITION BY run_id ORDER BY CASE WHEN isnan(score_rf) THEN NULL ELSE score_rf END NULLS FIRST), 6) AS pct FROM ageb_suitability_predictions")
def win_percent_rank(s, d):
    # nulls first in ascending order are last in descending order
    rows = T(s, d, "ageb_suitability_predictions").select("run_id", "ageb_id", F.col("created_at").isNull().alias("u"), nan_to_null(F.col("score_rf")).alias("_score"))
    return positions(rows, ["run_id"], ["_score"], descending=True).select("run_id", "ageb_id", "u", F.round(100 * percent_rank_ascending(), 6).alias("pct"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal NULLS LAST, c_custkey) AS quartile FROM customer")
def win_ntile(s, d):
    return positions(T(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], ["c_acctbal", "c_custkey"]).select("c_custkey", tile(4).alias("quartile"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS position FROM part")
def win_rank_position(s, d):
    return T(s, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("position"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, total: int) -> DataFrame:
    """The same number of rows of each stratum, total // strata (at least 1), in the order of a hash of the key.

    A sampling operator: rank by hash within the stratum, planned as a per-partition top-k first."""
    n = max(1, df.select(*strata).distinct().count())
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(1, total // n)).drop("_r")


@query("WITH n AS (SELECT count(*) AS k FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)) SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r FROM customer), n WHERE r <= greatest(1, 1000 // k)")
def win_stratified_sample(s, d):
    return stratified_sample(T(s, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 1000).select("c_custkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS held FROM orders")
def win_stratified_split(s, d):
    return stratified_split(T(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.2).select("o_orderkey", "held")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1) % 5 AS fold FROM orders")
def win_stratified_fold(s, d):
    return stratified_folds(T(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold")


# --- sorts, limits, samples, sets ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def srt_order_by(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT profile_id, pe_rezago_n FROM cluster_profiles ORDER BY pe_rezago_n DESC NULLS LAST, profile_id LIMIT 10")
def srt_nulls_last(s, d):
    return T(s, d, "cluster_profiles").select("profile_id", "pe_rezago_n").orderBy(F.col("pe_rezago_n").desc_nulls_last(), "profile_id").limit(10)


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def srt_topk(s, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return T(s, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def srt_argmax_rows(s, d):
    part = T(s, d, "part")
    return part.join(F.broadcast(part.agg(F.max("p_size").alias("p_size"))), "p_size").select("p_partkey", "p_size")  # one row


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def smp_fixed_n(s, d):
    return T(s, d, "orders").select("o_orderkey").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(500)


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set_union_all(s, d):
    a = T(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("extra"))
    return a.unionByName(T(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("SELECT DISTINCT stop_id, geom.x AS x, geom.y AS y FROM gtfs_stops")
def set_distinct(s, d):
    return T(s, d, "gtfs_stops").select("stop_id", F.col("geom.x").alias("x"), F.col("geom.y").alias("y")).distinct()


@query("SELECT count(*) AS shared FROM (SELECT p_brand, p_size, p_type FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_brand, p_size, p_type FROM part WHERE p_partkey % 2 = 1)")
def set_intersection(s, d):
    part = T(s, d, "part")
    of = lambda r: part.where(F.col("p_partkey") % 2 == r).select("p_brand", "p_size", "p_type")
    return of(0).intersect(of(1)).agg(F.count("*").alias("shared"))


@query("SELECT ageb_id FROM ageb_suitability_predictions EXCEPT SELECT cvegeo FROM ageb")
def set_difference(s, d):
    return T(s, d, "ageb_suitability_predictions").select("ageb_id").subtract(T(s, d, "ageb").select("cvegeo"))


@query("SELECT count(*) - count(DISTINCT (denue_id, clee)) AS duplicated FROM denue")
def dup_detect(s, d):
    return T(s, d, "denue").agg((F.count("*") - F.count_distinct(F.struct("denue_id", "clee"))).alias("duplicated"))


@query("SELECT 'denue' AS tbl, column_name AS name, (row_number() OVER () - 1)::INTEGER AS place, column_type LIKE 'STRUCT%' AS nested FROM (DESCRIBE denue) UNION ALL SELECT 'ageb', column_name, (row_number() OVER () - 1)::INTEGER, column_type LIKE 'STRUCT%' FROM (DESCRIBE ageb)")
def src_catalog(s, d):
    """The columns of tables, out of their schemas: no data is read."""
    rows = [(t, f.name, i, f.dataType.typeName() == "struct") for t in ("denue", "ageb") for i, f in enumerate(T(s, d, t).schema)]
    return s.createDataFrame(rows, "tbl string, name string, place int, nested boolean")


@query("SELECT denue_id, geom.x AS lon, scian_codigo FROM denue WHERE geom.x BETWEEN -103.45 AND -103.25 AND geom.y BETWEEN 20.55 AND 20.75")
def src_parquet_s3(s, d):
    """Nested column pruning and a filter on a nested field that reaches the scan."""
    box = F.col("geom.x").between(-103.45, -103.25) & F.col("geom.y").between(20.55, 20.75)
    return T(s, d, "denue").where(box).select("denue_id", F.col("geom.x").alias("lon"), "scian_codigo")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_json_field(s, d):
    return T(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS c FROM customer")
def prj_clip(s, d):
    return T(s, d, "customer").select("c_custkey", clip(F.col("c_acctbal"), 0.0, 5000.0).alias("c"))


@query("SELECT x_6372 AS x, y_6372 AS y, ageb_id, count(*) AS n FROM denue WHERE x_6372 IS NOT NULL AND NOT isnan(x_6372) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def cmp_tie_groups(s, d):
    return T(s, d, "denue").where("x_6372 is not null and not isnan(x_6372)").groupBy(F.col("x_6372").alias("x"), F.col("y_6372").alias("y"), "ageb_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT cvegeo, cve_ent || cve_mun AS municipality, CASE WHEN length(cvegeo) = 13 THEN substr(cvegeo, 6, 4) END AS locality FROM ageb WHERE cve_ent = '14' AND cve_ageb NOT LIKE '%A%'")
def cmp_census_rollup(s, d):
    return T(s, d, "ageb").where((F.col("cve_ent") == "14") & ~F.col("cve_ageb").like("%A%")).select("cvegeo", F.concat("cve_ent", "cve_mun").alias("municipality"), F.when(F.length("cvegeo") == 13, F.substring("cvegeo", 6, 4)).alias("locality")).distinct()
