"""Indicators of zones and stops: accessibility, employment, land use, and the master table they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.geometry import area
from zonalis.functions.scalars import JOBS_BY_CLASS, SECTOR_PREFIXES, SMALL_CLASSES, first_prefix, mapped, number_or, safe_ratio, zfill
from zonalis.operators.quadtree_join import point_targets, quadtree_join, region_targets
from zonalis.plans.runtime import checkpointed

#: Metres of the near and far ring around a zone, and beyond which a stop doesn't count.
NEAR, FAR, LIMIT = 400.0, 800.0, 2000.0


def zone_ids(zones: DataFrame) -> DataFrame:
    return zones.where("cvegeo is not null").select(F.col("cvegeo").alias("ageb_id")).distinct()


def located(establishments: DataFrame) -> DataFrame:
    """One row per establishment, the one loaded last, with its plane coordinates; those without a place drop out."""
    last = establishments.where("denue_id is not null").groupBy("denue_id").agg(
        F.max(F.struct("cargado_en", "scian_codigo", "estrato_personal", "x_6372", "y_6372")).alias("_e")
    )
    return last.select("denue_id", "_e.scian_codigo", "_e.estrato_personal", "_e.x_6372", "_e.y_6372").where("x_6372 is not null and not isnan(x_6372)")


def zones_of(points: DataFrame, key: str, x: str, y: str, zones: DataFrame, closed: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, ageb_id) of the points inside zones; with `closed` those on an edge too."""
    found = quadtree_join(points, key, x, y, region_targets(zones, "cvegeo", "geom", *([0.0] if closed else [])), carry=carry)
    return found.withColumnRenamed("other_id", "ageb_id")


def stop_points(stops: DataFrame) -> DataFrame:
    return stops.select("stop_id", F.col("geom.x").alias("x"), F.col("geom.y").alias("y")).where("stop_id is not null and x is not null and y is not null").distinct()


def stop_distances(stops: DataFrame, zones: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(stop_id, ageb_id, distance) of stops within `limit` of a zone, 0 inside."""
    found = quadtree_join(stop_points(stops), "stop_id", "x", "y", region_targets(zones, "cvegeo", "geom", limit), distances=True)
    # a stop with several places counts with the nearest
    return found.groupBy("stop_id", F.col("other_id").alias("ageb_id")).agg(F.min("distance").alias("distance"))


def accessibility(stops: DataFrame, zones: DataFrame) -> DataFrame:
    """(ageb_id, stops_400m, stops_800m, min_stop_dist_m) of every zone; no distance where no stop is within LIMIT."""
    per = stop_distances(stops, zones).groupBy("ageb_id").agg(
        F.count_if(F.col("distance") <= NEAR).alias("stops_400m"), F.count_if(F.col("distance") <= FAR).alias("stops_800m"), F.min("distance").alias("min_stop_dist_m")
    )
    return zone_ids(zones).join(per, "ageb_id", "left").na.fill(0, ["stops_400m", "stops_800m"])


def employers(establishments: DataFrame, zones: DataFrame, largest: int = 500) -> DataFrame:
    """(denue_id, ageb_id, sector, jobs) of the establishments above the small classes, where a class is known."""
    jobs = JOBS_BY_CLASS | {"251 y más personas": largest}
    # kept once: the join's count, sample and probe read it
    big = checkpointed(located(establishments).where(~F.col("estrato_personal").isin(*SMALL_CLASSES)))
    labelled = big.withColumns({"sector": first_prefix(F.col("scian_codigo"), SECTOR_PREFIXES), "jobs": mapped(F.col("estrato_personal"), jobs)})
    return zones_of(labelled, "denue_id", "x_6372", "y_6372", zones, closed=True, carry=("sector", "jobs"))


def economic_activity(establishments: DataFrame, zones: DataFrame) -> DataFrame:
    """Units, jobs and units by sector of every zone, 0 where there are none."""
    per = employers(establishments, zones).groupBy("ageb_id").agg(
        F.count("*").alias("units"), F.sum("jobs").alias("jobs"), *[F.count_if(F.col("sector") == s).alias(s) for s in SECTOR_PREFIXES]
    )
    return zone_ids(zones).join(per, "ageb_id", "left").na.fill(0)


def employment(establishments: DataFrame, zones: DataFrame) -> DataFrame:
    """(ageb_id, total_establishments, employment_proxy) of the zones with employers; the largest class stands for 300."""
    return employers(establishments, zones, largest=300).groupBy("ageb_id").agg(F.count("*").alias("total_establishments"), F.sum("jobs").alias("employment_proxy"))


def slopes(measured: DataFrame, no_data: float = -9999.0) -> DataFrame:
    """(ageb_id, slope_mean): the mean of a zone's sound measurements."""
    sound = measured.where(F.col("slope_mean").isNotNull() & ~F.isnan("slope_mean") & (F.col("slope_mean") != no_data))
    return sound.groupBy("ageb_id").agg(F.avg("slope_mean").alias("slope_mean"))


def master(access: DataFrame, jobs: DataFrame, measured: DataFrame, supply: DataFrame) -> DataFrame:
    """Zones with employers: accessibility, employment, kilometres of routes and mean slope (0 where there is none).

    `access`, `jobs` and `supply` come from accessibility(), employment() and line_supply.route_supply()."""
    joined = access.join(jobs.select("ageb_id", "employment_proxy"), "ageb_id").join(slopes(measured), "ageb_id", "left")
    near = supply.select(F.col("region").alias("ageb_id"), F.col("route_km_within_800m").alias("route_km_800m"))
    return joined.join(near, "ageb_id", "left").na.fill(0.0, ["slope_mean", "route_km_800m"])


def place_features(establishments: DataFrame, zones: DataFrame, entropy) -> DataFrame:
    """Densities per km2 of establishments, retail and services, jobs, and the entropy of land use, of every zone."""
    at = checkpointed(located(establishments)).withColumns({"sector": first_prefix(F.col("scian_codigo"), SECTOR_PREFIXES), "jobs": mapped(F.col("estrato_personal"), JOBS_BY_CLASS)})
    inside = zones_of(at, "denue_id", "x_6372", "y_6372", zones, carry=("sector", "jobs"))
    per = inside.groupBy("ageb_id").agg(
        F.count("*").alias("units"), F.sum("jobs").alias("jobs"), F.count_if(F.col("sector") == "retail").alias("retail"),
        F.count_if(F.col("sector").isin("health", "education", "government")).alias("service"),
    )
    sized = zones.where("cvegeo is not null").groupBy(F.col("cvegeo").alias("ageb_id")).agg((F.max(area(F.col("geom"))) / 1e6).alias("km2"))
    joined = sized.join(per, "ageb_id", "left").join(entropy(inside, ["ageb_id"], "sector"), "ageb_id", "left").na.fill(0)
    density = lambda c: safe_ratio(F.col(c), F.col("km2"))
    return joined.select("ageb_id", density("units").alias("p_poi_density"), F.col("jobs").alias("p_employment_proxy"), density("retail").alias("p_retail_density"),
                         density("service").alias("p_service_density"), F.col("entropy").alias("p_land_use_mix"))


def stop_features(establishments: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop_id, stops_400m, employment_proxy): distinct stops within NEAR of each stop, itself included, and the jobs there."""
    at = stop_points(stops)
    near = quadtree_join(at, "stop_id", "x", "y", point_targets(at, "stop_id", F.col("x"), F.col("y"), NEAR)).groupBy("stop_id").agg(F.count_distinct("other_id").alias("stops_400m"))
    emp = checkpointed(located(establishments).where(~F.col("estrato_personal").isin(*SMALL_CLASSES)).withColumn("jobs", mapped(F.col("estrato_personal"), JOBS_BY_CLASS)))
    pairs = quadtree_join(emp, "denue_id", "x_6372", "y_6372", point_targets(at, "stop_id", F.col("x"), F.col("y"), NEAR), carry=("jobs",))
    jobs = pairs.groupBy(F.col("other_id").alias("stop_id")).agg(F.sum("jobs").alias("employment_proxy"))
    return at.select("stop_id").distinct().join(near, "stop_id", "left").join(jobs, "stop_id", "left").na.fill(0)


def node_features(crossings: DataFrame, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Crossings and four-way crossings per km2, street metres per km2, of every zone.

    `crossings` holds (node, street_count, x, y), `edges` (edge, length, x, y) with the edge's midpoint, which decides
    its zone; crossings and edges on a zone's border belong to none."""
    n = zones_of(crossings, "node", "x", "y", zones, carry=("street_count",)).groupBy("ageb_id").agg(F.count("*").alias("n"), F.count_if(F.col("street_count") >= 4).alias("n4"))
    e = zones_of(edges, "edge", "x", "y", zones, carry=("length",)).groupBy("ageb_id").agg(F.sum("length").alias("metres"))
    sized = zones.where("cvegeo is not null").groupBy(F.col("cvegeo").alias("ageb_id")).agg((F.max(area(F.col("geom"))) / 1e6).alias("km2"))
    joined = sized.join(n, "ageb_id", "left").join(e, "ageb_id", "left").na.fill(0)
    return joined.select("ageb_id", safe_ratio(F.col("n"), F.col("km2")).alias("n_intersections"), safe_ratio(F.col("n4"), F.col("km2")).alias("n_intersection_density"),
                         safe_ratio(F.col("metres"), F.col("km2")).alias("n_street_density"))


def people_features(census: DataFrame, indices: DataFrame, sizes: DataFrame) -> DataFrame:
    """Population, density, dependency ratio (5 at most), share of youth and both indices of every zone in `sizes`
    (ageb_id, km2).  Census columns are texts; what is no number counts 0.  Without P_15A29 the youth are
    P_15A17 + P_18A24, or 0 where those are missing too."""
    has = set(census.columns)
    n = lambda c: number_or(F.col(c)) if c in has else F.lit(0.0)
    youth = n("P_15A29") if "P_15A29" in has else n("P_15A17") + n("P_18A24")
    key = F.concat(zfill(F.col("ENTIDAD"), 2), zfill(F.col("MUN"), 3), zfill(F.col("LOC"), 4), zfill(F.col("AGEB"), 4))
    c = census.where("MZA = '000'").select(key.alias("ageb_id"), n("POBTOT").alias("pop"), (n("POB0_14") + n("POB65_MAS")).alias("dependent"), n("POB15_64").alias("active"), youth.alias("youth"))
    per = c.groupBy("ageb_id").agg(*[F.sum(x).alias(x) for x in ("pop", "dependent", "active", "youth")])
    i = indices.select(zfill(F.col("cve_ageb"), 13).alias("ageb_id"), "im_2020", "irs_2020")
    joined = sizes.join(per, "ageb_id", "left").join(i, "ageb_id", "left").na.fill(0)
    return joined.select(
        "ageb_id", F.col("pop").alias("pe_population"), safe_ratio(F.col("pop"), F.col("km2")).alias("pe_pop_density"), F.col("im_2020").alias("pe_marginacion"), F.col("irs_2020").alias("pe_rezago"),
        safe_ratio(F.col("dependent"), F.col("active"), 1.0, 5.0).alias("pe_dep_ratio"), safe_ratio(F.col("youth"), F.col("pop"), 1.0).alias("pe_youth_share"),
    )


def vitality_features(lights: DataFrame, ridership: DataFrame, zones: DataFrame, year: int, like: str = "%pasajero%", state: str = "14") -> DataFrame:
    """(ageb_id, v_ntl_median, v_ridership_annual): a zone's median light, and the year's ridership of its municipality,
    whose number is one of `state`.  Zones without either count 0."""
    total = ridership.where((F.col("anio") == year) & F.col("variable").ilike(like)).groupBy(F.concat(F.lit(state), zfill(F.col("cve_mun").cast("string"), 3)).alias("municipality")).agg(F.sum("valor").alias("v_ridership_annual"))
    ids = zone_ids(zones).withColumn("municipality", F.left("ageb_id", F.lit(5)))
    return ids.join(lights.select("ageb_id", F.col("median").alias("v_ntl_median")), "ageb_id", "left").join(total, "municipality", "left").drop("municipality").na.fill(0)
