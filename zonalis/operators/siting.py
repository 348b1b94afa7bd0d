"""Scoring of stops and choice of training zones from the suitability criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators import weighting, zone_features
from zonalis.operators.ranking import percent_rank_ascending, positions, tile
from zonalis.plans.runtime import checkpointed

#: The criteria: feature, its column in the master table, and whether little of it is good.
CRITERIA = (
    ("stops_400m", "stops_400m", False), ("stops_800m", "stops_800m", False), ("min_dist_inverted", "min_stop_dist_m", True), ("employment_proxy", "employment_proxy", False),
    ("route_km_800m", "route_km_800m", False), ("slope_inverted", "slope_mean", True),
)
FEATURES = [f for f, _, _ in CRITERIA]


def normalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, criteria): every criterion against its maximum in `df`, by the criterion's name."""
    direct = {c: f"_n_{f}" for f, c, less in CRITERIA if not less}
    inverted = {c: f"_n_{f}" for f, c, less in CRITERIA if less}
    return weighting.max_normalise(df, direct, inverted).select(*keys, *[F.col(f"_n_{f}").alias(f) for f in FEATURES])


def station_audit(stops: DataFrame, of_stop: DataFrame, held: DataFrame, master: DataFrame, weights: DataFrame) -> DataFrame:
    """Every stop inside a zone of the master table with its criteria, weighted score, rank and percentile.

    `of_stop` has (stop_id, stops_400m, employment_proxy), `held` (stop_id, ageb_id); the other criteria are the zone's.
    Criteria are normalised over the stops that come out.  Of several names of a stop the last in order counts.  Ranks go
    by the score rounded to nine places, so that equal criteria tie."""
    named = stops.where("stop_id is not null").groupBy("stop_id").agg(F.max("stop_name").alias("stop_name"))
    zone = master.select("ageb_id", "stops_800m", "min_stop_dist_m", "route_km_800m", "slope_mean")
    joined = checkpointed(held.select("stop_id", "ageb_id").distinct().join(named, "stop_id").join(of_stop, "stop_id").join(zone, "ageb_id"))
    scores = weighting.weighted_score(normalised(joined, ["stop_id", "ageb_id"]), weights, {f: f for f in FEATURES}, "_score").select("stop_id", "ageb_id", F.round("_score", 9).alias("_score"))
    placed = positions(joined.join(scores, ["stop_id", "ageb_id"]), [], ["_score"], descending=True)
    return placed.select(
        "stop_id", "stop_name", "ageb_id", "stops_400m", "stops_800m", F.round("min_stop_dist_m", 2).alias("min_stop_dist_m"), "employment_proxy", F.round("route_km_800m", 2).alias("route_km_800m"),
        F.round("slope_mean", 3).alias("slope_mean"), F.round("_score", 4).alias("npv_score"), F.col("_rank").alias("npv_rank"), F.round(100 * percent_rank_ascending(), 6).alias("npv_percentile"),
    )


def training_labels(zones: DataFrame, held: DataFrame, access: DataFrame, jobs: DataFrame, positive_share: float = 0.5, seed: int = 42) -> DataFrame:
    """Labelled zones for training: every zone that holds a stop, and as many of the others as the share asks for, taken
    evenly from the 4 x 4 strata of their accessibility and employment quartiles.

    `held` has (ageb_id) of zones with a stop, which count only with both indicators; zones without a stop may lack
    employment (nulls fall into the last quartile).  A stratum gives the zones whose hashed ids come first, a sixteenth
    of what is wanted and one at least: a sampling operator."""
    at_zone = zones.join(access.select("ageb_id", "stops_400m", "stops_800m"), "ageb_id", "left").join(jobs.select("ageb_id", "employment_proxy"), "ageb_id", "left")
    marked = at_zone.join(held.select("ageb_id").distinct().withColumn("label", F.lit(1)), "ageb_id", "left").na.fill(0, ["label"])
    marked = marked.where("label = 0 or (stops_400m is not null and employment_proxy is not null)").withColumn("_reach", F.col("stops_400m") + F.col("stops_800m"))
    by_access = positions(marked, ["label"], ["_reach", "ageb_id"]).select(*marked.columns, tile(4).alias("accessibility_quartile"))
    both = checkpointed(positions(by_access, ["label"], ["employment_proxy", "ageb_id"]).select(*by_access.columns, tile(4).alias("employment_quartile")))
    n = both.where("label = 1").count()
    each = max(1, (int(n / positive_share) - n) // 16)
    strata = ["accessibility_quartile", "employment_quartile"]
    hashed = both.where("label = 0").withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), "ageb_id")))
    others = positions(hashed, strata, ["_hash", "ageb_id"]).where(F.col("_position") <= each)
    columns = ["ageb_id", "label", "stops_400m", "stops_800m", "employment_proxy", *strata]
    named = others.select(*columns, F.concat(F.lit("underserved_q"), strata[0], F.lit("_"), strata[1]).alias("stratum"))
    all_ = both.where("label = 1").select(*columns, F.lit("existing_station").alias("stratum")).unionByName(named)
    return all_.withColumn("label_str", F.when(F.col("label") == 1, "suitable").otherwise("unsuitable"))


def holding(stops: DataFrame, zones: DataFrame) -> DataFrame:
    """(stop_id, ageb_id) of the stops inside zones."""
    return zone_features.zones_of(zone_features.stop_points(stops), "stop_id", "x", "y", zones)
