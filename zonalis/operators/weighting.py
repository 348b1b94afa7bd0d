"""Normalisation of criteria and objective criterion weights (CRITIC in two forms, entropy, and their mean).

Every statistic comes from one wide aggregate of the table; what follows works on a row per criterion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.functions.scalars import safe_corr


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """`df` beside the one row of a global aggregate."""
    return df.crossJoin(F.broadcast(row))


def max_normalise(df: DataFrame, direct: dict[str, str], inverted: dict[str, str], ref: DataFrame | None = None) -> DataFrame:
    """x / max, and (max - x) / max for `inverted`; 0 where the maximum isn't positive.  Keys are columns, values the
    new names; the maxima are those of `ref`."""
    names = [*direct, *inverted]
    tops = (ref or df).agg(*[F.max(F.col(c)).alias(f"_max_{c}") for c in names])
    top = lambda c: F.col(f"_max_{c}")
    joined = _with_row(df, tops)
    for c, to in direct.items():
        joined = joined.withColumn(to, F.when(top(c) > 0, F.col(c) / F.when(top(c) > 0, top(c))).otherwise(0.0))
    for c, to in inverted.items():
        joined = joined.withColumn(to, F.when(top(c) > 0, (top(c) - F.col(c)) / F.when(top(c) > 0, top(c))).otherwise(0.0))
    return joined.drop(*[f"_max_{c}" for c in names])


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min) after nulls became 0; 0 for constant columns."""
    filled = df.na.fill(0, columns)
    ends = filled.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    scaled = _with_row(filled, ends)
    return scaled.withColumns({c: F.when(span(c) > 0, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span(c) > 0, span(c))).otherwise(0.0) for c in columns}).drop(
        *[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns]
    )


def _long(one: DataFrame, columns: list[str], values: dict[str, dict[str, Column]]) -> DataFrame:
    """The one row turned into a row per criterion: (feature, *values)."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[v[c].alias(k) for k, v in values.items()]) for c in columns])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def _statistics(df: DataFrame, columns: list[str], default: float | None) -> DataFrame:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.agg(
        *[F.var_pop(c).alias(f"var{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"sd{i}") for i, c in enumerate(columns)],
        *[safe_corr(F.col(columns[i]), F.col(columns[j]), default).alias(f"r{i}_{j}") for i, j in pairs],
    )


def _normalised(long: DataFrame, weight: str) -> DataFrame:
    # as many rows as criteria
    all_, down = Window.partitionBy(), Window.orderBy(F.col(weight).desc_nulls_first())
    return long.withColumn("weight_normalized", F.col(weight) / F.sum(weight).over(all_)).withColumn("feature_rank", F.rank().over(down))


def critic(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance, avg_abs_correlation, weight_unnormalized, weight_normalized, feature_rank).

    Weight: population variance (0.001 where there is none) times 1 less the mean |r| with the other criteria, or 1 where
    that mean isn't positive; r of a constant column is 0."""
    one, n = _statistics(df, columns, 0.0), len(columns)
    r = lambda i, j: F.col(f"r{min(i, j)}_{max(i, j)}")
    mean_r = {c: sum((F.abs(r(i, j)) for j in range(n) if j != i), F.lit(0.0)) / (n - 1) for i, c in enumerate(columns)}
    long = _long(one, columns, {"variance": {c: F.col(f"var{i}") for i, c in enumerate(columns)}, "avg_abs_correlation": mean_r})
    share = F.when(F.col("avg_abs_correlation") > 0, 1 - F.col("avg_abs_correlation")).otherwise(1.0)
    return _normalised(long.withColumn("weight_unnormalized", share * F.coalesce("variance", F.lit(0.001))), "weight_unnormalized")


def critic_contrast(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, critic_weight): sample deviation times the sum of 1 - r over all criteria, pairs without r left out."""
    one, n = _statistics(df, columns, None), len(columns)
    term = lambda i, j: F.lit(0.0) if i == j else F.coalesce(1 - F.col(f"r{min(i, j)}_{max(i, j)}"), F.lit(0.0))
    contrast = {c: F.col(f"sd{i}") * sum((term(i, j) for j in range(n)), F.lit(0.0)) for i, c in enumerate(columns)}
    long = _long(one, columns, {"_c": contrast})
    return long.select("feature", (F.coalesce("_c", F.lit(0.0)) / F.sum("_c").over(Window.partitionBy())).alias("critic_weight"))


def entropy_weights(df: DataFrame, columns: list[str], shift: float = 1e-6) -> DataFrame:
    """(feature, ewm_weight): 1 less the entropy of the shifted values' shares over ln n, normalised.

    With S the sum of the shifted values x, the entropy is ln S - sum(x ln x) / S: one pass."""
    x = lambda c: F.col(c) + shift
    one = df.agg(F.count("*").alias("_n"), *[F.sum(x(c)).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(x(c) * F.log(x(c))).alias(f"e{i}") for i, c in enumerate(columns)])
    spread = {c: 1 - (F.log(f"s{i}") - F.col(f"e{i}") / F.col(f"s{i}")) / F.log(F.col("_n").cast("double")) for i, c in enumerate(columns)}
    long = _long(one, columns, {"_d": spread})
    return long.select("feature", (F.col("_d") / F.sum("_d").over(Window.partitionBy())).alias("ewm_weight"))


def ensemble(df: DataFrame, columns: list[str], dimensions: dict[str, str]) -> DataFrame:
    """(feature, dimension, critic_weight, ewm_weight, ensemble_weight); the dimension goes by the name's first part."""
    both = critic_contrast(df, columns).join(entropy_weights(df, columns), "feature")
    prefix = F.split("feature", "_")[0]
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in dimensions.items() for v in kv]), prefix), F.upper(prefix))
    return both.select("feature", named.alias("dimension"), "critic_weight", "ewm_weight", ((F.col("critic_weight") + F.col("ewm_weight")) / 2).alias("ensemble_weight"))


def weighted_score(df: DataFrame, weights: DataFrame, columns: dict[str, str], to: str) -> DataFrame:
    """`df` with the sum of column times weight; `columns` maps a column to its feature, features without weight count 0."""
    wide = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight_normalized"))).alias("_w"))  # one row of as many entries as criteria
    total = sum((F.col(c) * F.coalesce(F.try_element_at("_w", F.lit(f)), F.lit(0.0)) for c, f in columns.items()), F.lit(0.0))
    return _with_row(df, wide).withColumn(to, total).drop("_w")
