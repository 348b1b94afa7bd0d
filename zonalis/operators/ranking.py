"""Ranks within few or large groups, in two steps: no task sorts a whole group.

Rows are laid out by ranges of (group, order); a row's place is the number of rows of its group in earlier ranges plus
its place within its own range, and only one count per group and range is ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonalis.plans.runtime import checkpointed


def positions(df: DataFrame, groups: list[str], order: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """`df` with _position (row number from 1), _rank (the same for ties), _ties (rows with just this order) and _n (rows)
    of every row's group; nulls come last either way, null groups are groups like others.

    Among ties the positions are arbitrary: `order` should end with a key where that matters.  Ties lie in one range, so
    the rows of one value of `order` meet in one task."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c) for c in order]
    # kept: the ranges must not change between the counts and the ranks
    placed = checkpointed(df.repartitionByRange(parts, *[F.asc_nulls_last(g) for g in groups], *by).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(*groups, "__part").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*groups)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__of_part"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("_n"))
    inside = Window.partitionBy(*groups, "__part").orderBy(*by)
    ranked = placed.withColumns({"_row": F.row_number().over(inside), "_rk": F.rank().over(inside), "_ties": F.count("*").over(Window.partitionBy(*groups, "__part", *order))})
    on = F.col("__part") == F.col("__of_part")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = ranked.join(offsets, on)
    return joined.select(*df.columns, (F.col("_row") + F.col("_before")).alias("_position"), (F.col("_rk") + F.col("_before")).alias("_rank"), "_ties", "_n")


def running_sums(df: DataFrame, groups: list[str], order: str, columns: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """`df` with run_c and all_c of every column c in `columns`: its sum over the rows of the group up to a row, and over
    the whole group.  `order` must be unique within a group; null groups are groups like others."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.desc_nulls_last(order) if descending else F.asc_nulls_last(order)
    placed = checkpointed(df.repartitionByRange(parts, *[F.asc_nulls_last(g) for g in groups], by).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy(*groups, "__part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    group = Window.partitionBy(*groups)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__of_part"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(group).alias(f"all_{c}") for c in columns],
    )
    upto = Window.partitionBy(*groups, "__part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("__part") == F.col("__of_part")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.withColumns({f"_r_{c}": F.sum(c).over(upto) for c in columns}).join(offsets, on)
    return joined.select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(f"run_{c}") for c in columns], *[f"all_{c}" for c in columns])


def tile(k: int) -> Column:
    """ntile(k) of a row that positions() has placed: the first groups are larger by one where k doesn't divide n."""
    n, at = F.col("_n"), F.col("_position")
    size = F.floor(n / k)
    larger = n - size * k
    edge = larger * (size + 1)
    return F.when(at <= edge, F.ceil(at / (size + 1))).otherwise(larger + F.ceil((at - edge) / F.greatest(size, F.lit(1)))).cast("int")


def percent_rank_ascending() -> Column:
    """percent_rank() in ascending order of a row that positions() has placed in descending order."""
    below = F.col("_n") - F.col("_rank") - F.col("_ties") + 1
    return F.when(F.col("_n") > 1, below / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(0.0)


def stratified_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """`df` with a fold from 0 to folds - 1 that spreads every label evenly, in the order of a hash of the key."""
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
    return positions(hashed, [label], ["_hash", key]).select(*df.columns, ((F.col("_position") - 1) % folds).alias("fold"))


def stratified_split(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """`df` with `held`: whether a row belongs to the share of every label that is held out, rounded to whole rows."""
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string")))
    return positions(hashed, [label], ["_hash", key]).select(*df.columns, (F.col("_position") <= F.round(F.col("_n") * share)).alias("held"))
