"""Score cutoffs that keep a target share of each source's records.

A rank-error-bounded sketch per source (quantiles.py) brackets the cutoff between two scores; a second pass over the
records counts what lies above the bracket and the scores and ties inside it, which makes the cutoff exact.  Sketches
are built per partition and merged, counts combined per partition.  The records meet the few values of their source by
a broadcast, so that they aren't shuffled; with more sources than are broadcast, hot ones are spread over salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.llm.quantiles import build_sketches
from zonalis.plans.runtime import checkpointed, keyed_join


def latest_scores(scores: DataFrame, keys: list[str], score: str, at: str) -> DataFrame:
    """The row with the latest `at` of each key, where its score is a number: (keys, score).

    Of rows equally late the one with the highest score counts, a number before null or NaN; a null time is the
    earliest.  Null keys are keys like others.  A key whose latest row has no score drops out.
    """
    number = F.when(~F.isnan(score), F.col(score).cast("double"))
    last = scores.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("t"), number.isNotNull().alias("ok"), number.alias("s"))).alias("_last"))
    return last.where("_last.ok").select(*keys, F.col("_last.s").alias(score))


def brackets(latest: DataFrame, source: str, score: str, targets: DataFrame, percent: str) -> DataFrame:
    """(source, n, need, low, high): the cutoff lies within [low, high]; need is how many records must reach it."""
    sketches = build_sketches(latest, [source], score)
    goal = targets.where(F.col(percent).isNotNull()).select(F.col(source), F.col(percent).cast("long").alias("_pct")).groupBy(source).agg(F.max("_pct").alias("_pct"))
    per = sketches.groupBy(source).agg(
        F.sum("n").alias("n"), F.sum("error").alias("_error"),
        F.array_sort(F.flatten(F.collect_list(F.transform("vals", lambda v: F.struct(v.alias("v"), F.col("weight").alias("w")))))).alias("_all"),
    )
    joined = per.join(goal, source)
    need = F.greatest(F.lit(1), F.least(F.col("n"), F.floor((F.col("_pct") * F.col("n") + 99) / 100))).cast("long")
    # the cutoff is the value of ascending rank n - need + 1; the sketch's cumulative weights are off by _error at most
    rank = F.col("n") - F.col("need") + 1
    walk = F.expr("aggregate(_all, struct(cast(0 as bigint) as c, array(cast(null as double)) as low, cast(null as double) as high), (a, e) -> struct(a.c + e.w as c, "
                  "case when a.c + e.w <= _rank - _error - 1 then array(e.v) else a.low end as low, "
                  "case when a.high is null and a.c >= _rank + _error then e.v else a.high end as high))")  # fmt: skip
    found = joined.withColumn("need", need).withColumn("_rank", rank).withColumn("_walk", walk)
    return found.select(source, "n", "need", F.coalesce(F.col("_walk.low")[0], F.lit(float("-inf"))).alias("low"), F.coalesce("_walk.high", F.lit(float("inf"))).alias("high"))


def cutoffs(latest: DataFrame, source: str, score: str, targets: DataFrame, percent: str) -> DataFrame:
    """(source, n, cutoff, kept, ties): per source with a target, the largest score that at least `percent` per cent
    of its n records reach, how many reach it and how many have just that score.

    Sources without a target or without records have no row; a share of 0 keeps those with the top score, one above
    100 counts as 100.  Repeated targets of a source count as the largest.  The result is checkpointed.
    """
    bracket = brackets(latest, source, score, targets, percent)
    # no more sources than rows of targets
    inside = keyed_join(latest.select(source, score), bracket, source, targets.count()).where(F.col(score) >= F.col("low"))
    clipped = F.when(F.col(score) > F.col("high"), F.lit(None)).otherwise(F.col(score))
    counts = inside.groupBy(source, "n", "need", clipped.alias("_score")).agg(F.count("*").alias("_n"))
    # a null score stands for all above the bracket; within it there are as many scores as the sketch's bound lets be
    down = Window.partitionBy(source).orderBy(F.col("_score").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reach = counts.withColumn("_reach", F.sum("_n").over(down)).where(F.col("_score").isNotNull() & (F.col("_reach") >= F.col("need")))
    best = reach.groupBy(source, "n").agg(F.max(F.struct("_score", F.col("_reach"), F.col("_n"))).alias("_b"))
    return checkpointed(best.select(source, "n", F.col("_b._score").alias("cutoff"), F.col("_b._reach").alias("kept"), F.col("_b._n").alias("ties")))


def kept(latest: DataFrame, source: str, score: str, found: DataFrame) -> DataFrame:
    """The records at or above their source's cutoff; `found` comes from cutoffs()."""
    return keyed_join(latest, found.select(source, "cutoff"), source, found.count()).where(F.col(score) >= F.col("cutoff")).drop("cutoff")
