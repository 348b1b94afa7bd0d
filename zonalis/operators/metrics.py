"""Quality figures of scores against labels, exact and tie-aware, by group; all from one aggregate per distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.operators.ranking import running_sums
from zonalis.plans.runtime import checkpointed


def _steps(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per key and distinct score, in descending order: positives and rows up to and at it, and the totals."""
    per = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("_p"), F.count("*").alias("_n"))
    # a row per distinct score, of which one key may have very many
    return running_sums(per, keys, score, ["_p", "_n"], descending=True).withColumnsRenamed({"run__p": "_tp", "run__n": "_at", "all__p": "_pos", "all__n": "_rows"})


def ranking_metrics(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, n, positives, ap, auc): average precision as the sum of recall steps times precision, ties in one step, and
    the area under the ROC with ties counted half; null where a class is missing."""
    s = _steps(df, keys, label, score)
    per = s.groupBy(*keys).agg(
        F.max("_rows").alias("n"), F.max("_pos").alias("positives"),
        F.sum(F.col("_p") * F.col("_tp") / F.col("_at")).alias("_ap"),
        F.sum((F.col("_n") - F.col("_p")) * (F.col("_tp") - F.col("_p") / 2)).alias("_area"),
    )
    neg = F.col("n") - F.col("positives")
    return per.select(*keys, "n", "positives", F.when(F.col("positives") > 0, F.col("_ap") / F.nullif("positives", F.lit(0))).alias("ap"),
                      F.when((F.col("positives") > 0) & (neg > 0), F.col("_area") / F.nullif(F.col("positives") * neg, F.lit(0))).alias("auc"))


def best_f1(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """(keys, threshold, f1): the distinct score with the greatest F1 when it and all above count as positive, the lowest
    of several; 0.5 stands where there are no scores (no row here)."""
    s = _steps(df, keys, label, score)
    f1 = F.when(F.col("_tp") > 0, 2 * F.col("_tp") / (F.col("_at") + F.col("_pos"))).otherwise(0.0)
    best = s.withColumn("_f", f1).groupBy(*keys).agg(F.max(F.struct("_f", (-F.col(score)).alias("_s"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._s")).alias("threshold"), F.col("_b._f").alias("f1"))


def binary_metrics(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """(keys, precision, recall, f1, accuracy), 0 where a denominator is."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.count_if(y & p).alias("_tp"), F.count_if(~y & p).alias("_fp"), F.count_if(y & ~p).alias("_fn"), F.count_if(~y & ~p).alias("_tn")
    )
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("_tp", "_fp", "_fn", "_tn"))
    return c.select(*keys, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def macro_metrics(df: DataFrame, keys: list[str], label: str, predicted: str) -> DataFrame:
    """(keys, accuracy, macro_precision, macro_recall, macro_f1): unweighted means over all labels seen on either side."""
    cells = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("_y").cast("string").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("h")),
        F.struct(F.col("_p").cast("string").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("q"), F.lit(0).cast("bigint").alias("h")),
    )).alias("_s")).groupBy(*keys, F.col("_s.c").alias("_c")).agg(F.sum("_s.t").alias("t"), F.sum("_s.q").alias("q"), F.sum("_s.h").alias("h"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("h") / F.nullif(F.col("t") + F.col("q"), F.lit(0)), F.lit(0.0))
    return sides.groupBy(*keys).agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(share("h", F.col("q"))).alias("macro_precision"), F.avg(share("h", F.col("t"))).alias("macro_recall"), F.avg(f1).alias("macro_f1"))


def silhouette(df: DataFrame, key: str, cluster: str, features: list[str], block: int = 32_768) -> DataFrame:
    """(silhouette): the exact mean Euclidean silhouette.

    Every pair of rows enters it by definition; rows are hashed into blocks and each pair of blocks is one task that
    returns sums per row and cluster.  Rows without a cluster or a feature are left out; rows alone in their cluster
    count 0.
    """
    sound = df.where(F.col(cluster).isNotNull())
    for f in features:
        sound = sound.where(F.col(f).isNotNull() & ~F.isnan(f))
    rows = sound.select(F.col(key).cast("string").alias("k"), F.col(cluster).cast("string").alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("at"))
    about = rows.agg(F.count("*").alias("n"), F.count_distinct("c").alias("kinds"), F.array(*[F.avg(F.col("at")[i]) for i in range(len(features))]).alias("mean")).first()
    if 0 < about["kinds"] <= FEW_CLUSTERS:
        parts = _sums_of_blocks(rows, about["n"], about["mean"], min(block, max(1, 4_194_304 // (8 * max(1, len(features))))))
    else:
        parts = _sums_of_pairs(rows, about["n"])
    per = parts.groupBy("k", "c", "o").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.max(F.when((F.col("c") == F.col("o")) & (F.col("n") > 1), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))))
    near = F.min(F.when(F.col("c") != F.col("o"), F.col("d") / F.col("n")))
    both = per.groupBy("k", "c").agg(own.alias("a"), near.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return both.agg(F.avg(value).alias("silhouette"))


#: Clusters up to which every row carries its sums to all of them as one array.
FEW_CLUSTERS = 64
#: Rows and columns of the distances made at once.
TILE = (256, 1024)


def _distances(p, q, p2, q2):
    """Euclidean distances by one product of matrices; what that would leave inexact, pairs far nearer to each other than
    to the centre, by differences."""
    import numpy as np

    d = np.column_stack([p, p2, np.ones(len(p))]) @ np.vstack([-2 * q.T, np.ones(len(q)), q2])
    unsure = 1e-8 * (p2.max() + q2.max())
    if not d.min() > unsure:
        i, j = np.nonzero(~(d > unsure))
        if len(i) * 8 <= d.size:
            d[i, j] = ((p[i] - q[j]) ** 2).sum(1)
        else:
            d[:] = 0.0
            for f in range(p.shape[1]):
                d += (p[:, f, None] - q[None, :, f]) ** 2
    return np.sqrt(d, out=d)


def _sums_of_blocks(rows: DataFrame, n: int, mean: list[float], block: int) -> DataFrame:
    """(k, c, o, d, n): per row and cluster o the sum of distances to its rows and their number.  Blocks are packed into one
    row each, and a pair of blocks is compared once for both."""
    import numpy as np
    import pyarrow as pa

    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    names, k, centre, width = sorted(sizes), len(sizes), np.array(mean), len(mean)
    blocks = max(-(-n // block), min(8, -(-n // 2000)))

    def packed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at = t["at"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) - centre
        codes = np.searchsorted(np.array(names, object), np.array(t["c"].to_pylist(), object)).astype(np.int32)
        return pa.table({"b": t["b"][:1], "k": pa.array([t["k"].to_pylist()], pa.list_(pa.string())), "codes": pa.array([codes.tobytes()], pa.binary()), "at": pa.array([at.tobytes()], pa.binary())})

    kept = checkpointed(rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(packed, "b int, k array<string>, codes binary, at binary"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = kept.select("b", "codes", "at", other.alias("o")).select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "codes", "at")

    def sums(t: pa.Table) -> pa.Table:
        ids = t["b"].to_pylist()
        sides = []
        for codes, at in zip(t["codes"].to_pylist(), t["at"].to_pylist()):
            p = np.frombuffer(at, float).reshape(-1, width)
            sides.append((p, (p**2).sum(1), np.eye(k)[np.frombuffer(codes, np.int32)], np.zeros((len(p), k))))
        self_ = t["x"][0].as_py() == t["y"][0].as_py()
        if len(sides) == 1 and not self_:  # the other block is empty
            return pa.table({"b": pa.array([], pa.int32()), "sums": pa.array([], pa.binary())})
        (p, p2, p_hot, p_out), (q, q2, q_hot, q_out) = sides[0], sides[-1]
        for i in range(0, len(p), TILE[0]):
            for j in range(0, len(q), TILE[1]):
                a, b = slice(i, i + TILE[0]), slice(j, j + TILE[1])
                d = _distances(p[a], q[b], p2[a], q2[b])
                p_out[a] += d @ q_hot[b]
                if not self_:
                    q_out[b] += d.T @ p_hot[a]
        return pa.table({"b": pa.array(ids, pa.int32()), "sums": pa.array([s[3].tobytes() for s in sides], pa.binary())})

    pairs = copies.repartition(blocks * (blocks + 1) // 2, "x", "y").groupBy("x", "y").applyInArrow(sums, "b int, sums binary")

    def added(t: pa.Table) -> pa.Table:
        own = t.filter(t["k"].is_valid())
        total = sum(np.frombuffer(s, float) for s in t["sums"].drop_null().to_pylist()).reshape(-1, k)
        keys, c = own["k"].combine_chunks().flatten(), pa.array(names, pa.string()).take(pa.array(np.frombuffer(own["codes"][0].as_py(), np.int32)))
        return pa.concat_tables([pa.table({"k": keys, "c": c, "o": pa.array([o] * len(c), pa.string()), "d": pa.array(total[:, i]), "n": pa.array([sizes[o]] * len(c), pa.int64())}) for i, o in enumerate(names)])

    both = kept.select("b", "k", "codes", F.lit(None).cast("binary").alias("sums")).unionByName(pairs.select("b", F.lit(None).cast("array<string>").alias("k"), F.lit(None).cast("binary").alias("codes"), "sums"))
    return both.groupBy("b").applyInArrow(added, "k string, c string, o string, d double, n bigint")


def _sums_of_pairs(rows: DataFrame, count: int, block: int = 2000) -> DataFrame:
    """_sums_of_blocks() for any number of clusters, a row per row, cluster and pair of blocks."""
    import numpy as np
    import pyarrow as pa

    n = max(1, -(-count // block))
    mine = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    copies = rows.withColumn("_h", mine).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o"))
    asks = copies.select("k", "c", "at", F.col("_h").alias("a"), F.col("_o").alias("b"), F.lit(True).alias("asks"))
    gives = copies.select("k", "c", "at", F.col("_o").alias("a"), F.col("_h").alias("b"), F.lit(False).alias("asks"))

    def sums(t: pa.Table) -> pa.Table:
        asking = t["asks"].to_numpy()
        at = t["at"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        p, q = at[asking], at[~asking]
        ids, c = t["k"].filter(pa.array(asking)), t["c"].filter(pa.array(asking))
        other = t["c"].filter(pa.array(~asking)).combine_chunks().dictionary_encode()
        names, codes = other.dictionary.to_pylist(), other.indices.to_numpy()
        out = {"k": [], "c": [], "o": [], "d": [], "n": []}
        if len(p) and len(q):
            per = np.zeros((len(p), len(names)))
            hot = np.eye(len(names))[codes]
            for s in range(0, len(p), 256):
                per[s : s + 256] = np.sqrt(((p[s : s + 256, None] - q[None]) ** 2).sum(2)) @ hot
            sizes = hot.sum(0)
            for j, name in enumerate(names):
                out["k"] += ids.to_pylist()
                out["c"] += c.to_pylist()
                out["o"] += [name] * len(p)
                out["d"] += per[:, j].tolist()
                out["n"] += [int(sizes[j])] * len(p)
        return pa.table({"k": pa.array(out["k"], pa.string()), "c": pa.array(out["c"], pa.string()), "o": pa.array(out["o"], pa.string()), "d": pa.array(out["d"], pa.float64()), "n": pa.array(out["n"], pa.int64())})

    parts = asks.unionByName(gives).groupBy("a", "b").applyInArrow(sums, "k string, c string, o string, d double, n bigint")
    return parts
