"""Clustering, components, tree models and their explanation, on MLlib."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.operators import forest, metrics
from zonalis.operators.metrics import silhouette
from zonalis.operators.ranking import positions, stratified_folds
from zonalis.plans.runtime import checkpointed


def assembled(df: DataFrame, features: list[str], to: str = "features") -> DataFrame:
    """`df` with the vector of its features, nulls and NaN as 0."""
    clean = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol=to).transform(clean)


def kmeans(df: DataFrame, features: list[str], k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """`df` with `cluster_id`, the best of several starts; clusters are numbered by size, then by their centre."""
    data = checkpointed(assembled(df, features, "_f"))
    with ThreadPool(4) as pool:  # some starts at once
        fits = pool.map(lambda i: KMeans(k=k, seed=seed + i, featuresCol="_f", predictionCol="_c").fit(data), range(starts))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    sizes, centres = best.summary.clusterSizes, [c.tolist() for c in best.clusterCenters()]
    order = {old: new for new, old in enumerate(sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i])))}
    names = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return best.transform(data).withColumn("cluster_id", names[F.col("_c")]).drop("_f", "_c")


def select_k(df: DataFrame, key: str, features: list[str], ks: range = range(3, 9), starts: int = 3) -> tuple[int, dict[int, float]]:
    """The number of clusters with the greatest exact silhouette, the smallest of several, and all silhouettes.  Every
    silhouette compares all pairs of rows: for tables of the size of a study area's zones."""
    scores = {k: silhouette(kmeans(df, features, k, starts), key, "cluster_id", features).first()[0] for k in ks}
    return max(scores, key=lambda k: (scores[k], -k)), scores


def cluster_profiles(clustered: DataFrame, features: list[str]) -> DataFrame:
    """(cluster_id, typology_name, size, mean of each feature)."""
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(f).alias(f) for f in features]).withColumn("typology_name", F.concat(F.lit("Typology "), F.char(F.col("cluster_id") + 65)))


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """`df` with pc1 to pck of the centred features, and the shares of variance they explain; each component's largest
    loading is positive."""
    data = assembled(df, features, "_v")
    scaled = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_s").fit(data).transform(data)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    out = model.transform(scaled).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *[(F.col("_a")[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)]), model.explainedVariance.toArray().tolist()


def random_forest(df: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 16, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, labelCol="_y", featuresCol="_f").fit(assembled(df, features, "_f").withColumn("_y", F.col(label).cast("double")))


def boosted(df: DataFrame, features: list[str], label: str, rounds: int = 350, step: float = 0.05, depth: int = 5, share: float = 0.9, seed: int = 42):
    """Two classes; the library grows its trees level by level."""
    return GBTClassifier(maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=share, seed=seed, labelCol="_y", featuresCol="_f").fit(assembled(df, features, "_f").withColumn("_y", F.col(label).cast("double")))


def boosted_multiclass(df: DataFrame, features: list[str], label: str, rounds: int = 300, step: float = 0.05, depth: int = 6, seed: int = 42):
    one = GBTClassifier(maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)
    return OneVsRest(classifier=one, labelCol="_y", featuresCol="_f", parallelism=4).fit(assembled(df, features, "_f").withColumn("_y", F.col(label).cast("double")))


def scored(model, df: DataFrame, features: list[str], to: str = "score") -> DataFrame:
    """`df` with the probability of class 1."""
    return model.transform(assembled(df, features, "_f")).withColumn(to, vector_to_array("probability")[1]).select(*df.columns, to)


def classified(model, df: DataFrame, features: list[str], to: str = "predicted") -> DataFrame:
    """`df` with the class a model of several classes gives."""
    return model.transform(assembled(df, features, "_f")).withColumn(to, F.col("prediction").cast("int")).select(*df.columns, to)


def best_threshold(model, df: DataFrame, features: list[str], label: str) -> float:
    """The score with the greatest F1 on labelled rows, 0.5 where there are none."""
    row = metrics.best_f1(scored(model, df, features, "_score").withColumn("_g", F.lit(0)), ["_g"], label, "_score").first()
    return 0.5 if row is None else row["threshold"]


def evaluated(model, df: DataFrame, features: list[str], label: str, threshold: float) -> dict[str, float]:
    """Average precision, AUC, and F1, precision, recall and accuracy at a threshold, on labelled rows."""
    s = checkpointed(scored(model, df, features, "_score").select(label, "_score", (F.col("_score") >= threshold).cast("int").alias("_p"), F.lit(0).alias("_g")))
    ranks, cells = metrics.ranking_metrics(s, ["_g"], label, "_score").first(), metrics.binary_metrics(s, ["_g"], label, "_p").first()
    return {"n": ranks["n"], "pr_auc": ranks["ap"], "roc_auc": ranks["auc"], **{c: cells[c] for c in ("f1", "precision", "recall", "accuracy")}, "threshold": threshold}


def cross_validated(df: DataFrame, key: str, label: str, features: list[str], fit, folds: int = 5, at_once: int = 4) -> list[dict[str, float]]:
    """evaluated() of every stratified fold by `fit(rows)` of the others, whose best threshold counts; some folds at once."""
    folded = checkpointed(stratified_folds(df.select(key, label, *features), label, key, folds))

    def one(k: int) -> dict[str, float]:
        train = folded.where(F.col("fold") != k)
        model = fit(train)
        return {"fold": k + 1, **evaluated(model, folded.where(F.col("fold") == k), features, label, best_threshold(model, train, features, label))}

    with ThreadPool(at_once) as pool:
        return pool.map(one, range(folds))


def cross_validated_classes(df: DataFrame, key: str, label: str, features: list[str], fit, folds: int = 5, at_once: int = 4) -> dict[str, float]:
    """Accuracy and macro precision, recall and F1, the means of stratified folds."""
    folded = checkpointed(stratified_folds(df.select(key, label, *features), label, key, folds))

    def one(k: int):
        return classified(fit(folded.where(F.col("fold") != k)), folded.where(F.col("fold") == k), features).select(label, "predicted", "fold")

    with ThreadPool(at_once) as pool:
        parts = pool.map(one, range(folds))
    return _mean_of_folds(reduce(DataFrame.unionByName, parts), label)


def _mean_of_folds(classified_: DataFrame, label: str) -> dict[str, float]:
    per = metrics.macro_metrics(classified_, ["fold"], label, "predicted")
    names = ("accuracy", "macro_precision", "macro_recall", "macro_f1")
    return per.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()


def cross_validated_forest(df: DataFrame, key: str, label: str, features: list[str], folds: int = 5, trees: int = 300, depth: int = 16, seed: int = 42) -> dict[str, float]:
    """cross_validated_classes() of a forest, whose trees are grown side by side as long as the rows may be sent to the tasks."""
    folded = checkpointed(stratified_folds(df.select(key, label, *features), label, key, folds))
    rows = forest.gathered(folded, key, label, features, F.col("fold"))
    if rows is None:
        return cross_validated_classes(df, key, label, features, lambda part: random_forest(part, features, label, trees, depth, seed), folds)
    return _mean_of_folds(forest.held_out(df.sparkSession, rows, folds, trees, depth, seed=seed), "label")


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """`df` with its labels dealt out anew in the order of a hash: what a model finds then is chance or leakage."""
    placed = positions(df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))), [], ["_hash", key]).withColumnRenamed("_position", "_at")
    dealt = positions(df.select(key, label), [], [key]).select(F.col("_position").alias("_at"), F.col(label).alias("_label"))
    return placed.join(dealt, "_at").withColumn(label, F.col("_label")).select(*df.columns)


def univariate(df: DataFrame, features: list[str], label: str, most: float = 0.98) -> DataFrame:
    """(feature, best_direction, best_pr_auc, flagged): how well each feature alone, or its negative, ranks the labels."""
    sides = [F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"), (F.col(f) * (1 if d == "positive" else -1)).alias("_s")) for f in features for d in ("positive", "negative")]
    long = df.select(label, F.explode(F.array(*sides)).alias("_r")).select(label, "_r.*")
    ap = metrics.ranking_metrics(long, ["feature", "direction"], label, "_s")
    # of equal directions the positive one
    best = ap.groupBy("feature").agg(F.max(F.struct(F.col("ap"), F.col("direction"))).alias("_b"))
    return best.select("feature", F.col("_b.direction").alias("best_direction"), F.col("_b.ap").alias("best_pr_auc"), (F.col("_b.ap") > most).alias("flagged"))


# --- explanation -----------------------------------------------------------------------------------------------------


def leaves(model, value: int | list[int] | None = 1) -> list[tuple[float | np.ndarray, list[tuple[int, float, float, float]]]]:
    """Every leaf of a fitted tree ensemble as (its share of the output, [(feature, above, upto, share of the cover)]):
    one entry per feature on its path, bounds intersected and cover ratios multiplied.  `value` names the class whose
    probability counts, or several whose shares come as an array; None takes a regression tree's prediction."""
    out = []
    weights = list(model.treeWeights)
    total = sum(weights) if value is not None else 1.0

    def cover(node) -> float:
        return float(node.impurityStats().count())

    def walk(node, path: dict, weight: float) -> None:
        if node.subtreeDepth() == 0:
            stats = np.array([float(x) for x in node.impurityStats().stats()])
            share = node.prediction() if value is None else stats[value] / max(sum(stats), 1e-300)
            out.append((share * weight, [(f, low, high, z) for f, (low, high, z) in path.items()]))
            return
        split, here = node.split(), cover(node)
        f, cut = split.featureIndex(), split.threshold()
        low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
        walk(node.leftChild(), path | {f: (low, min(high, cut), z * cover(node.leftChild()) / here)}, weight)
        walk(node.rightChild(), path | {f: (max(low, cut), high, z * cover(node.rightChild()) / here)}, weight)

    for tree, w in zip(model.trees, weights):
        walk(tree._java_obj.rootNode(), {}, w / total)
    return out


def _marginals(meets: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values of games that are products of z_i (absent) or meets_i (present) over the last axis: the integral of
    (meets_j - z_j) prod(z_i (1 - t) + meets_i t, i other than j), exact with half as many nodes as there are factors."""
    m = z.shape[-1]
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    out = np.zeros(np.broadcast_shapes(meets.shape, z.shape))
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = z * (1 - t) + meets * t
        before, after = np.ones(out.shape), np.ones(out.shape)
        before[..., 1:] = np.cumprod(factor[..., :-1], -1)
        after[..., :-1] = np.cumprod(factor[..., :0:-1], -1)[..., ::-1]
        out += w * before * after
    return out * (meets - z)


def shapley(x: np.ndarray, paths: list) -> tuple[np.ndarray, float | np.ndarray]:
    """(contributions, base) of rows: path-dependent Shapley values, summed over the leaves; with a last axis of outputs
    where the leaves' shares are arrays.

    A leaf's game over the m features of its path is a product, so a row's part in it depends only on which of the m bounds
    the row meets: that is a code of m bits, looked up in a table of all codes where there are fewer of them than rows."""
    several = bool(paths) and np.ndim(paths[0][0]) > 0
    outputs = len(paths[0][0]) if several else 1
    phi, base = np.zeros((*x.shape, outputs)), np.zeros(outputs)
    alike: dict[int, list] = {}
    for share, path in paths:
        base += np.asarray(share) * float(np.prod([z for *_, z in path]))
        alike.setdefault(len(path), []).append((share, path))
    for m, group in alike.items():
        if not m:
            continue
        for first in range(0, len(group), 1024):
            some = group[first : first + 1024]
            shares = np.array([s for s, _ in some], float).reshape(len(some), outputs)
            fs, low, high, z = (np.array([[entry[i] for entry in path] for _, path in some]) for i in range(4))
            for at in range(0, len(x), 2048):
                _add_leaves(phi[at : at + 2048], x[at : at + 2048], shares, fs, low, high, z, len(x))
    return (phi, base) if several else (phi[..., 0], float(base[0]))


def _add_leaves(phi, x, shares, fs, low, high, z, rows: int) -> None:
    """Adds the contributions by leaves with paths of equal length."""
    count, m = fs.shape
    codes = np.zeros((len(x), count), np.int32 if m < 31 else np.int64)
    columns = {f: np.nonzero(fs == f) for f in np.unique(fs)}
    for f, (leaf, j) in columns.items():
        below, upto = low[leaf, j], high[leaf, j]
        bounds = np.unique(np.concatenate([below, upto]))
        place = np.arange(len(bounds) + 1)[:, None]
        met = np.zeros((len(bounds) + 1, count), codes.dtype)
        met[:, leaf] = ((place > np.searchsorted(bounds, below)) & (place <= np.searchsorted(bounds, upto))).astype(codes.dtype) << j.astype(codes.dtype)
        codes += met[np.searchsorted(bounds, x[:, f])]
    if 2**m <= rows:
        bits = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
        table = np.empty((count, m, 2**m))
        for i in range(0, count, step := max(1, 1_000_000 // (m * 2**m))):
            table[i : i + step] = _marginals(bits, z[i : i + step, None, :]).swapaxes(1, 2)
        flat = table.ravel()
        for f, (leaf, j) in columns.items():
            phi[:, f] += flat[codes[:, leaf] + ((leaf * m + j) * 2**m)] @ shares[leaf]
        return
    for i in range(0, count, step := max(1, 1_000_000 // (m * len(x)))):
        part = _marginals((codes[:, i : i + step, None] >> np.arange(m)) & 1, z[i : i + step])
        for f, (leaf, j) in columns.items():
            own = (leaf >= i) & (leaf < i + step)
            phi[:, f] += part[:, leaf[own] - i, j[own]] @ shares[leaf[own]]


def explained(model, df: DataFrame, key: str, features: list[str], value: int | None = 1) -> DataFrame:
    """(key, base, contribution of each feature); base and contributions add up to the model's output."""
    shared = df.sparkSession.sparkContext.broadcast(leaves(model, value))  # bounded by the model's size
    clean = df.select(F.col(key), *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))])
            phi, base = shapley(x, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), *[pa.array(phi[:, i]) for i in range(len(features))]], names=[key, "base", *features])

    kind = df.schema[key].dataType.simpleString()
    return clean.mapInArrow(run, f"`{key}` {kind}, base double, " + ", ".join(f"`{f}` double" for f in features))


def importance(explained_: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs_shap, rank)."""
    one = explained_.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in features])).alias("_r")).select("_r.*")
    return long.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_abs_shap"))))  # as many rows as features


def forest_of_classes(df: DataFrame, key: str, label: str, features: list[str], trees: int = 300, depth: int = 16, seed: int = 42):
    """A forest whose trees are grown side by side as long as the rows may be sent to the tasks, else the library's."""
    rows = forest.gathered(df, key, label, features)
    return random_forest(df, features, label, trees, depth, seed) if rows is None else forest.trained(df.sparkSession, rows, trees, depth, seed=seed)


def class_importance(model, df: DataFrame, key: str, features: list[str], classes: dict[int, str]) -> DataFrame:
    """(feature, class, mean_abs_shap) of a forest of several classes, and their sum as the class 'total': the rows are read
    once, a leaf's part in a row is the same for all classes but for the leaf's shares."""
    values = list(classes)
    shared = df.sparkSession.sparkContext.broadcast(model.leaves(values) if isinstance(model, forest.Forest) else leaves(model, values))  # bounded by the model's size

    def run(batches):
        sums, n = np.zeros((len(features), len(values))), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            sums, n = sums + np.abs(shapley(x, shared.value)[0]).sum(0), n + len(x)
        at = [(f, v) for f in range(len(features)) for v in range(len(values))]
        yield pa.RecordBatch.from_arrays([pa.array([features[f] for f, _ in at]), pa.array([classes[values[v]] for _, v in at]), pa.array([float(sums[i]) for i in at]), pa.array([n] * len(at), pa.int64())], names=["feature", "class", "s", "n"])

    parts = df.select(*forest.clean(features)).mapInArrow(run, "feature string, class string, s double, n bigint")
    per = checkpointed(parts.groupBy("feature", "class").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean_abs_shap")))
    return per.unionByName(per.groupBy("feature").agg(F.sum("mean_abs_shap").alias("mean_abs_shap")).withColumn("class", F.lit("total")))


def against_weights(importances: list[DataFrame], weights: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap, shap_rank, weight, weight_rank, rho): the mean over models of the mean contributions beside
    a criterion weight of the same name, and the rank correlation of both.  As many rows as features."""
    mean = reduce(DataFrame.unionByName, [i.select("feature", "mean_abs_shap") for i in importances]).groupBy("feature").agg(F.avg("mean_abs_shap").alias("mean_abs_shap"))
    both = mean.join(weights.select("feature", F.col("weight_normalized").alias("weight")), "feature")
    ranked = both.withColumns({"shap_rank": F.rank().over(Window.orderBy(F.desc("mean_abs_shap"))), "weight_rank": F.rank().over(Window.orderBy(F.desc("weight")))})
    return ranked.withColumn("rho", F.corr("shap_rank", "weight_rank").over(Window.partitionBy()))


def leakage_report(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    """One row: feature vectors (rounded to 8 digits) shared by both sets, vectors with both labels, repeated keys."""
    rounded = lambda df: df.select(*[F.bround(F.col(f), 8).alias(f) for f in features])
    shared = rounded(train).intersect(rounded(test)).agg(F.count("*").alias("shared_vectors"))
    both = train.unionByName(test)
    torn = both.groupBy(*[F.bround(F.col(f), 8).alias(f) for f in features]).agg(F.count_distinct(label).alias("_k")).where("_k > 1").agg(F.count("*").alias("conflicting_vectors"))
    keys = both.agg((F.count(key) - F.count_distinct(key)).alias("repeated_keys"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    return reduce(lambda a, b: a.crossJoin(b), [shared, torn, keys])  # one row each
