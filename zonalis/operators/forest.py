"""A forest of several classes whose trees are grown side by side, one task a few trees, each over all rows.

The library's learner passes over the rows once per level of all trees, which costs some microseconds per row, tree and
level.  Here the rows go to the tasks as one byte per feature, so they are bounded (`BYTES`); larger tables are for
`models.random_forest`."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of binned features up to which the rows are sent to every task.
BYTES = 64_000_000
#: Bins per feature, as in the library; entries of a histogram made at once; trees per task.
BINS, ENTRIES, TREES = 32, 1_000_000, 50


@dataclass
class Tree:
    """Nodes as arrays; `feature` is -1 at leaves, rows with a bin up to `cut` go left; `stats` are sampled rows by class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node, open_ = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(open_ := open_[self.feature[node[open_]] >= 0]):
            at = node[open_]
            node[open_] = np.where(bins[open_, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return node


@dataclass
class Rows:
    """Binned rows, their classes (indices into `classes`) and folds, in the order of their key."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    cuts: list[np.ndarray]
    classes: list


@dataclass
class Forest:
    trees: list[Tree]
    cuts: list[np.ndarray]
    classes: list

    def leaves(self, values: list) -> list[tuple[np.ndarray, list[tuple[int, float, float, float]]]]:
        """Every leaf as `models.leaves` has them, with its shares of the classes `values`, 0 for one that wasn't seen."""
        seen, out = [(i, self.classes.index(v)) for i, v in enumerate(values) if v in self.classes], []
        for tree in self.trees:
            size, todo = tree.stats.sum(1), [(0, {})]
            while todo:
                node, path = todo.pop()
                f = int(tree.feature[node])
                if f < 0:
                    share = np.zeros(len(values))
                    for i, c in seen:
                        share[i] = tree.stats[node, c] / size[node] / len(self.trees)
                    out.append((share, [(g, *bounds) for g, bounds in path.items()]))
                    continue
                cut, (low, high, z) = float(self.cuts[f][tree.cut[node]]), path.get(f, (-np.inf, np.inf, 1.0))
                for child, a, b in ((tree.left[node], low, min(high, cut)), (tree.right[node], max(low, cut), high)):
                    todo.append((child, path | {f: (a, b, z * size[child] / size[node])}))
        return out


def clean(features: list[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features]


def cut_points(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Per feature the values after which a bin ends: between all its values where they are few, else at even shares."""
    rough = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    few = [f for f in features if rough[f] <= BINS]
    values = df.agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in few]).first().asDict() if few else {}
    values = {f: v for f, v in values.items() if len(v) <= BINS}  # the first count is rough
    many = [f for f in features if f not in values]
    shares = df.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001) if many else []
    cuts = {f: np.unique(q) for f, q in zip(many, shares)} | {f: np.convolve(v, [0.5, 0.5], "valid") for f, v in values.items() if len(v) > 1}
    return [np.asarray(cuts.get(f, []), float) for f in features]


def gathered(df: DataFrame, key: str, label: str, features: list[str], fold: Column | None = None) -> Rows | None:
    """The labelled rows of `df`, None where there are none or more than `BYTES` hold."""
    data = df.where(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_y"), (F.lit(-1) if fold is None else fold).cast("int").alias("_fold"), *clean(features)).persist()
    try:
        n, classes = data.count(), sorted(r[0] for r in data.select("_y").distinct().collect())
        if not 0 < n * len(features) <= BYTES:
            return None
        cuts = cut_points(data, features)

        def packed(batches):
            for batch in batches:
                bins = np.column_stack([np.searchsorted(c, batch.column(i + 2).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)]).astype(np.uint8)
                y = np.searchsorted(np.array(classes), batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y, batch.column(1).to_numpy().astype(np.int32))], names=["bins", "y", "fold"])

        # sorted, so that samples don't depend on how the rows lay
        parts = data.orderBy("_k", *features).drop("_k").mapInArrow(packed, "bins binary, y binary, fold binary").collect()
    finally:
        data.unpersist()
    joined = lambda c, kind: np.frombuffer(b"".join(r[c] for r in parts), kind)
    return Rows(joined("bins", np.uint8).reshape(-1, len(features)), joined("y", np.int32), joined("fold", np.int32), cuts, classes)


def grown(bins: np.ndarray, y: np.ndarray, classes: int, depth: int, least: int, rng: np.random.Generator) -> Tree:
    """A tree over a bootstrap sample: the best Gini split of about the root of all features, each node's own, as long as
    both sides have `least` sampled rows and the impurity falls."""
    n, width = bins.shape
    tried = max(1, int(np.ceil(np.sqrt(width))))
    drawn = np.bincount(rng.integers(n, size=n), minlength=n)
    row = np.flatnonzero(drawn)
    w, label, at = drawn[row].astype(float), y[row].astype(np.int64), np.zeros(len(row), np.int64)
    flat = bins.ravel()
    stats = [np.bincount(label, w, classes)[None]]
    feature, cut, left, right = [], [], [], []
    made = 1
    for level in range(depth + 1):
        total = stats[-1]
        m = len(total)
        f_of, c_of, l_of, r_of = np.full(m, -1, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        feature.append(f_of), cut.append(c_of), left.append(l_of), right.append(r_of)
        size = total.sum(1)
        able = np.flatnonzero((total.max(1) < size) & (size >= 2 * least)) if level < depth else np.zeros(0, np.int64)
        if not len(able):
            break
        place = np.full(m, -1, np.int64)
        place[able] = np.arange(len(able))
        keep = place[at] >= 0
        row, w, label, at = row[keep], w[keep], label[keep], place[at[keep]]
        mine = np.argsort(rng.random((len(able), width)), 1)[:, :tried]
        least_impure, best_f, best_c = np.full(len(able), np.inf), np.zeros(len(able), np.int64), np.zeros(len(able), np.int64)
        step = max(1, ENTRIES // (BINS * classes))
        if len(able) > step:
            order = np.argsort(at, kind="stable")
            row, w, label, at = row[order], w[order], label[order], at[order]
        for first in range(0, len(able), step):
            nodes = np.arange(first, min(first + step, len(able)))
            here = slice(*np.searchsorted(at, [first, nodes[-1] + 1])) if len(able) > step else slice(None)
            base, k = row[here] * width, len(nodes)
            code, all_ = (at[here] - first) * (BINS * classes) + label[here], total[able[nodes]][:, None]
            for j in range(tried):
                b = flat[base + mine[at[here], j]]
                below = np.bincount(code + b.astype(np.int64) * classes, w[here], k * BINS * classes).reshape(k, BINS, classes).cumsum(1)[:, :-1]
                above = all_ - below
                p, q = below.sum(2), above.sum(2)
                impure = np.where((p >= least) & (q >= least), p + q - (below**2).sum(2) / np.maximum(p, 1) - (above**2).sum(2) / np.maximum(q, 1), np.inf)
                c = impure.argmin(1)
                value = impure[np.arange(k), c]
                better = value < least_impure[nodes]
                least_impure[nodes[better]], best_f[nodes[better]], best_c[nodes[better]] = value[better], mine[nodes[better], j], c[better]
        own = size[able] - (total[able] ** 2).sum(1) / size[able]
        splits = np.flatnonzero(least_impure < own - 1e-9)
        if not len(splits):
            break
        f_of[able[splits]], c_of[able[splits]] = best_f[splits], best_c[splits]
        l_of[able[splits]] = made + 2 * np.arange(len(splits))
        r_of[able[splits]] = l_of[able[splits]] + 1
        made += 2 * len(splits)
        place = np.full(len(able), -1, np.int64)
        place[splits] = np.arange(len(splits))
        keep = place[at] >= 0
        row, w, label, at = row[keep], w[keep], label[keep], at[keep]
        at = 2 * place[at] + (flat[row * width + best_f[at]] > best_c[at])
        stats.append(np.bincount(at * classes + label, w, 2 * len(splits) * classes).reshape(-1, classes))
    return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(right), np.concatenate(stats))


def trained(spark, rows: Rows, trees: int, depth: int, least: int = 2, seed: int = 42) -> Forest:
    """A forest over all rows."""
    shared = spark.sparkContext.broadcast(rows)
    per = max(1, trees // 30)

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r = shared.value
                for t in range(i * per, min(trees, (i + 1) * per)):
                    tree = grown(r.bins, r.y, len(r.classes), depth, least, np.random.default_rng([seed, 0, t]))
                    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([pickle.dumps(tree)], pa.binary())], names=["t", "tree"])

    n = -(-trees // per)
    found = spark.range(0, n, 1, n).mapInArrow(run, "t bigint, tree binary").collect()
    shared.unpersist()
    return Forest([pickle.loads(r["tree"]) for r in sorted(found, key=lambda r: r["t"])], rows.cuts, rows.classes)


def held_out(spark, rows: Rows, folds: int, trees: int, depth: int, least: int = 2, seed: int = 42) -> DataFrame:
    """(fold, label, predicted) of every row by the forest over the other folds: the class of the greatest mean share."""
    shared, k = spark.sparkContext.broadcast(rows), len(rows.classes)
    pieces = -(-trees // TREES)

    def votes(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r, fold, piece = shared.value, i // pieces, i % pieces
                other, held = r.fold != fold, r.bins[r.fold == fold]
                bins, y, out = r.bins[other], r.y[other], np.zeros((len(held), k))
                for t in range(piece * TREES, min(trees, (piece + 1) * TREES) if len(y) else 0):
                    tree = grown(bins, y, k, depth, least, np.random.default_rng([seed, fold + 1, t]))
                    out += (tree.stats / tree.stats.sum(1, keepdims=True))[tree.leaf(held)]
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["fold", "votes"])

    def decided(t: pa.Table) -> pa.Table:
        r, fold = shared.value, t["fold"][0].as_py()
        won = sum(np.frombuffer(v, float).reshape(-1, k) for v in t["votes"].to_pylist()).argmax(1)
        names = pa.array(r.classes)
        return pa.table({"fold": pa.array(np.full(len(won), fold, np.int32)), "label": names.take(pa.array(r.y[r.fold == fold])), "predicted": names.take(pa.array(won))})

    kind = "bigint" if isinstance(rows.classes[0], int) else "string"
    n = folds * pieces
    return spark.range(0, n, 1, n).mapInArrow(votes, "fold int, votes binary").groupBy("fold").applyInArrow(decided, f"fold int, label {kind}, predicted {kind}")
