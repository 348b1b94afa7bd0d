"""Points near other points, near regions or inside regions, joined over sample-driven quadtree leaves.

Plan: a bounded sample of the points shapes a quadtree on the driver; every point goes to the one leaf that holds it
and every target is replicated to all leaves its box, widened by its reach, touches.  Each leaf is one group of a
co-grouped Arrow function: a bulk-loaded R-tree over the leaf's targets is probed with the leaf's points and the
candidates are tested exactly.  A pair is reported only in the leaf that holds its reference point - the lower left
corner of the intersection of both boxes - so no replica reports it twice; for points that corner is the point itself.

Leaves that stay heavy (many points on one spot can't be cut further, or there are more points than leaves can hold) are
salted: their points are split over as many groups as keep each near GROUP_POINTS and their targets go to each of these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from zonalis.functions.rtree import StrTree, edge_distance2, edges_of, inside

#: Bits of a cell number along one axis.
BITS = 16
#: Rows of the sample that shapes the tree: as many per wanted group, within these bounds, so that what the driver
#: holds is bounded, whatever the size of the input.
SAMPLE, SAMPLE_PER_GROUP, SAMPLE_MOST = 20_000, 16, 500_000
#: Points a group should hold, and the most leaves.  Points beyond that are spread by salts alone.
GROUP_POINTS = 50_000
MAX_LEAVES = 65_536
#: Points probed at once inside a group.
PROBE = 4096

TARGET_FIELDS = ("other_id", "reach", "xs", "ys", "ring_lengths")


def point_targets(df: DataFrame, other_id: str, x: Column, y: Column, reach: float) -> DataFrame:
    """Targets that points within `reach` of (x, y) match, the reach included; rows without finite coordinates match none."""
    at = df.select(F.col(other_id).cast("string").alias("other_id"), x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    return at.where(F.col("other_id").isNotNull() & finite("_x") & finite("_y")).distinct().select(
        "other_id", F.lit(float(reach)).alias("reach"), F.array("_x").alias("xs"), F.array("_y").alias("ys"), F.array().cast("array<int>").alias("ring_lengths")
    )


#: The reach of a region whose edge doesn't belong to it.
OPEN = -1.0


def region_targets(df: DataFrame, other_id: str, geom: str, reach: float = OPEN) -> DataFrame:
    """Targets that points inside the region (holes excluded) match, or with a reach of 0 those on its edge too, or with
    a positive one those within it of the region; one row per polygon."""
    polygons = df.select(F.col(other_id).cast("string").alias("other_id"), F.explode(f"{geom}.rings").alias("_p")).where(F.col("other_id").isNotNull())
    flat = lambda axis: F.flatten(F.transform("_p", lambda r: F.transform(r, lambda p: p[axis])))
    return polygons.select(
        "other_id", F.lit(float(reach)).alias("reach"), flat("x").alias("xs"), flat("y").alias("ys"), F.transform("_p", lambda r: F.size(r)).alias("ring_lengths")
    ).where(F.size("xs") > 0).distinct()


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


@dataclass(frozen=True)
class Tree:
    """Leaves as Z-order ranges: `starts` ascending, boxes in cell units, `salts` per leaf."""

    x0: float
    y0: float
    size: float
    starts: np.ndarray
    boxes: np.ndarray
    salts: np.ndarray

    def cell(self, v: Column, low: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(2**BITS - 1), F.floor((v - low) / (self.size / 2**BITS)))).cast("long")

    def leaf_of(self, df: DataFrame, x: str, y: str, to: str) -> DataFrame:
        """`df` with the number of the leaf in column `to`: a JVM-side binary search of the Z-order code."""
        if len(self.starts) == 1:
            return df.withColumn(to, F.lit(0))
        code = _spread(self.cell(F.col(x), self.x0)).bitwiseOR(F.shiftleft(_spread(self.cell(F.col(y), self.y0)), 1))
        cuts = [-0.5, *(self.starts[1:] - 0.5).tolist(), float(4**BITS)]
        found = Bucketizer(splits=cuts, inputCol="_code", outputCol="_leaf").transform(df.withColumn("_code", code.cast("double")))
        return found.withColumn(to, F.col("_leaf").cast("int")).drop("_code", "_leaf")


def _spread(c: Column) -> Column:
    """The bits of a 16-bit number moved to the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def _spread_np(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << shift)) & mask
    return v


def plan_tree(points: DataFrame, x: str, y: str, group_points: int = GROUP_POINTS) -> Tree:
    """The quadtree over a sample that grows with the number of groups, up to SAMPLE_MOST rows."""
    n = points.count()
    rows = min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PER_GROUP * n // max(1, group_points)))
    sample = points.select(x, y).sample(min(1.0, rows / max(1, n)), seed=17).toArrow()
    return tree_of(np.column_stack([sample[c].to_numpy().astype(float) for c in (x, y)]), n, group_points)


def tree_of(at: np.ndarray, n: int, group_points: int = GROUP_POINTS) -> Tree:
    """The quadtree over sampled points that stand for n; a leaf has a salt for every 2 * group_points it stands for."""
    if not len(at):
        return Tree(0.0, 0.0, 1.0, np.zeros(1), np.array([[0, 0, 2**BITS, 2**BITS]]), np.ones(1, int))
    # outliers must not stretch the grid: points beyond the outermost half per mille fall into the border leaves
    low, high = np.quantile(at, [0.0005, 0.9995], axis=0)
    size = float(max((high - low).max(), 1e-6)) * 1.02
    x0, y0 = (low + high) / 2 - size / 2
    cells = np.clip(np.floor((at - [x0, y0]) / (size / 2**BITS)), 0, 2**BITS - 1).astype(np.int64)
    codes = np.sort(_spread_np(cells[:, 0]) | (_spread_np(cells[:, 1]) << 1))
    each = n / len(at)
    most = max(group_points / each, len(at) * 3 / MAX_LEAVES, 4)
    leaves, todo = [], [(0, 0)]
    while todo:
        start, depth = todo.pop()
        span = 4 ** (BITS - depth)
        inside_ = np.searchsorted(codes, start + span) - np.searchsorted(codes, start)
        if inside_ > most and depth < BITS:
            todo.extend((start + k * (span // 4), depth + 1) for k in range(4))
        else:
            leaves.append((start, depth, inside_))
    leaves.sort()
    starts = np.array([s for s, _, _ in leaves], dtype=np.int64)
    width = np.array([2 ** (BITS - d) for _, d, _ in leaves])
    cx, cy = _gather(starts), _gather(starts >> 1)
    salts = np.array([max(1, int(np.ceil(c * each / (2 * group_points)))) for _, _, c in leaves])
    return Tree(float(x0), float(y0), size, starts, np.column_stack([cx, cy, cx + width, cy + width]), salts)


def _gather(v: np.ndarray) -> np.ndarray:
    """The even bits of a number, together."""
    v = v & 0x55555555
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = (v | (v >> shift)) & mask
    return v


def _replicate(tree: Tree):
    """Arrow function: every target once per leaf and salt that its widened box touches."""
    index_boxes = tree.boxes.astype(float)
    index_boxes[:, 2:] -= 0.5  # cells are whole numbers; neighbours must not touch

    def run(batches):
        index = StrTree(index_boxes)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            reach = np.maximum(t["reach"].to_numpy(), 0)
            lo, hi = _boxes(t)
            box = np.column_stack([lo[:, 0] - reach, lo[:, 1] - reach, hi[:, 0] + reach, hi[:, 1] + reach])
            cell = (box - [tree.x0, tree.y0, tree.x0, tree.y0]) / (tree.size / 2**BITS)
            cell = np.clip(np.floor(cell), 0, 2**BITS - 1)
            row, leaf = index.meeting(cell)
            times = tree.salts[leaf]
            salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, leaf = np.repeat(row, times), np.repeat(leaf, times)
            for a in range(0, len(row), 5000):
                part = t.take(pa.array(row[a : a + 5000]))
                part = part.append_column("leaf", pa.array(leaf[a : a + 5000].astype(np.int32)))
                yield from part.append_column("salt", pa.array(salt[a : a + 5000].astype(np.int32))).to_batches()

    return run


def _boxes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ends = [], []
    for axis in ("xs", "ys"):
        a = t[axis].combine_chunks()
        values, offsets = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
        lengths = np.diff(offsets)
        starts = offsets[:-1]
        ends[0].append(np.minimum.reduceat(values, starts) if len(lengths) else np.empty(0))
        ends[1].append(np.maximum.reduceat(values, starts) if len(lengths) else np.empty(0))
    return np.column_stack(ends[0]), np.column_stack(ends[1])


def _probe(point_id: str, carried: list[str], out: pa.Schema, measured: bool):
    of_point = [point_id, *carried]

    def run(points: pa.Table, targets: pa.Table) -> pa.Table:
        if not points.num_rows or not targets.num_rows:
            return out.empty_table()
        px, py = points["_px"].to_numpy(), points["_py"].to_numpy()
        reach = targets["reach"].to_numpy()
        lo, hi = _boxes(targets)
        wide = np.maximum(reach, 0)
        index = StrTree(np.column_stack([lo[:, 0] - wide, lo[:, 1] - wide, hi[:, 0] + wide, hi[:, 1] + wide]))
        xs, ys, rings = (targets[c].combine_chunks() for c in ("xs", "ys", "ring_lengths"))
        single = np.array([len(r) == 0 for r in rings]) if len(rings) else np.empty(0, bool)
        shape = {}
        found_p, found_t, found_d = [], [], []
        for a in range(0, len(px), PROBE):
            x, y = px[a : a + PROBE], py[a : a + PROBE]
            p, t = index.meeting(np.column_stack([x, y, x, y]))
            # reference point: the lower left corner of the intersection is the point itself, which only this leaf holds
            near = single[t]
            pp, tt = p[near], t[near]
            far = (x[pp] - lo[tt, 0]) ** 2 + (y[pp] - lo[tt, 1]) ** 2
            keep = far <= reach[tt] ** 2
            found_p.append(pp[keep] + a)
            found_t.append(tt[keep])
            found_d.append(far[keep])
            pp, tt = p[~near], t[~near]
            order = np.argsort(tt, kind="stable")
            pp, tt = pp[order], tt[order]
            which, first = np.unique(tt, return_index=True)
            for k, (target, s) in enumerate(zip(which, first)):
                e = first[k + 1] if k + 1 < len(which) else len(tt)
                if target not in shape:
                    shape[target] = edges_of(xs[target].values.to_numpy(), ys[target].values.to_numpy(), rings[target].values.to_numpy())
                mine = pp[s:e]
                within = inside(x[mine], y[mine], shape[target])
                to_edge = edge_distance2(x[mine], y[mine], shape[target])
                hit = within & (to_edge > 0) if reach[target] < 0 else within | (to_edge <= reach[target] ** 2)
                found_p.append(mine[hit] + a)
                found_t.append(np.full(hit.sum(), target))
                found_d.append(np.where(within, 0.0, to_edge)[hit])
        p, t, far = np.concatenate(found_p), np.concatenate(found_t).astype(np.int64), np.concatenate(found_d)
        names = targets["other_id"].combine_chunks().dictionary_encode()
        name = names.indices.to_numpy()[t]
        # several polygons or positions of one target count once, with the nearest
        n = max(1, len(names.dictionary))
        order = np.argsort(far, kind="stable")
        pair, nearest = np.unique(p[order].astype(np.int64) * n + name[order], return_index=True)
        columns = [points[c].take(pa.array(pair // n)) for c in of_point] + [names.dictionary.take(pa.array(pair % n))]
        if measured:
            columns.append(pa.array(np.sqrt(far[order][nearest])))
        return pa.table(columns, names=out.names).cast(out)

    return run


def quadtree_join(
    points: DataFrame, point_id: str, x: str, y: str, targets: DataFrame, group_points: int = GROUP_POINTS, distances: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(point_id, carried columns, other_id), and the distance if asked for (0 inside a region), of every point and every
    target it matches, each once for each (point_id, carried columns, x, y).

    Rows of `points` without an id or without finite coordinates match nothing; repeated rows count once; columns that
    aren't in `carry` are ignored.  `targets` come from point_targets() and region_targets(), united as needed: one pass
    over the points serves them all.  Several targets of one other_id count as one.  Empty tables give no pairs.
    """
    at = (
        points.select(point_id, *carry, F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
        .where(F.col(point_id).isNotNull() & finite("_px") & finite("_py"))
    )
    tree = plan_tree(at, "_px", "_py", group_points)
    # one literal however many leaves there are
    salts = F.split(F.lit(",".join(map(str, tree.salts.tolist()))), ",").cast("array<int>") if (tree.salts > 1).any() else None
    # combined before the shuffle: one point may make up much of the input, and its rows would all meet in one leaf and salt
    placed = tree.leaf_of(at.distinct(), "_px", "_py", "leaf")
    salt = F.pmod(F.xxhash64(point_id), F.element_at(salts, F.col("leaf") + 1)).cast("int") if salts is not None else F.lit(0)
    placed = placed.withColumn("salt", salt)
    schema = targets.select(*TARGET_FIELDS).schema
    copies = targets.select(*TARGET_FIELDS).mapInArrow(_replicate(tree), schema.simpleString()[7:-1] + ",leaf int,salt int")
    kept = [points.schema[c] for c in (point_id, *carry)]
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kept] + [pa.field("other_id", pa.string()), *[pa.field("distance", pa.float64())] * distances]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", other_id string" + ", distance double" * distances
    return placed.groupBy("leaf", "salt").cogroup(copies.groupBy("leaf", "salt")).applyInArrow(_probe(point_id, list(carry), pa.schema(fields), distances), ddl)
