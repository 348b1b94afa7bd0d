"""Lines near regions: how much of a line's length lies within a distance of a region.

Segments and regions meet on a grid: both are copied to the cells their boxes touch (the region's widened by the
distance) and a pair is kept only in the cell that holds the lower left corner of the boxes' intersection.  The part of a
segment near a region is then exact: a segment is within d of a polygon where it is inside it or within d of an edge, and
each of these is an interval of the segment, so the length is that of the union of intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.rtree import edges_of, inside
from zonalis.plans.runtime import checkpointed, keyed_join

#: Polygons up to which their points are broadcast, and segments times edges that are measured at once.
POLYGONS, AT_ONCE = 20_000, 400_000


def segments(lines: DataFrame, key: str, line: str, longest: float) -> DataFrame:
    """(key, x1, y1, x2, y2) of every step of every line, long ones cut into equal pieces: a long slanting step's box
    would meet regions far from it."""
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.get(line, i - 1).alias("a"), F.get(line, i).alias("b")))
    exploded = lines.where(F.size(line) > 1).select(F.col(key), F.explode(steps).alias("s"))
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(dx, dy) / longest)).cast("int")
    cut = exploded.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = lambda axis, d, i: F.col(f"s.a.{axis}") + d * (i / F.col("_n"))
    return cut.select(key, at("x", dx, F.col("_i") - 1).alias("x1"), at("y", dy, F.col("_i") - 1).alias("y1"), at("x", dx, F.col("_i")).alias("x2"), at("y", dy, F.col("_i")).alias("y2"))


def grid_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Rows of both sides whose boxes touch, each pair once; both hold xmin, ymin, xmax, ymax, which `left` has as
    l_xmin, ... afterwards and `right` as r_xmin, ...; other columns must differ."""
    box = ("xmin", "ymin", "xmax", "ymax")

    def spread(df: DataFrame, side: str) -> DataFrame:
        named = df.withColumnsRenamed({c: f"{side}_{c}" for c in box})
        at = lambda c: F.floor(F.col(f"{side}_{c}") / cell).cast("bigint")
        return named.withColumn("_cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax"))))

    both = spread(left, "l").join(spread(right, "r"), ["_cx", "_cy"])
    touch = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    corner = (F.floor(F.greatest("l_xmin", "r_xmin") / cell) == F.col("_cx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / cell) == F.col("_cy"))
    return both.where(touch & corner).drop("_cx", "_cy")


def near_intervals(segs: np.ndarray, edges: np.ndarray, d: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the segments (rows x1, y1, x2, y2) the begins and ends of the disjoint intervals, ascending, of its
    length that lie inside a polygon or within d of its edges; all edges of all segments at once."""
    a, u = segs[:, :2], segs[:, 2:] - segs[:, :2]
    length = np.hypot(u[:, 0], u[:, 1])
    none = (np.empty(0), np.empty(0))
    if not len(edges) or not len(segs):
        return [none] * len(segs)
    ux, uy = (u / np.where(length > 0, length, 1)[:, None]).T[:, :, None]
    x1, y1, x2, y2 = edges.T[:, None]
    el = np.hypot(x2 - x1, y2 - y1)
    ex, ey = (x2 - x1) / np.where(el > 0, el, 1), (y2 - y1) / np.where(el > 0, el, 1)
    dx, dy = x1 - a[:, :1], y1 - a[:, 1:]
    # discs around the ends of the edges
    along, off = dx * ux + dy * uy, dx * uy - dy * ux
    half = np.sqrt(np.maximum(d * d - off * off, 0.0))
    lows, highs = [np.where(np.abs(off) < d, along - half, 0.0)], [np.where(np.abs(off) < d, along + half, 0.0)]
    # the rectangles along the edges: |distance to the edge's line| <= d and the foot within the edge
    low, high = np.zeros(off.shape), np.broadcast_to(length[:, None], off.shape).copy()
    for rate, at, lo, hi in ((ux * ey - uy * ex, dy * ex - dx * ey, -d, d), (ux * ex + uy * ey, -dx * ex - dy * ey, 0.0, el)):
        flat = np.abs(rate) < 1e-12
        s, e = (lo - at) / np.where(flat, 1, rate), (hi - at) / np.where(flat, 1, rate)
        low, high = np.where(flat, low, np.maximum(low, np.minimum(s, e))), np.where(flat, high, np.minimum(high, np.maximum(s, e)))
        high = np.where(flat & ((at < lo) | (at > hi)), -1.0, high)
    lows.append(low)
    highs.append(np.where(el > 0, high, -1.0))
    # between crossings with the edges a segment is inside or not
    cross = ux * ey - uy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(np.abs(cross) > 1e-12, (dx * ey - dy * ex) / cross, 0.0)
    foot = (t * ux - dx) * ex + (t * uy - dy) * ey
    t = np.where((foot >= -1e-6) & (foot <= el + 1e-6), t, 0.0)
    cuts = np.sort(np.concatenate([np.clip(t, 0, length[:, None]), np.zeros((len(segs), 1)), length[:, None]], 1), 1)
    mid = (cuts[:, 1:] + cuts[:, :-1]) / 2
    real = np.diff(cuts, axis=1) > 0
    row = np.nonzero(real)[0]
    within = np.zeros(real.shape, bool)
    within[real] = inside(a[row, 0] + mid[real] * ux[row, 0], a[row, 1] + mid[real] * uy[row, 0], edges)
    lows.append(np.where(within, cuts[:, :-1], 0.0))
    highs.append(np.where(within, cuts[:, 1:], 0.0))
    low, high = np.maximum(np.concatenate(lows, 1), 0.0), np.minimum(np.concatenate(highs, 1), length[:, None])
    return [_united(lo[hi > lo], hi[hi > lo]) for lo, hi in zip(low, high)]


def _united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(low):
        return low, high
    order = np.argsort(low)
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))
    return low[new], high[np.append(np.nonzero(new)[0][1:] - 1, len(high) - 1)]


def near_length(seg: tuple[float, float, float, float], edges: np.ndarray, d: float) -> float:
    """Length of the part of a segment inside a polygon or within d of its edges."""
    low, high = near_intervals(np.array([seg], float), edges, d)[0]
    return float((high - low).sum())


def length_near_regions(lines: DataFrame, key: str, line: str, regions: DataFrame, region_id: str, geom: str, distance: float, cell: float | None = None) -> DataFrame:
    """(region, key, metres): the length of each line within `distance` of each region, where there is any.

    What is near several polygons of a region counts once, what several lines or steps share as often as they have it;
    lines without length have none.  Empty tables give no rows."""
    cell = cell or max(2 * distance, 500.0)
    # equal steps are measured once and counted, so that a step's polygons can be brought together by its ends
    seg = segments(lines, key, line, cell).groupBy(key, "x1", "y1", "x2", "y2").agg(F.count("*").alias("_times"))
    seg = seg.select("*", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))
    polygons = regions.select(F.col(region_id).alias("region"), F.explode(f"{geom}.rings").alias("_p")).distinct()
    flat = lambda axis: F.flatten(F.transform("_p", lambda r: F.transform(r, lambda p: p[axis])))
    shaped = polygons.select("region", flat("x").alias("xs"), flat("y").alias("ys"), F.transform("_p", lambda r: F.size(r)).alias("sizes"))
    shaped = checkpointed(shaped.where(F.size("xs") > 0).withColumn("polygon", F.xxhash64("region", "xs", "ys", "sizes")))
    boxed = shaped.select(
        "polygon", "region", (F.array_min("xs") - distance).alias("xmin"), (F.array_min("ys") - distance).alias("ymin"), (F.array_max("xs") + distance).alias("xmax"), (F.array_max("ys") + distance).alias("ymax")
    )
    # far more work than bytes: spread by a number of its own, which adaptive execution doesn't lower; the points of the
    # polygons come last, the pairs of one lie together
    spread = 4 * lines.sparkSession.sparkContext.defaultParallelism
    pairs = grid_pairs(seg, boxed, cell).repartition(spread, "polygon", F.floor(F.col("x1") / cell))
    shapes = shaped.select("polygon", "xs", "ys", "sizes")
    pairs = keyed_join(pairs, shapes, "polygon", shaped.count(), limit=POLYGONS).sortWithinPartitions("polygon")

    def measure(batches):
        for batch in batches:
            polygon = batch.column(7).to_numpy()
            segs = np.column_stack([batch.column(c).to_numpy() for c in (2, 3, 4, 5)]) if len(polygon) else np.empty((0, 4))
            found = []
            cuts = np.nonzero(np.diff(polygon))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(polygon)]):
                if b > a:
                    edges = edges_of(*(batch.column(c)[a].values.to_numpy(zero_copy_only=False) for c in (8, 9, 10)))
                    step = max(1, AT_ONCE // max(1, len(edges)))
                    for k in range(a, b, step):
                        found += near_intervals(segs[k : min(k + step, b)], edges, distance)
            sides = [pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(7)), *sides], names=["region", key, "x1", "y1", "x2", "y2", "_times", "_low", "_high"])

    kinds = f"region {regions.schema[region_id].dataType.simpleString()}, `{key}` {lines.schema[key].dataType.simpleString()}, x1 double, y1 double, x2 double, y2 double, _times bigint, _low array<double>, _high array<double>"
    measured = pairs.select("region", key, "x1", "y1", "x2", "y2", "_times", "polygon", "xs", "ys", "sizes").mapInArrow(measure, kinds).where(F.size("_low") > 0)
    found = measured.groupBy("region", key, "x1", "y1", "x2", "y2", "_times").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_low", "_high")))).alias("_near"))

    def longer(so_far, near):
        end = F.greatest(so_far["end"], near["_high"])
        return F.struct((so_far["metres"] + F.greatest(F.lit(0.0), near["_high"] - F.greatest(near["_low"], so_far["end"]))).alias("metres"), end.alias("end"))

    union = F.aggregate("_near", F.struct(F.lit(0.0).alias("metres"), F.lit(0.0).alias("end")), longer)["metres"]
    return found.select("region", key, (union * F.col("_times")).alias("metres")).groupBy("region", key).agg(F.sum("metres").alias("metres"))


def route_supply(lines: DataFrame, key: str, line: str, regions: DataFrame, region_id: str, geom: str, distance: float = 800.0) -> DataFrame:
    """(region, route_km_within_800m): kilometres of all lines within the distance of a region, each variant counted."""
    return length_near_regions(lines, key, line, regions, region_id, geom, distance).groupBy("region").agg((F.sum("metres") / 1000).alias("route_km_within_800m"))


def merged_lines(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Lines joined end to end wherever exactly two ends meet; the others stay apart."""
    lines = [list(p) for p in parts if len(p) > 1]
    ends: dict[tuple, list[int]] = {}
    for i, p in enumerate(lines):
        for at in (p[0], p[-1]):
            ends.setdefault(at, []).append(i)
    used, out = set(), []

    def grow(p: list, me: int) -> list:
        while True:
            meet = [i for i in ends.get(p[-1], []) if i not in used]
            if len(ends.get(p[-1], [])) != 2 or not meet:
                return p
            nxt = lines[meet[0]]
            used.add(meet[0])
            p = p + (nxt[1:] if nxt[0] == p[-1] else nxt[::-1][1:])

    for i, p in enumerate(lines):
        if i not in used:
            used.add(i)
            out.append(grow(grow(p, i)[::-1], i)[::-1])
    return out
