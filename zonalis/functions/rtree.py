"""A bulk-loaded R-tree and exact geometric tests over numpy arrays, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np

FANOUT = 16
#: Cells of an intermediate matrix; bounds the memory of one step.
STEP = 2_000_000


class StrTree:
    """Boxes packed by sort-tile-recursive order: xmin, ymin, xmax, ymax of the entries."""

    def __init__(self, boxes: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        n = len(boxes)
        cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        leaves = -(-n // fanout) or 1
        slices = int(np.ceil(np.sqrt(leaves)))
        by_x = np.argsort(cx, kind="stable")
        tile = np.empty(n, dtype=np.int64)
        tile[by_x] = np.arange(n) // (slices * fanout)
        self.order = np.lexsort((cy, tile))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below), fanout)
            self.levels.append(
                np.column_stack(
                    [np.minimum.reduceat(below[:, 0], starts), np.minimum.reduceat(below[:, 1], starts),
                     np.maximum.reduceat(below[:, 2], starts), np.maximum.reduceat(below[:, 3], starts)]
                )
            )

    def meeting(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the query box, index of the entry) of all pairs that touch."""
        if not len(self.levels[0]) or not len(boxes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        query, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            b, q = level[node], boxes[query]
            hit = (b[:, 0] <= q[:, 2]) & (b[:, 2] >= q[:, 0]) & (b[:, 1] <= q[:, 3]) & (b[:, 3] >= q[:, 1])
            query, node = query[hit], node[hit]
            if depth:
                first = node * self.fanout
                count = np.minimum(first + self.fanout, len(self.levels[depth - 1])) - first
                query = np.repeat(query, count)
                node = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return query, self.order[node]


def edges_of(xs: np.ndarray, ys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(x1, y1, x2, y2) of all rings; rings may or may not repeat their first point."""
    out, at = [], 0
    for n in lengths:
        x, y = xs[at : at + n], ys[at : at + n]
        at += n
        if n >= 2:
            out.append(np.column_stack([x, y, np.roll(x, -1), np.roll(y, -1)]))
    return np.concatenate(out) if out else np.empty((0, 4))


def inside(px: np.ndarray, py: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd test of points against one polygon's rings (outer and holes together)."""
    out = np.zeros(len(px), bool)
    x1, y1, x2, y2 = edges.T
    keep = y1 != y2
    x1, y1, x2, y2 = x1[keep], y1[keep], x2[keep], y2[keep]
    if not len(x1):
        return out
    step = max(1, STEP // len(x1))
    for a in range(0, len(px), step):
        x, y = px[a : a + step, None], py[a : a + step, None]
        spans = (y1 > y) != (y2 > y)
        # the side of the edge's line, without a division
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        left = np.where(y2 > y1, side > 0, side < 0)
        out[a : a + step] = (spans & left).sum(1) % 2 == 1
    return out


def on_edge(px: np.ndarray, py: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return edge_distance2(px, py, edges) == 0


def edge_distance2(px: np.ndarray, py: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Squared distance of points to the nearest edge."""
    x1, y1, x2, y2 = edges.T
    dx, dy = x2 - x1, y2 - y1
    length2 = np.maximum(dx * dx + dy * dy, 1e-300)
    out = np.empty(len(px))
    step = max(1, STEP // max(1, len(x1)))
    for a in range(0, len(px), step):
        x, y = px[a : a + step, None], py[a : a + step, None]
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / length2, 0, 1)
        d2 = (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2
        out[a : a + step] = d2.min(1) if d2.shape[1] else np.inf
    return out
