"""Similarity clusters by density peaks, over blocked neighbour joins.

A record's density is the number of records within the radius, itself included; every record points to its nearest
denser record within the radius (of equal densities the smaller id counts as denser); records without one are peaks,
and the pointers followed to their end give the labels.  Peaks whose clusters touch - two members within the radius of
each other - are then united, so that similar records never part.

Cells: a bounded sample shows where records lie densely; the records within half the radius of such a place's centre are
a cell, and all of a cell are neighbours of each other.  Their number is counted, not compared, and they point to the
densest of them.  A cell that no other record comes near is a group of its own and done with, so that a group of a third
of all records costs no more than any others.

Blocks: what remains is compared within the leaves of a k-d tree whose cuts are laid where the fewest sampled records lie
within the radius of the cut.  A record belongs to one leaf and is copied to every leaf within the radius of it, so a
leaf's own records find all their neighbours there.  In a leaf the records of one cell are compared with those of another,
or with those of no cell, as far as they can be within the radius of each other; large sides are cut into chunks, each
pair of chunks a task of its own, which divides both sides further in the same way.  Only counts, nearest neighbours and touching labels leave a task, never pairs of
records.  Two cells side by side are compared record by record where the distance of their centres doesn't decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.plans.runtime import checkpointed, keyed_join

#: Records a leaf or chunk should hold.
CHUNK = 8_000
#: Rows of the sample that shapes the tree: as many per leaf, within these bounds.
SAMPLE, SAMPLE_PER_LEAF, SAMPLE_MOST = 20_000, 16, 200_000
#: Rows of the sample that shows the cells, records a cell should have at least, and sampled ones that must show it.
CELL_SAMPLE, CELL_LEAST, SHOWN = 10_000, 500, 8
#: Distances computed at once, and pairs of records of a task that aren't divided any further.
CELLS, PIECE = 4_000_000, 100_000
#: Equal rows from which a point's group is brought to them without a shuffle.
HEAVY = 100_000


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of all of p and q."""
    return np.maximum((p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2.0 * (p @ q.T), 0.0)


def _distances(p: np.ndarray, q: np.ndarray):
    """(first row, squared distances) of slices of p against all of q."""
    step = max(1, CELLS // max(1, len(q)))
    for a in range(0, len(p), step):
        yield a, _squares(p[a : a + step], q)


def _pieces(p: np.ndarray, q: np.ndarray, radius: float):
    """(rows of p, rows of q) that together hold all pairs within the radius, every row of p with each of its q once:
    both sides are cut where few of q lie within the radius of the cut, for as long as that saves comparisons."""
    todo = [(np.arange(len(p)), np.arange(len(q)))]
    while todo:
        i, j = todo.pop()
        if len(i) * len(j) > PIECE:
            v = q[j[:: max(1, len(j) // 256)]]
            cuts = np.quantile(v, np.linspace(0.2, 0.8, 7), axis=0, method="nearest")
            near = (np.abs(v[None] - cuts[:, None]) <= radius).mean(1)
            k, dim = np.unravel_index(near.argmin(), near.shape)
            cut = cuts[k, dim]
            low, at = p[i, dim] < cut, q[j, dim]
            sides = (i[low], j[at < cut + radius]), (i[~low], j[at >= cut - radius])
            if sum(len(a) * len(b) for a, b in sides) < 0.8 * len(i) * len(j):
                todo += sides
                continue
        if len(i) and len(j):
            yield i, j


def _vectors(batch, name: str = "at") -> np.ndarray:
    column = batch[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _sampled(points: DataFrame, n: int, rows: int) -> np.ndarray:
    return _vectors(points.select("at").sample(min(1.0, rows / max(1, n)), seed=29).toArrow())


# --- cells -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Centres; and, once counted, per cell the records, the sums of their differences from the centre and of their
    squares, how far they reach from it, how near others come to it, and the smallest id."""

    centres: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    reach: np.ndarray
    outside: np.ndarray
    least: np.ndarray
    radius: float

    @property
    def closed(self) -> np.ndarray:
        """Which cells have no other record within the radius of any of theirs."""
        return self.outside > (self.reach + self.radius) * (1 + 1e-9)

    def apart(self, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Sum of the squared distances to all records of the cell."""
        off = at - self.centres[cell]
        return np.maximum(self.n[cell] * (off * off).sum(1) - 2 * (off * self.sums[cell]).sum(1) + self.squares[cell], 0.0)


def plan_cells(at: np.ndarray, each: float, radius: float, least: int) -> np.ndarray:
    """Centres of the places where at least `least` records lie within half the radius, going by sampled ones that stand
    for `each` records; at most one for every SHOWN sampled records."""
    need = max(SHOWN, int(np.ceil(least / max(each, 1.0))))
    near2 = (radius / 2) ** 2
    around = np.zeros(len(at), np.int64)
    for a, d2 in _distances(at, at):
        around[a : a + len(d2)] = (d2 <= 4 * near2).sum(1)
    free, centres = np.ones(len(at), bool), []
    for k in np.argsort(-around, kind="stable").tolist():
        if around[k] < need:
            break
        if not free[k]:
            continue
        rest = at[free]
        centre = at[k]
        # towards the middle of the free records around
        for size2 in (4 * near2, near2, near2):
            around_it = rest[_squares(centre[None], rest)[0] <= size2]
            centre = around_it.mean(0) if len(around_it) else centre
        mine = _squares(centre[None], at)[0] <= near2
        free[k] = False
        if (mine & free).sum() + 1 >= need:
            centres.append(centre)
            free &= ~mine
    return np.array(centres).reshape(len(centres), at.shape[1])


def _assign(centres: np.ndarray, radius: float):
    """Arrow function: the cell of every record, -1 without one."""

    def run(batches):
        for batch in batches:
            at = _vectors(batch)
            cell = np.full(len(at), -1, np.int32)
            if len(centres):
                for a, d2 in _distances(at, centres):
                    k = d2.argmin(1)
                    # a little less than half the radius, so that rounding never makes two of a cell no neighbours
                    inside = d2[np.arange(len(d2)), k] <= (radius / 2 * (1 - 1e-9)) ** 2
                    cell[a : a + len(d2)] = np.where(inside, k, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _count_cells(centres: np.ndarray):
    """Arrow function: per batch what Cells holds of every cell."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, cell, weight, ids = _vectors(batch), batch["cell"].to_numpy(), batch["weight"].to_numpy(), batch["id"].to_numpy()
            far = np.full(len(centres), np.inf)
            for a, d2 in _distances(at, centres):
                mine = cell[a : a + len(d2)]
                d2[np.nonzero(mine >= 0)[0], mine[mine >= 0]] = np.inf
                far = np.minimum(far, np.sqrt(d2.min(0)))
            rows = []
            for c in range(len(centres)):
                own = cell == c
                off = at[own] - centres[c]
                off2, w = (off * off).sum(1), weight[own]
                reach = float(np.sqrt(off2.max(initial=0.0)))
                rows.append((c, int(w.sum()), (off * w[:, None]).sum(0).tolist(), float((off2 * w).sum()), reach, float(far[c]), int(ids[own].min()) if own.any() else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.int64()))],
                names=["cell", "n", "sums", "squares", "reach", "outside", "least"],
            )

    return run


def count_cells(placed: DataFrame, centres: np.ndarray, radius: float) -> Cells:
    dims = range(centres.shape[1])
    per = placed.mapInArrow(_count_cells(centres), "cell int, n bigint, sums array<double>, squares double, reach double, outside double, least bigint").groupBy("cell").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in dims]).alias("sums"), F.sum("squares").alias("squares"), F.max("reach").alias("reach"),
        F.min("outside").alias("outside"), F.min("least").alias("least"),
    )
    rows = {r["cell"]: r for r in per.collect()} if len(centres) else {}  # one row per cell, whose number is bounded by the sample
    at = [rows[c] for c in range(len(centres))]
    of = lambda name, kind: np.array([r[name] for r in at], kind)
    least = np.array([-1 if r["least"] is None else r["least"] for r in at], np.int64)
    return Cells(centres, of("n", np.int64), of("sums", float).reshape(centres.shape), of("squares", float), of("reach", float), of("outside", float), least, radius)


def _closed(cells: Cells):
    """Arrow function: density, spread and group of the records of closed cells."""

    def run(batches):
        for batch in batches:
            cell = batch["cell"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["at"], batch["weight"], pa.array(cells.n[cell]), pa.array(cells.apart(_vectors(batch), cell) if len(cell) else np.empty(0)), pa.array(cells.least[cell])],
                names=["id", "at", "weight", "density", "apart", "group_id"],
            )

    return run


# --- blocks ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Blocks:
    """A k-d tree: nodes (dim, cut, left, right), dim -1 for a leaf whose number is `left`; chunks per leaf and cell, the
    last column for records of no cell."""

    nodes: list[tuple[int, float, int, int]]
    chunks: np.ndarray

    def place(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own) of every leaf a row reaches; own marks the leaf it belongs to."""
        rows, leaves, own = [], [], []
        todo = [(0, np.arange(len(at)), np.ones(len(at), bool))]
        while todo:
            node, row, mine = todo.pop()
            if not len(row):
                continue
            dim, cut, left, right = self.nodes[node]
            if dim < 0:
                rows.append(row)
                leaves.append(np.full(len(row), left))
                own.append(mine)
                continue
            v = at[row, dim]
            for side, reach, home in ((left, v < cut + radius, v < cut), (right, v >= cut - radius, v >= cut)):
                todo.append((side, row[reach], mine[reach] & home[reach]))
        return (np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows, np.int64), (leaves, np.int64), (own, bool)))


def plan_blocks(points: DataFrame, cells: Cells, radius: float, chunk: int = CHUNK) -> Blocks:
    n = points.count()
    rows = min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PER_LEAF * n // chunk))
    sample = points.select("at", "cell").sample(min(1.0, rows / max(1, n)), seed=29).toArrow()
    at, cell = _vectors(sample), sample["cell"].to_numpy()
    none = len(cells.centres)
    nodes: list[tuple[int, float, int, int]] = []
    chunks: list[np.ndarray] = []
    most = chunk * len(at) / max(1, n)

    def grow(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, len(chunks), 0))
        if len(part) > max(most, 8) and depth < 40:
            best = (0.5, -1, 0.0)
            for dim in range(at.shape[1]):
                v = np.sort(at[part, dim])
                cuts = v[(np.linspace(0.15, 0.85, 29) * (len(v) - 1)).astype(int)]
                near = np.searchsorted(v, cuts + radius) - np.searchsorted(v, cuts - radius)
                below = np.searchsorted(v, cuts)
                near = np.where((below == 0) | (below == len(v)), len(v), near)
                k = int(near.argmin())
                if near[k] / len(v) < best[0]:
                    best = (near[k] / len(v), dim, float(cuts[k]))
            if best[1] >= 0:
                _, dim, cut = best
                low = at[part, dim] < cut
                left = grow(part[low], depth + 1)
                right = grow(part[~low], depth + 1)
                nodes[me] = (dim, cut, left, right)
                return me
        held = np.bincount(np.where(cell[part] < 0, none, cell[part]), minlength=none + 1)
        chunks.append(np.maximum(1, np.ceil(held / max(most, 1) / 1.5)).astype(np.int64))
        nodes[me] = (-1, 0.0, len(chunks) - 1, 0)
        return me

    grow(np.arange(len(at)), 0)
    return Blocks(nodes, np.array(chunks))


def _spread(blocks: Blocks, cells: Cells, radius: float, asking: str | None):
    """Arrow function: records as askers (of their own leaf) and as candidates (of every leaf they reach), for every cell
    other than their own in which they may have neighbours, by chunk.  Only records with `asking` ask, if it is named."""
    none = len(cells.centres)

    def copies(batch: pa.RecordBatch, row, leaf, ca, cb, a, b, asks):
        for first in range(0, len(row), 5000):
            s = slice(first, first + 5000)
            part = batch.take(pa.array(row[s]))
            extra = [pa.array(v[s].astype(np.int32)) for v in (leaf, ca, cb, a, b)] + [pa.array(np.full(len(row[s]), asks))]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*batch.schema.names, "leaf", "ca", "cb", "a", "b", "asks"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, ids, cell = _vectors(batch), batch["id"].to_numpy(), batch["cell"].to_numpy()
            asking_rows = batch[asking].to_numpy(zero_copy_only=False) if asking else np.ones(len(at), bool)
            meets = np.ones((len(at), none + 1), bool)
            if none:
                meets[:, :none] = np.sqrt(_squares(at, cells.centres)) <= (cells.reach + radius) * (1 + 1e-9)
                meets[np.nonzero(cell >= 0)[0], cell[cell >= 0]] = False
            at_cell = np.where(cell < 0, none, cell)
            row, leaf, own = blocks.place(at, radius)
            for asks, keep in ((True, own & asking_rows[row]), (False, np.ones(len(row), bool))):
                i, other = np.nonzero(meets[row[keep]])
                r, l_ = row[keep][i], leaf[keep][i]
                mine = at_cell[r]
                m = (ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks.chunks[l_, mine]
                k = blocks.chunks[l_, other]
                j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                r, l_, mine, other, m = (np.repeat(x, k) for x in (r, l_, mine, other, m))
                yield from copies(batch, r, l_, *((mine, other, m, j) if asks else (other, mine, j, m)), asks)

    return run


def _by_block(points: DataFrame, blocks: Blocks, cells: Cells, radius: float, asking: str | None = None):
    schema = points.schema.simpleString()[7:-1] + ",leaf int,ca int,cb int,a int,b int,asks boolean"
    return points.mapInArrow(_spread(blocks, cells, radius, asking), schema).groupBy("leaf", "ca", "cb", "a", "b")


def _sides(t: pa.Table):
    asks = t["asks"].to_numpy()
    return [(part, _vectors(part)) for part in (t.filter(pa.array(asks)), t.filter(pa.array(~asks)))]


def densities(points: DataFrame, blocks: Blocks, cells: Cells, radius: float) -> DataFrame:
    """(id, density, apart): weights within the radius and the sum of the squared distances to them."""

    def count(t: pa.Table) -> pa.Table:
        (mine, p), (other, q) = _sides(t)
        density, apart = np.zeros(len(p), np.int64), np.zeros(len(p))
        if len(p) and len(q):
            weight = other["weight"].to_numpy().astype(float)
            for i, j in _pieces(p, q, radius):
                for a, d2 in _distances(p[i], q[j]):
                    near = d2 <= radius * radius
                    density[i[a : a + len(d2)]] = np.rint(near @ weight[j])
                    apart[i[a : a + len(d2)]] = (d2 * near) @ weight[j]
        return pa.table({"id": mine["id"], "density": density, "apart": apart})

    def of_cell(batches):
        for batch in batches:
            inside = np.nonzero(batch["cell"].to_numpy() >= 0)[0]
            cell = batch["cell"].to_numpy()[inside]
            at = _vectors(batch)[inside] if len(inside) else np.empty((0, cells.centres.shape[1]))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(inside)), pa.array(cells.n[cell]), pa.array(cells.apart(at, cell))], names=["id", "density", "apart"])

    kind = "id bigint, density bigint, apart double"
    counted = _by_block(points, blocks, cells, radius).applyInArrow(count, kind)
    if len(cells.centres):
        counted = counted.unionByName(points.select("id", "at", "cell").mapInArrow(of_cell, kind))
    return counted.groupBy("id").agg(F.sum("density").alias("density"), F.sum("apart").alias("apart"))


def pointers(points: DataFrame, blocks: Blocks, cells: Cells, radius: float) -> DataFrame:
    """(id, to): where every record points, the densest of its cell or the nearest denser record within the radius; peaks
    point to themselves."""
    # one row per cell, whose number is bounded by the sample
    tops = points.where("cell >= 0").groupBy("cell").agg(F.min(F.struct((-F.col("density")).alias("d"), "id"))["id"].alias("top")).collect()
    top_of = F.create_map(*[F.lit(x) for r in tops for x in (r["cell"], r["top"])]) if tops else F.create_map(F.lit(-2), F.lit(-2))
    top = F.try_element_at(top_of, F.col("cell")).cast("bigint")
    points = points.withColumn("seeks", (F.col("cell") < 0) | (top == F.col("id")))

    def seek(t: pa.Table) -> pa.Table:
        (mine, p), (other, q) = _sides(t)
        ids, dens = mine["id"].to_numpy(), mine["density"].to_numpy()
        oid, odens = other["id"].to_numpy(), other["density"].to_numpy()
        # a place in the order of density makes one comparison do
        best, parent = np.full(len(p), np.inf), np.full(len(p), -1)
        if len(p) and len(q):
            order = np.lexsort((oid, -odens))
            oid, odens, q = oid[order], odens[order], q[order]
            place, end = np.searchsorted(-odens, -dens, "left"), np.searchsorted(-odens, -dens, "right")
            place = np.array([a + np.searchsorted(oid[a:b], i) for a, b, i in zip(place, end, ids)])
            for i, j in _pieces(p, q, radius):
                for a, d2 in _distances(p[i], q[j]):
                    mine = i[a : a + len(d2)]
                    d2[(d2 > radius * radius) | (j[None] >= place[mine, None])] = np.inf
                    k = d2.argmin(1)
                    best[mine] = d2[np.arange(len(d2)), k]
                    parent[mine] = j[k]
        has = np.isfinite(best)
        return pa.table({"id": ids[has], "apart": best[has], "to": oid[parent[has]] if len(oid) else np.empty(0, np.int64)})

    found = _by_block(points.select("id", "at", "cell", "density", "seeks"), blocks, cells, radius, "seeks").applyInArrow(seek, "id bigint, apart double, to bigint")
    nearest = found.groupBy("id").agg(F.min(F.struct("apart", "to"))["to"].alias("to"))
    return points.select("id", F.when(~F.col("seeks"), top).alias("_top")).join(nearest, "id", "left").select("id", F.coalesce("_top", "to", "id").alias("to"))


def follow(to: DataFrame) -> DataFrame:
    """(id, label): pointers (id, to) followed to their end by doubling; ends point to themselves.

    Only records that others point to are followed, then all take the end of theirs."""
    at = checkpointed(to.select("id", F.col("to").alias("label")))
    hops = checkpointed(at.select(F.col("label").alias("id")).distinct().join(at, "id"))
    while True:
        up = hops.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        nxt = checkpointed(hops.join(up, "label").select("id", F.col("_up").alias("label"), (F.col("_up") != F.col("label")).alias("_moved")))
        moved = nxt.where("_moved").limit(1).count()
        hops = nxt.select("id", "label")
        if not moved:
            break
    return keyed_join(at, hops.select(F.col("id").alias("label"), F.col("label").alias("_end")), "label", hops.count()).select("id", F.col("_end").alias("label"))


def touching(points: DataFrame, blocks: Blocks, cells: Cells, radius: float) -> DataFrame:
    """(low, high): distinct pairs of labels with members within the radius of each other; those of a cell have one label."""

    def seek(t: pa.Table) -> pa.Table:
        (mine, p), (other, q) = _sides(t)
        la, lb = mine["label"].to_numpy(), other["label"].to_numpy()
        found = set()
        if len(p) and len(q):
            for i, j in _pieces(p, q, radius):
                if la[i].min() == la[i].max() == lb[j].min() == lb[j].max():
                    continue
                for a, d2 in _distances(p[i], q[j]):
                    r, c = np.nonzero((d2 <= radius * radius) & (la[i[a : a + len(d2)], None] != lb[j][None]))
                    one, two = la[i[a + r]], lb[j[c]]
                    found |= set(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist()))
        low, high = zip(*sorted(found)) if found else ((), ())
        return pa.table({"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return _by_block(points, blocks, cells, radius).applyInArrow(seek, "low bigint, high bigint").distinct()


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) with linked labels made one: minimum labels spread over the links until none changes."""
    links = checkpointed(links)
    if not links.limit(1).count():
        return labels
    both = checkpointed(links.select("low", "high").unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high"))))
    best = checkpointed(both.select(F.col("low").alias("label")).distinct().withColumn("to", F.col("label")))
    while True:
        offers = both.join(best.withColumnsRenamed({"label": "low", "to": "offer"}), "low").groupBy(F.col("high").alias("label")).agg(F.min("offer").alias("offer"))
        step = best.join(offers, "label").select("label", F.least("to", "offer").alias("to"))
        # and from where it points now: halves the way each round
        up = step.select(F.col("label").alias("to"), F.col("to").alias("_up"))
        nxt = checkpointed(step.join(up, "to", "left").select("label", F.coalesce("_up", "to").alias("to")))
        moved = nxt.join(best.withColumnRenamed("to", "_was"), "label").where(F.col("to") != F.col("_was")).limit(1).count()
        best = nxt
        if not moved:
            break
    return keyed_join(labels, best, "label", best.count(), "left").select("id", F.coalesce("to", "label").alias("label"))


def clusters(df: DataFrame, key: str, features: list[str], radius: float, chunk: int = CHUNK, least: int = CELL_LEAST) -> DataFrame:
    """(key, group_id, density, apart) of every row that has all features: the group's smallest key, the number of
    rows within `radius` and the sum of the squared distances to them.

    `key` must be an integer and unique; rows with a null key, or a null or NaN feature, have no group and no row.
    Rows with equal features share their group.  An empty table gives an empty result.  Other columns are ignored.
    """
    sound = F.col(key).isNotNull()
    for f in features:
        sound = sound & F.col(f).isNotNull() & ~F.isnan(f)
    rows = df.where(sound).select(F.col(key).cast("bigint").alias("key"), F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features]).alias("at"))
    # equal rows are one weighted point from here on
    points = checkpointed(rows.groupBy("at").agg(F.min("key").alias("id"), F.count("*").alias("weight")).select("id", "at", "weight"))
    n = points.count()
    sample = _sampled(points, n, CELL_SAMPLE)
    centres = plan_cells(sample, n / max(1, len(sample)), radius, least) if len(sample) else np.empty((0, len(features)))
    placed = checkpointed(points.mapInArrow(_assign(centres, radius), points.schema.simpleString()[7:-1] + ",cell int"))
    cells = count_cells(placed, centres, radius)
    closed = F.col("cell").isin(np.nonzero(cells.closed)[0].tolist())
    done = placed.where(closed).mapInArrow(_closed(cells), "id bigint, at array<double>, weight bigint, density bigint, apart double, group_id bigint")

    rest = placed.where(~closed)
    blocks = plan_blocks(rest, cells, radius, chunk)
    dense = checkpointed(rest.join(densities(rest, blocks, cells, radius), "id"))
    labels = checkpointed(follow(pointers(dense.select("id", "at", "cell", "density"), blocks, cells, radius)))
    labelled = rest.select("id", "at", "cell").join(labels, "id")
    labels = checkpointed(united(labels, touching(labelled, blocks, cells, radius)))
    first = checkpointed(labels.groupBy("label").agg(F.min("id").alias("group_id")))
    named = keyed_join(labels, first, "label", first.count()).select("id", "group_id")
    of_point = dense.select("id", "at", "weight", "density", "apart").join(named, "id").unionByName(done)
    return _to_rows(rows, checkpointed(of_point.select("at", "weight", "density", "apart", "group_id"))).select(F.col("key").alias(key), "group_id", "density", "apart")


def _to_rows(rows: DataFrame, of_point: DataFrame) -> DataFrame:
    """Every row with what its point has; points of very many equal rows don't draw these together."""
    # the hash spares comparing whole vectors when sorting
    rows, of_point = (df.withColumn("_hash", F.xxhash64("at")) for df in (rows, of_point))
    heavy = of_point.where(F.col("weight") >= HEAVY).drop("_hash")
    n = heavy.count()
    if not n:
        return rows.join(of_point, ["_hash", "at"])
    marked = keyed_join(rows, heavy, "at", n, "left")
    return marked.where("weight is not null").unionByName(marked.where("weight is null").select(*rows.columns).join(of_point, ["_hash", "at"]).select(*marked.columns))


def described(found: DataFrame, key: str, typical: int = 3) -> DataFrame:
    """(group_id, size, typical): each group's size and its members of highest density, the closest to their neighbours first."""
    from pyspark.sql import Window

    # rounded, so that members of equal standing tie and the smaller key comes first
    w = Window.partitionBy("group_id").orderBy(F.desc("density"), F.round("apart", 9).asc(), F.col(key).asc())
    top = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= typical)  # planned as a top-k before the shuffle
    members = top.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(key).alias("k")))), lambda s: s["k"]).alias("typical"))
    return found.groupBy("group_id").agg(F.count("*").alias("size")).join(members, "group_id")
