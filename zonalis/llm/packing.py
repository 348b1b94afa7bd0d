"""Texts put together into containers of fixed capacity with little room left over.

What the packing depends on is the histogram of sizes, whose rows are bounded by the capacity however many texts there
are; so it is planned once on the driver and carried out by all.

Plan: Martello and Toth's reduction first - a set of at most three sizes that provably dominates every other set
holding its largest item is fixed for good and removed, for as long as one is found - then best fit in descending
order of size for what remains.  Both work on multiplicities: one step fixes as many equal containers as there are
items for.

Carrying out: the texts of one size are numbered 0, 1, 2, ... by a two-step rank (counts per hash bucket, then the
rank inside the bucket), so that a size held by a third of all texts is still spread over many tasks; a text's
container follows from its number by a search in the plan.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.plans.runtime import checkpointed

#: A public byte-level vocabulary as ranks, and the split pattern that belongs to it (a fixed value).  The driver sends
#: the file to the executors, which need not have it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one size that one task numbers, about.
BUCKET_ROWS = 200_000

_encodings: dict = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if vocabulary not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, whole texts; a null text has none."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    sent = os.path.basename(vocabulary)

    def count(batches):
        enc = encoding(SparkFiles.get(sent))
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, text).mapInArrow(count, f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens bigint")


@dataclass
class Plan:
    """Runs of items: the items of `size` numbered from `first` fill `bins` containers from `start`, `per` each."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    fixed: int = 0


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.left)
        self.next = dict.fromkeys(self.left, 0)
        self.plan = Plan()

    def _take(self, size: int, start: int, bins: int, per: int) -> None:
        self.plan.runs.append((size, self.next[size], start, bins, per))
        self.next[size] += bins * per
        self.left[size] -= bins * per
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def _fix(self, items: dict[int, int], bins: int) -> None:
        start = self.plan.bins
        self.plan.bins += bins
        self.plan.fixed += bins
        for size, per in items.items():
            self._take(size, start, bins, per)

    def _smallest(self, without: int, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == without))
            if len(out) == n:
                break
        return out

    def _largest_upto(self, room: int, without: dict[int, int]) -> int | None:
        k = bisect_left(self.sizes, room + 1) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def _best_pair(self, room: int, big: int) -> tuple[int, int] | None:
        """Sizes (a >= b) of the two items beside one `big` with the largest sum up to `room`."""
        best, low = None, 0
        high = bisect_left(self.sizes, room) - 1
        while high >= low >= 0 and high >= 0:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > room:
                high -= 1
                continue
            partner = self._largest_upto(min(room - a, a), {big: 1} if a != big else {big: 2})
            if partner is not None and partner == a and self.left[a] - (a == big) < 2:
                partner = self._largest_upto(a - 1, {big: 1})
            if self.left[a] - (a == big) >= 1 and partner is not None and (best is None or a + partner > sum(best)):
                best = (a, partner)
                if sum(best) == room:
                    break
            high -= 1
        return best

    def _dominant(self, big: int) -> tuple[dict[int, int], int] | None:
        """The set of at most three items that dominates all sets with one `big`, and how often it may be fixed."""
        room = self.capacity - big
        small = self._smallest(big, 3)
        fit = sum(1 for k in range(len(small)) if sum(small[: k + 1]) <= room)
        if fit == 0:
            return {big: 1}, self.left[big]
        partner = self._largest_upto(room, {big: 1})
        if fit == 1 or partner == room:
            return ({big: 2}, self.left[big] // 2) if partner == big else ({big: 1, partner: 1}, min(self.left[big], self.left[partner]))
        if fit > 2:
            return None
        pair = self._best_pair(room, big)
        if pair is None or partner >= sum(pair):
            return ({big: 2}, self.left[big] // 2) if partner == big else ({big: 1, partner: 1}, min(self.left[big], self.left[partner]))
        a, b = pair
        if partner == a and len({a, b, big}) == 3:
            # the items next before b in descending order; with none but a between, or none that fit as a pair, {big, a, b} dominates
            before = [b] * min(2, self.left[b] - 1)
            k = bisect_left(self.sizes, b) + 1
            while len(before) < 2 and k < len(self.sizes) and self.sizes[k] < big:
                before += [self.sizes[k]] * min(2, self.left[self.sizes[k]])
                k += 1
            if len(before) >= 2 and big + before[0] + before[1] > self.capacity:
                return {big: 1, a: 1, b: 1}, max(1, min(self.left[big], self.left[a], self.left[b]) - 2)
        return None

    def reduce(self) -> None:
        moved = True
        while moved:
            moved = False
            for big in sorted(self.left, reverse=True):
                while big in self.left:
                    found = self._dominant(big)
                    if not found or found[1] < 1:
                        break
                    self._fix(*found)
                    moved = True

    def best_fit(self) -> None:
        """Best fit decreasing over ranges of equal containers by their room."""
        ranges: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, start: int, n: int) -> None:
            if n and room:
                if room not in ranges:
                    ranges[room] = []
                    insort(rooms, room)
                ranges[room].append((start, n))

        for size in sorted(self.left, reverse=True):
            while size in self.left:
                n = self.left[size]
                k = bisect_left(rooms, size)
                if k == len(rooms):
                    per = self.capacity // size
                    bins = n // per if n >= per else 1
                    per = min(per, n)
                    start = self.plan.bins
                    self.plan.bins += bins
                    self._take(size, start, bins, per)
                    put(self.capacity - per * size, start, bins)
                    continue
                room = rooms[k]
                start, have = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[k]
                per = room // size
                bins = min(have, n // per) if n >= per else 1
                per = min(per, n)
                self._take(size, start, bins, per)
                put(room - per * size, start, bins)
                put(room, start + bins, have - bins)


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for `counts` items of each size (1 to capacity)."""
    packer = _Packer(counts, capacity)
    packer.reduce()
    packer.best_fit()
    return packer.plan


def pack(sizes: DataFrame, key: str, containers: DataFrame, size: str = "n_tokens") -> DataFrame:
    """(container, key, piece_no, from_token, n_tokens, container_no, fixed) of every text in every kind of container.

    `fixed` tells whether the reduction filled the container; its containers come before those of best fit.
    `containers` holds (container, capacity_tokens); kinds without a positive capacity are left out.  A text above the
    capacity is cut into pieces of just the capacity and a rest; no other text is cut.  Texts of size 0 (null texts
    among them) need no room and lie in container 0.  Rows are packed as they come: repeated keys are packed each,
    null keys too.  Empty tables give an empty result.
    """
    spark = sizes.sparkSession
    kinds = containers.where(F.col("capacity_tokens") > 0).groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    kind_rows = kinds.collect()  # a list of kinds of container, as a caller states it
    if not kind_rows:
        kind_rows, kinds = [], spark.createDataFrame([], "container string, capacity int")
    base = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    whole = F.col("_size") <= F.col("capacity")
    last = F.when(whole, F.lit(0)).otherwise(F.floor((F.col("_size") - 1) / F.col("capacity")))
    pieces = (
        base.crossJoin(F.broadcast(kinds))  # a handful of kinds
        .select("container", key, "_size", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
        .select("container", key, "piece_no", (F.col("piece_no") * F.col("capacity")).alias("from_token"),
                F.least(F.col("capacity").cast("bigint"), F.col("_size") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))
    )
    n = sizes.count()
    buckets = max(1, n // BUCKET_ROWS)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)))
    counts = checkpointed(pieces.groupBy("container", "n_tokens", "_bucket").agg(F.count("*").alias("_n")))
    plans = {}
    for row in kind_rows:
        # at most as many rows as the capacity has tokens
        histogram = counts.where((F.col("container") == row["container"]) & (F.col("n_tokens") > 0)).groupBy("n_tokens").agg(F.sum("_n").alias("n")).collect()
        plans[row["container"]] = plan_packing({int(r["n_tokens"]): int(r["n"]) for r in histogram}, int(row["capacity"]))
    before = Window.partitionBy("container", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container", "n_tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("container", "n_tokens", "_bucket").orderBy(key, "piece_no")
    numbered = pieces.withColumn("_k", F.row_number().over(inside)).join(offsets, ["container", "n_tokens", "_bucket"]).withColumn("_k", F.col("_k") + F.col("_offset") - 1)
    shared = spark.sparkContext.broadcast({name: (Search(p), p.fixed) for name, p in plans.items()})

    def place(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            names = t["container"].combine_chunks().dictionary_encode()
            size_, k = t["n_tokens"].to_numpy(), t["_k"].to_numpy()
            code, out, fixed = names.indices.to_numpy(), np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, bool)
            for c, name in enumerate(names.dictionary.to_pylist()):
                mine = (code == c) & (size_ > 0)
                if mine.any():
                    table, n_fixed = shared.value[name]
                    out[mine] = table.container_of(size_[mine], k[mine])
                    fixed[mine] = out[mine] < n_fixed
            t = t.drop(["_bucket", "_k", "_offset"]).append_column("container_no", pa.array(out))
            yield from t.append_column("fixed", pa.array(fixed)).to_batches()

    kind = sizes.schema[key].dataType.simpleString()
    ordered = numbered.select("container", key, "piece_no", "from_token", "n_tokens", "_bucket", "_k", "_offset")
    return ordered.mapInArrow(place, f"container string, `{key}` {kind}, piece_no bigint, from_token bigint, n_tokens bigint, container_no bigint, fixed boolean")


class Search:
    """A plan's runs in the order of (size, first number).

    All items are numbered through, those of smaller sizes first, so that a run is found by one search of whole numbers,
    whatever the sizes."""

    def __init__(self, plan: Plan):
        runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
        size, self.first, self.start, bins, self.per = runs.T
        items = bins * self.per
        self.begin = np.cumsum(items) - items
        self.sizes, at = np.unique(size, return_index=True)
        self.base = self.begin[at]

    def container_of(self, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        item = self.base[np.searchsorted(self.sizes, size)] + number
        at = np.searchsorted(self.begin, item, side="right") - 1
        return self.start[at] + (number - self.first[at]) // self.per[at]


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity_tokens, texts, pieces, tokens, containers, fixed, fewest, room_left): how well each kind is
    filled; `fixed` containers come from the reduction, `fewest` is the least number that could hold the tokens."""
    used = packed.groupBy("container").agg(
        F.count_if(F.col("piece_no") == 0).alias("texts"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), (F.max("container_no") + 1).alias("containers"),
        F.coalesce(F.max(F.when(F.col("fixed"), F.col("container_no"))) + 1, F.lit(0)).alias("fixed"),
    )
    sized = used.join(containers.groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")), "container")
    room = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return sized.withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("room_left", F.round(room, 6))


def audit(packed: DataFrame, sizes: DataFrame, containers: DataFrame, key: str, size: str = "n_tokens") -> DataFrame:
    """(container, texts, whole, overfull, split): per kind the number of texts, whether their tokens are all there once,
    the containers above the capacity, and the texts that were cut although they fit.  Keys must be unique."""
    kinds = containers.where(F.col("capacity_tokens") > 0).groupBy("container").agg(F.max("capacity_tokens").alias("_capacity"))
    load = packed.groupBy("container", "container_no").agg(F.sum("n_tokens").alias("_load")).join(F.broadcast(kinds), "container")
    over = load.groupBy("container").agg(F.count_if(F.col("_load") > F.col("_capacity")).alias("overfull"))
    text = packed.groupBy("container", key).agg(
        F.count("*").alias("_pieces"), F.sum("n_tokens").alias("_tokens"), F.max("piece_no").alias("_last"), F.count_distinct("from_token").alias("_begins")
    ).join(sizes.select(key, F.coalesce(size, F.lit(0)).alias("_size")), key).join(F.broadcast(kinds), "container")
    sound = (F.col("_tokens") == F.col("_size")) & (F.col("_pieces") == F.col("_last") + 1) & (F.col("_begins") == F.col("_pieces"))
    per = text.groupBy("container").agg(
        F.count("*").alias("texts"), F.bool_and(sound).alias("whole"), F.count_if((F.col("_pieces") > 1) & (F.col("_size") <= F.col("_capacity"))).alias("split")
    )
    return per.join(over, "container")
