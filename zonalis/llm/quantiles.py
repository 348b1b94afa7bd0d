"""Mergeable quantile sketches of very large numeric columns with a deterministic rank-error bound.

Deterministic buffer collapsing: values fill sorted buffers of SIZE values.  FAN buffers of one weight are merged and
replaced by one buffer of FAN times the weight that takes evenly spaced positions of the merged sequence.  A collapse
moves the rank of any value by at most half the weight of its result; the sum of these halves travels with the
sketch and bounds the rank error of every answer.  Since only buffers of equal weight collapse, the collapses form a
tree of depth log_FAN(n / SIZE), and the bound is about n * depth / (2 * SIZE) ranks.

A sketch is a set of ordinary rows (keys, sketch, level, values, n, error), `sketch` a number of its own, and can be
stored, united with sketches of other days or files and merged: merge_sketches() takes any union.  Merging is itself
scheduled as a tree: its first round spreads a key's sketches by their numbers over nodes of MERGE_FAN / 4 on average,
and every further round joins MERGE_FAN nodes.
"""

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a buffer, and buffers that collapse at once.
SIZE = 1024
FAN = 16
#: Partial sketches of a key that one task merges.
MERGE_FAN = 64
#: Values a partition's sketches may hold before they are handed on.
HELD = 4_000_000

SKETCH = "level int, weight bigint, vals array<double>, n bigint, error bigint"
_ARROW = [
    pa.field("level", pa.int32()), pa.field("weight", pa.int64()), pa.field("vals", pa.list_(pa.float64())),
    pa.field("n", pa.int64()), pa.field("error", pa.int64()),
]


class Sketch:
    """The buffers of one key: loose values of weight 1 and full sorted buffers by level."""

    __slots__ = ("loose", "n_loose", "levels", "n", "error", "_odd")

    def __init__(self) -> None:
        self.loose: list[np.ndarray] = []
        self.n_loose, self.n, self.error, self._odd = 0, 0, 0, False
        self.levels: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._loosen(values)

    def _loosen(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        whole = SIZE * FAN
        if self.n_loose >= whole:
            # FAN full buffers of weight 1 at once: the same as filling and collapsing them one by one
            together = np.concatenate(self.loose)
            used = len(together) // whole * whole
            for a in range(0, used, whole):
                self._put(1, self._pick(np.sort(together[a : a + whole]), 1))
            self.loose, self.n_loose = [together[used:]], len(together) - used

    def _pick(self, merged: np.ndarray, weight: int) -> np.ndarray:
        """Evenly spaced positions; with an even fan the offset alternates between the two middle ones."""
        self.error += (FAN * weight + 1) // 2
        self._odd = not self._odd
        return merged[(FAN - 1) // 2 + (self._odd and FAN % 2 == 0) :: FAN]

    def _put(self, level: int, buffer: np.ndarray) -> None:
        here = self.levels.setdefault(level, [])
        here.append(buffer)
        if len(here) == FAN:
            self.levels[level] = []
            self._put(level + 1, self._pick(np.sort(np.concatenate(here)), FAN**level))

    def merge_row(self, level: int, values: np.ndarray, n: int, error: int) -> None:
        self.n += n
        self.error += error
        self._loosen(values) if level == 0 else self._put(level, values)

    def held(self) -> int:
        return self.n_loose + sum(len(b) * SIZE for b in self.levels.values())

    def rows(self) -> list[tuple[int, int, np.ndarray, int, int]]:
        """(level, weight, values, n, error); n and error stand on the first row alone, so that they add up."""
        out = [(0, 1, np.sort(np.concatenate(self.loose)) if self.loose else np.empty(0), self.n, self.error)]
        return out + [(level, FAN**level, b, 0, 0) for level, here in sorted(self.levels.items()) for b in here]


def _batch(keys: list, parts: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.string()), pa.array(parts, pa.int32())]
    columns += [pa.array([r[i] for r in rows], schema.field(2 + i).type) for i in range(5)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


_OUT = pa.schema([pa.field("_key", pa.string()), pa.field("_part", pa.int32()), *_ARROW])
_OUT_DDL = "_key string, _part int, " + SKETCH


def _build(batches):
    """Arrow function: one partial sketch per key and partition (several when a partition holds very many keys)."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    open_: dict = {}
    held = 0

    def flush():
        keys, rows = [], []
        for key, sketch in open_.items():
            for r in sketch.rows():
                keys.append(key)
                rows.append(r)
                if len(keys) == 256:
                    yield _batch(keys, [part] * len(keys), rows, _OUT)
                    keys, rows = [], []
        if keys:
            yield _batch(keys, [part] * len(keys), rows, _OUT)
        open_.clear()

    for batch in batches:
        encoded = batch.column(0).dictionary_encode(null_encoding="encode")
        names = encoded.dictionary.to_pylist()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        values = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        codes, values = codes[order], values[order]
        which, first = np.unique(codes, return_index=True)
        for code, mine in zip(which, np.split(values, first[1:])):
            sketch = open_.setdefault(names[code], Sketch())
            held -= sketch.held()
            sketch.add(np.array(mine, dtype=float))
            held += sketch.held()
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()


def _merge(table: pa.Table) -> pa.Table:
    """Grouped Arrow function: the partial sketches of one key and node become one."""
    sketch = Sketch()
    # a fixed order makes the result independent of how rows arrive
    order = sorted(range(table.num_rows), key=lambda i: (table["level"][i].as_py(), table["_part"][i].as_py(), i))
    vals = table["vals"].combine_chunks()
    for i in order:
        sketch.merge_row(table["level"][i].as_py(), vals[i].values.to_numpy(zero_copy_only=False).copy(), table["n"][i].as_py(), table["error"][i].as_py())
    rows = sketch.rows()
    key, part = table["_key"][0].as_py(), min(table["_part"].to_pylist())
    return pa.Table.from_batches([_batch([key] * len(rows), [part] * len(rows), rows, _OUT)])


def _key_of(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys))


def _merge_nodes(partial: DataFrame) -> DataFrame:
    """One sketch per key and _part."""
    return partial.groupBy("_key", "_part").applyInArrow(_merge, _OUT_DDL)


def _merge_tree(partial: DataFrame, parts: int) -> DataFrame:
    """One sketch per key out of those of the parts 0, 1, ... parts - 1; a task merges those of MERGE_FAN parts."""
    while parts > 1:
        partial = _merge_nodes(partial.withColumn("_part", F.floor(F.col("_part") / MERGE_FAN).cast("int")))
        parts = math.ceil(parts / MERGE_FAN)
    return partial


def _unkeyed(df: DataFrame, keys: list[str], types: str) -> DataFrame:
    """The sketches with their keys as columns and a number that no sketch of another call shares."""
    parsed = df.withColumn("_k", F.from_json("_key", types, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}))
    number = F.xxhash64(F.lit(uuid.uuid4().hex), "_key").alias("sketch")
    return parsed.select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], number, *[c for c in df.columns if c not in ("_key", "_part")])


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def build_sketches(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One sketch per key, as rows (keys, sketch, level, weight, vals, n, error).

    Null and NaN values aren't counted; a key without other values has no sketch.  Null keys form a key of their own.
    Repeated rows count as often as they occur.  Columns other than the keys and the value are neither read nor kept,
    so their names don't matter.  Keys may be of any type that JSON carries.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    pairs = counted.select(_key_of(keys).alias("_key"), F.col(value).cast("double").alias("_value"))
    merged = _merge_tree(pairs.mapInArrow(_build, _OUT_DDL), max(2, df.rdd.getNumPartitions()))
    return _unkeyed(merged, keys, _ddl(df, keys))


def nodes_of(sketches: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The sketches by (_key, _part), and over how many parts the first round of merging spreads those of a key.

    Counts the sketches of the largest key; reads them once for that."""
    # n stands on the first row of a sketch
    most = sketches.where("n > 0").groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    nodes = max(1, math.ceil(4 * most / MERGE_FAN))
    return sketches.select(_key_of(keys).alias("_key"), F.pmod("sketch", F.lit(nodes)).cast("int").alias("_part"), "level", "weight", "vals", "n", "error"), nodes


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key out of any union of sketches, e.g. of days or files; `keys` may be coarser than theirs.

    The same sketch must not be united with itself: its number says which rows belong together.  Sketches are meant to
    be stored, or checkpointed, before: they are read twice."""
    partial, nodes = nodes_of(sketches, keys)
    return _unkeyed(_merge_tree(_merge_nodes(partial), nodes), keys, _ddl(sketches, keys))


def query_sketches(sketches: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """(keys, n, rank_error_bound, fraction, value) for each fraction p: the value of rank ceil(p * n), at least 1.

    A value v is returned whose true rank range [count(< v) + 1, count(<= v)] lies within rank_error_bound of that
    rank.  Answers are values that occur in the data.  Sketches must be merged to one per key first.  A sketch's rows
    are bounded in number by FAN buffers per level, whatever n.
    """
    per_key = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("error").alias("rank_error_bound"),
        F.array_sort(F.flatten(F.collect_list(F.transform("vals", lambda v: F.struct(v.alias("v"), F.col("weight").alias("w")))))).alias("_all"),
    )
    asked = F.array(*[F.lit(float(p)) for p in fractions])
    ranked = per_key.withColumn("_rank", F.transform(asked, lambda p: F.greatest(F.ceil(p * F.col("n") - F.lit(1e-9)), F.lit(1)).cast("bigint")))

    @F.pandas_udf("array<double>")
    def answers(values: pd.Series, weights: pd.Series, ranks: pd.Series) -> pd.Series:
        out = []
        for v, w, r in zip(values, weights, ranks):
            at = np.searchsorted(np.cumsum(w), r)
            out.append(np.asarray(v)[np.minimum(at, len(v) - 1)])
        return pd.Series(out)

    found = ranked.withColumn("_found", answers(F.col("_all.v"), F.col("_all.w"), F.col("_rank")))
    return found.select(*keys, "n", "rank_error_bound", F.explode(F.arrays_zip(asked.alias("fraction"), F.col("_found").alias("value"))).alias("_z")).select(
        *keys, "n", "rank_error_bound", F.col("_z.fraction").alias("fraction"), F.col("_z.value").alias("value")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    return query_sketches(build_sketches(df, keys, value), keys, fractions)
