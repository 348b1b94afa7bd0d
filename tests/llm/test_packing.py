import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.llm.packing import VOCABULARY, Search, _Packer, audit, encoding, filling, pack, plan_packing, token_counts


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_the_plan_is_whole():
    rnd = random.Random(4)
    for _ in range(250):
        capacity = rnd.choice([10, 20, 50, 100])
        items = [rnd.randint(max(1, capacity // rnd.choice([3, 5, 10])), capacity) for _ in range(rnd.randint(1, 10))]
        packer = _Packer(Counter(items), capacity)
        packer.reduce()
        rest = list(Counter(packer.left).elements())
        optimum = fewest(items, capacity)
        assert packer.plan.bins + (fewest(rest, capacity) if rest else 0) == optimum
        plan, load, seen = plan_packing(Counter(items), capacity), Counter(), Counter()
        for size, first, start, bins, per in plan.runs:
            assert first == seen[size]
            seen[size] += bins * per
            for b in range(bins):
                load[start + b] += per * size
        assert seen == Counter(items) and max(load.values()) <= capacity and sorted(load) == list(range(plan.bins))
        assert plan.bins <= optimum * 11 / 9 + 1


def test_pack_places_every_piece_once(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([0, 7, 7, 7, 3, 64, 65, 200, rnd.randint(1, 64)])) for i in range(900)] + [(None, 12), (5, 12), (5, 12), (901, None)]
    df = spark.createDataFrame(sizes, "doc bigint, n_tokens bigint").repartition(4).withColumn("capacity", F.lit(1)).withColumn("container", F.lit("clash"))
    kinds = spark.createDataFrame([("a", 64), ("b", 500), ("none", None)], "container string, capacity_tokens int")
    out = pack(df, "doc", kinds).collect()
    for kind, capacity in (("a", 64), ("b", 500)):
        mine = [r for r in out if r["container"] == kind]
        assert sum(r["piece_no"] == 0 for r in mine) == len(sizes)
        assert sum(r["n_tokens"] for r in mine) == sum(n or 0 for _, n in sizes)
        load = Counter()
        for r in mine:
            load[r["container_no"]] += r["n_tokens"]
        assert max(load.values()) <= capacity and sorted(load) == list(range(max(load) + 1))
        whole = {r["doc"]: r["n_tokens"] for r in mine if r["piece_no"] == 0 and r["doc"] != 5}
        assert all(whole[i] == (n or 0) for i, n in sizes if i != 5 and (n or 0) <= capacity)
    assert {r["container"] for r in out} == {"a", "b"}
    assert pack(df.limit(0), "doc", kinds).count() == 0 and pack(df, "doc", kinds.limit(0)).count() == 0
    assert filling(pack(df, "doc", kinds), kinds).where("containers >= fewest and room_left < 0.02").count() == 2


def test_tokens_of_whole_texts(spark):
    try:
        enc = encoding(VOCABULARY)
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    texts = ["", None, "uno dos", "ñandú · pingüino\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    assert {r["doc"]: r["n_tokens"] for r in token_counts(df, "doc", "text").collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("capacity", [8192, 16384, 32768, 131072])
def test_search_is_exact_at_any_capacity(capacity):
    rnd = random.Random(capacity)
    for _ in range(10):
        counts = Counter(rnd.randint(1, capacity) for _ in range(3000)) + Counter({rnd.randint(1, capacity): 700})
        size = np.repeat(list(counts), list(counts.values()))
        number = np.concatenate([np.arange(n) for n in counts.values()])
        plan = plan_packing(counts, capacity)
        load = np.bincount(Search(plan).container_of(size, number), weights=size)
        assert len(load) == plan.bins and load.max() <= capacity and load.min() > 0


def test_large_containers_and_their_audit(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, rnd.choice([0, 40_000, 131_072, 300_000, rnd.randint(1, 131_072)])) for i in range(1500)], "doc bigint, n_tokens bigint")
    kinds = spark.createDataFrame([("a", 32_768), ("b", 131_072)], "container string, capacity_tokens int")
    out = pack(df, "doc", kinds)
    assert sorted(map(tuple, audit(out, df, kinds, "doc").collect())) == [("a", 1500, True, 0, 0), ("b", 1500, True, 0, 0)]
    assert all(0 < r["fixed"] <= r["containers"] for r in filling(out, kinds).collect())
    worse = out.withColumn("container_no", F.lit(0)).where("doc <> 3 or container <> 'a'").withColumn("piece_no", F.col("piece_no") * 2)
    assert all(not r["whole"] and r["overfull"] == 1 for r in audit(worse, df, kinds, "doc").collect())
