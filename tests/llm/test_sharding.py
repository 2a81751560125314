"""Sharding against the plain greedy rule, and its promises on odd input."""

import random
from collections import Counter, defaultdict

import xxhash

from pivotlake.llm import sharding


def greedy(items, shards):
    """The rule without a heap: each item, largest first, to the first least loaded shard."""
    loads, where = [0] * shards, {}
    for size, *name in sorted(items, key=lambda x: (-x[0], x[1:])):
        shard = loads.index(min(loads))
        loads[shard] += size
        where[tuple(name)] = shard
    return where


def by_hand(texts, shards, bundles):
    """The shard of each text, from sizes counted in plain Python."""
    sizes = Counter()
    for t in texts:
        sizes[xxhash.xxh64_intdigest((t or "").encode(), seed=42)] += len((t or "").encode()) + 16
    signed = lambda code: code - (1 << 64) if code >= 1 << 63 else code
    items, name_of = Counter(), {}
    for code, size in sizes.items():
        alone = size > sum(sizes.values()) / bundles
        name_of[code] = (alone, signed(code) if alone else signed(code) % bundles)
        items[name_of[code]] += size
    where = greedy([(size, *name) for name, size in items.items()], shards)
    return [where[name_of[xxhash.xxh64_intdigest((t or "").encode(), seed=42)]] for t in texts]


def held(rows, shards):
    slots, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        by_text[r.row.text or ""].add(r.shard)
        assert r.size == len((r.row.text or "").encode()) + 16
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_heap_gives_what_the_plain_rule_gives():
    draw = random.Random(5)
    for _ in range(50):
        items = [(draw.choice([1, 5, 5, draw.randrange(1000)]), draw.random() < 0.3, i) for i in range(draw.randrange(60))]
        where = greedy(items, 7)
        assert sharding.schedule(items, 7) == [where[name] for _, *name in items for name in [tuple(name)]]


def test_as_by_hand_with_a_third_of_copies(spark):
    draw = random.Random(1)
    texts = ["hot text " * 40] * 1000 + [None, "", "", "é" * 50] + ["w " * draw.randrange(400) + str(i % 700) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = sorted(sharding.sharded(df, 6, bundles_per_shard=32).collect(), key=lambda r: r.row.doc_id)
    held(got, 6)
    assert [r.shard for r in got] == by_hand(texts, 6, 32 * 6)


def test_even_loads(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(i, "x" * int(draw.paretovariate(1.3) * 50)) if i % 3 else (i, f"{i} " + "y" * draw.randrange(300)) for i in range(20_000)], "doc_id bigint, text string")
    got = sharding.sharded(df).collect()
    held(got, 40)
    loads, groups = Counter(), Counter()
    for r in got:
        loads[r.shard] += r.size
        groups[r.row.text] += r.size
    assert len(loads) == 40
    largest = max(groups.values())
    mean = sum(loads.values()) / 40
    assert max(loads.values()) <= max(largest, mean * 1.01)


def test_slots_follow_the_order(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(500)], "doc_id bigint, text string").repartition(5)
    by_shard = defaultdict(list)
    for r in sharding.sharded(df, 3).collect():
        by_shard[r.shard].append((r.slot, r.row.doc_id))
    for rows in by_shard.values():
        ids = [doc_id for _, doc_id in sorted(rows)]
        assert ids == sorted(ids)


def test_nulls_repeats_clashes_and_nothing(spark):
    df = spark.createDataFrame([(None, None, "a", 1), (None, None, "a", 1), (1, "same", "b", 2), (1, "same", "b", 2), (2, "", None, None)], "doc_id bigint, text string, shard string, slot int")
    got = sharding.sharded(df, 2).collect()
    held(got, 2)
    assert len(got) == 5
    assert sharding.sharded(df.where("false")).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 90}", "z") for i in range(300)], "doc_id bigint, text string, slot string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((s, i) for s, n in Counter(r.shard for r in back.collect()).items() for i in range(n))
