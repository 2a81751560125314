"""The trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pivotlake.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def words(text):
    return len([w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])


def order(turn):
    t, role, text = turn
    return (t is not None, t or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest())


def by_hand(rows, family=20, most=4):
    given = defaultdict(list)
    for c, t, role, text in rows:
        given[c].append((t, role or "", text or ""))
    given = {c: [x[1:] for x in sorted(v, key=order)] for c, v in given.items()}
    paths = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % most if family and c is not None else 0
        paths[c] = tuple(given.get(c - c % family, [])[:h] + own[h:]) if h else tuple(own)
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * (words(k[-1][1]) if k else 0)
    out = []
    for k, v in members.items():
        ended = ",".join(map(str, sorted(c for c in v if paths[c] == k and c is not None)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, family=20, **options):
    done = prefix_trie.nodes(prefix_trie.prefixes(df, family), **options)
    return sorted(map(tuple, done.drop("code").collect()), key=str)


def drawn(seed, n=120, kinds=3, deep=7):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randrange(1, deep)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["one", "two words", " and  three\twords "][:kinds]) if draw.random() < 0.8 else f"own {c} {t}"))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_hand(spark, seed):
    rows = drawn(seed)
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_without_taking_over(spark):
    rows = drawn(3, n=60)
    assert found(spark.createDataFrame(rows, SCHEMA), family=None) == by_hand(rows, family=None)


def test_small_sketch_only_suspects_more(spark):
    rows = drawn(4, n=300, kinds=2)
    df = spark.createDataFrame(rows, SCHEMA)
    # 4,096 and 256 cells for more than a thousand prefixes: many wrong suspicions.
    assert found(df, most_cells=4096) == found(df, most_cells=256) == by_hand(rows)


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 20) for t in range(5)] + [(c, t, "user", f"{c} {t}") for c in range(1, 400, 7) for t in range(9)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(9)) == by_hand(rows)


def test_ids_joined_over_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 16)
    rows = [(c, 0, "user", "same") for c in range(-200, 400, 4)]
    assert found(spark.createDataFrame(rows, SCHEMA), family=None) == by_hand(rows, family=None)


def test_long_conversation(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(30_000)] + [(2, t, "user", str(t % 3)) for t in range(20_000)]
    got = found(spark.createDataFrame(rows, SCHEMA), family=None)
    assert len(got) == 30_001
    shared = [r for r in got if r[3] == 2]
    assert len(shared) == 20_001 and {r[5] for r in got} == {1}
    assert dict((r[1], r[6]) for r in shared)[0] == 20_000


def test_nulls_ties_repeats_turnless_and_clashes(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (7, None, None, "a"), (7, None, "user", "a"), (7, 1, "user", ""), (7, 1, "user", ""), (27, 1, "user", "b"), (27, 1, "user", "a"), (40, 0, "user", "a")]
    # Conversations that lose their only turns and have nobody to take over from.
    lonely = [c for c in range(1001, 1200) if zlib.crc32(str(c).encode()) % 4 > 0][:5]
    rows += [(c, 0, "user", "gone") for c in lonely]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", code string, family string, depth int")
    assert found(df) == by_hand(rows)
    assert found(df.where("false")) == []


def test_one_conversation_alone(spark):
    rows = [(5, t, "user", f"{t} x") for t in range(4)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
