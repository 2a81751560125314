import hashlib

import pytest

from pivotlake.llm import mixing
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_targets_are_met(spark):
    rows = QUERIES["op7_source_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_source = {}
    for r in rows:
        assert r["size"] == len(docs[r.doc_id].text.split()) and r.taken in (0, r["size"], 2 * r["size"])
        by_source.setdefault(docs[r.doc_id].source, []).append(r)
    for mine in by_source.values():
        assert mine[0].target <= 2 * mine[0].source_size == 2 * sum(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    assert sum(m[0].target for m in by_source.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_water_filling(spark):
    # 5:2:1 of 150: a is clamped at 20, the rest goes 2:1 until b is clamped at 40 as well.
    sized = spark.createDataFrame([("a", 10), ("b", 20), ("c", 70)], "source string, size bigint")
    assert {r.source: r.target for r in mixing.targets(sized).collect()} == {"a": 20.0, "b": 40.0, "c": 90.0}


def test_edges(spark, documents):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (3, None, "s"), (4, "", "t"), (5, " \t\n", "t"), (6, "w " * 60_000, "u"), (7, "x y z q", "u")]
    docs = documents(rows, extra=["size", "place", "target", "times", "own_slice", "row"])
    got = mixing.mixed(docs).select("row.doc_id", "row.source", "size", "times", "target", "source_size").collect()
    assert {(r.doc_id, r["size"]) for r in got} == {(1, 2), (None, 3), (3, 0), (4, 0), (5, 0), (6, 60_000), (7, 2)}
    assert all(0 <= r.times <= 2 for r in got) and {r.target for r in got if r.source == "t"} == {0.0}
    mix = mixing.repeated(docs)
    assert mix.columns == docs.columns and {r["size"] for r in mix.collect()} == {"x"}
    assert sorted(r.doc_id or 0 for r in mix.collect()) == sorted(r.doc_id or 0 for r in mixing.repeated(docs).collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_the_fraction_ends_on_the_nearer_side(spark):
    """No prefix of a source's seeded order comes nearer to what is left of its target."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    by_source = {}
    for r in QUERIES["op7_source_mixing"](spark, sf).collect():
        by_source.setdefault(docs[r.doc_id], []).append(r)
    for mine in by_source.values():
        order = sorted(mine, key=lambda r: hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest())
        whole = min(r.taken // r["size"] for r in mine if r["size"])
        rest = mine[0].target - whole * mine[0].source_size
        sums = [0]
        for r in order:
            sums.append(sums[-1] + r["size"])
        taken = sum(r.taken for r in mine) - whole * mine[0].source_size
        assert abs(taken - rest) <= min(abs(x - rest) for x in sums) + 1e-6


def test_kept_columns_and_whole_rows_agree(spark, documents):
    docs = documents([(i, "w " * (i % 23), "abc"[i % 3]) for i in range(300)] + [(None, "x y", None)])
    narrow = {(r.doc_id, r.times) for r in mixing.mixed(docs, keep=("doc_id", "source")).select("row.doc_id", "times").collect()}
    assert narrow == {(r.doc_id, r.times) for r in mixing.mixed(docs).select("row.doc_id", "times").collect()}
