import hashlib
import re

from pivotlake.llm import decontaminate
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        found = words(text)
        width = min(13, len(found))
        for i in range(len(found) - width + 1 if width else 0):
            windows.setdefault(tuple(found[i : i + width]), set()).add(item)
    widths = {len(w) for w in windows}
    for doc_id, text in docs:
        found, hit, names = words(text), set(), set()
        for width in widths:
            for i in range(len(found) - width + 1):
                if (key := tuple(found[i : i + width])) in windows:
                    hit |= set(range(i, i + width))
                    names |= windows[key]
        names = ",".join(sorted(map(str, names)))
        yield (doc_id, len(found), len(hit), len(names.split(",")) if names else 0, hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(found))


def test_query_against_every_window(spark):
    got = {tuple(r)[:6] for r in QUERIES["op5_benchmark_decontamination"](spark, SF).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = set(brute(docs, items))
    assert any(x[5] for x in want)
    assert got == want


def test_edges_blocks_and_proximity(spark, documents):
    phrase = " ".join(f"w{i}" for i in range(15))
    rows = [(1, f"A {phrase.upper()} z", "s"), (1, f"A {phrase.upper()} z", "s"), (None, phrase, None), (3, None, "s"), (4, "", "s"), (5, "Hi", "t")]
    rows += [(6, phrase.replace("w7", "x w7"), "s"), (7, "short Item", "s"), (8, "w0 " * 50_000 + phrase, "s")]
    items = [(10, phrase), (9, "short-item"), (None, None), (11, " .. "), (10, phrase)]
    tests = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    docs = documents(rows, extra=["hits", "item"])
    for block_bytes in (1 << 20, 1):
        found = decontaminate.contamination(docs, tests, block_bytes=block_bytes).collect()
        assert len(found) == len(rows)
        got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in found}
        assert got == {
            (1, 17, 15, ("10",), True), (None, 15, 15, ("10",), True), (3, 0, 0, (), False), (4, 0, 0, (), False), (5, 1, 0, (), False),
            (6, 16, 0, (), False), (7, 2, 2, ("9",), True), (8, 50_015, 15, ("10",), False),
        }
        assert {r.doc_id for r in found if r.near_items and not r.items} == {6}
    kept = decontaminate.decontaminated(docs, tests)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.contamination(docs.limit(0), tests).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, tests.limit(0)).collect()} == {0}


def test_proximity_stays_inside_a_document(spark, documents):
    docs = documents([(1, "a b c x", "s"), (2, "d z y", "s"), (3, "a x b c d", "s"), (4, "a b c x d q", "s")]).coalesce(1)
    tests = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    found = {r.doc_id: r.near_items for r in decontaminate.contamination(docs, tests).collect()}
    assert found == {1: [], 2: [], 3: ["1"], 4: ["1"]}


def test_rows_without_id_are_judged_one_by_one(spark, documents):
    phrase = " ".join(f"w{i}" for i in range(13))
    docs = documents([(None, phrase, "s"), (None, "clean words", "s"), (5, phrase, "s"), (5, "clean words", "s"), (None, None, "s")])
    tests = spark.createDataFrame([(1, phrase)], "item_id bigint, text string")
    kept = decontaminate.decontaminated(docs, tests).select("doc_id", "text").collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.where("text IS NULL OR text = 'clean words'").select("doc_id", "text").collect()))
