import random

import numpy as np

from pivotlake.llm import near_duplicates as nd
from pivotlake.llm.components import components, joined
from pivotlake.llm.queries import QUERIES
from pivotlake.llm.words import WordCodes

SF = "/root/testdata/sf0.001"


def classes_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def brute(docs):
    known = WordCodes()
    grams = {i: nd.shingles((t or "").encode(), known) for i, t in docs}
    sets = {i: set(g.tolist()) for i, g in grams.items()}
    links = []
    for a in grams:
        for b in grams:
            if a < b and len(sets[a]) and len(sets[b]) and len(sets[a] & sets[b]) >= 0.4 * max(len(sets[a]), len(sets[b])):
                if nd.similarity(grams[a], grams[b]) >= 0.8:
                    links.append((a, b))
    return classes_of(grams, links)


def test_query_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert len(set(want.values())) < len(want)
    assert {r.doc_id: r.class_id for r in QUERIES["op9_near_duplicates"](spark, SF).collect()} == want


def test_groups_of_near_copies(spark, documents):
    random.seed(5)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for group in range(12):
        base = random.choices(words, k=random.choice([6, 9, 14, 40, 150, 600]))
        for _ in range(random.choice([2, 5, 40])):
            text = list(base)
            for _ in range(random.randrange(1 + len(text) // 25)):
                text[random.randrange(len(text))] = random.choice(words)
            docs.append((len(docs), " ".join(text)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(documents([(i, t, "s") for i, t in docs])).collect()}
    assert got == brute(docs)


def test_similarity_is_of_the_order():
    known = WordCodes()
    of = lambda t: nd.shingles(t.encode(), known)
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    assert nd.similarity(of(a), of(a)) == 1.0
    assert nd.similarity(of(f"{a} {b}"), of(f"{b} {a}")) == 0.0
    assert nd.similarity(of(a), of(a.upper() + "!")) == 1.0
    assert nd.similarity(of("same line here for all " * 10), of("same line here for all " * 100)) == 0.0
    assert nd.similarity(of(a), of(a.replace("a25", "x"))) == 41 / 51


def test_edges(spark, documents):
    long = "long text of words " + " ".join(f"z{i % 977}" for i in range(60_000))
    rows = [(1, None, "s"), (2, "", "s"), (3, " .. ", None), (4, "one two", "s"), (5, "One two!", "s"), (6, "two one", "s"), (None, "one two", "s")]
    rows += [(None, None, "s"), (None, "only here without id", "s"), (7, "a b c d e f g", "s"), (7, "a b c d e f g", "s"), (8, long, "s"), (9, long + " tail", "s")]
    docs = documents(rows, extra=["id", "key", "node", "label", "code", "row"])
    got = sorted(((r.doc_id or 0, r.class_id or 0) for r in nd.near_duplicates(docs).collect()))
    assert got == [(0, 0), (0, 0), (0, 4), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 8), (9, 8)]
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "only here without id"), (1, ""), (2, ""), (3, " .. "), (4, "one two"), (6, "two one"), (7, "a b c d e f g"), (8, long)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    random.seed(1)
    random.shuffle(chain)
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == classes_of({x for e in chain for x in e}, chain)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_marks_lose_no_similar_pair(spark):
    random.seed(7)
    known, words = WordCodes(), [f"w{i}" for i in range(300)]
    texts = []
    for length in [1, 3, 8, 30, 150, 700, 9000]:
        base = random.choices(words, k=length)
        for edits in range(6):
            text = list(base)
            for _ in range(1 + edits * length // 250):
                text[random.randrange(len(text))] = random.choice(words)
            texts.append(" ".join(text))
    grams = [nd.shingles(t.encode(), known) for t in texts]
    marked = spark.createDataFrame([(i, len(g), nd.marks(g).tolist()) for i, g in enumerate(grams)], "node bigint, n int, marks array<bigint>")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    kept = {tuple(r) for r in nd._possible(spark.createDataFrame(pairs, "a bigint, b bigint"), marked).collect()}
    similar = {(a, b) for a, b in pairs if nd.similarity(grams[a], grams[b]) >= 0.8}
    assert similar <= kept and len(similar) >= 12 and len(kept) < len(pairs) / 2
    assert int(np.bitwise_count(nd.marks(grams[-1]).view(np.uint64)).sum()) <= nd.MARKS


def test_texts_about_the_threshold_do_not_meet_in_all_pairs(spark, documents, monkeypatch):
    random.seed(11)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(150):
        text = list(base)
        for k in random.sample(range(150), random.choice([4, 5, 6])):
            text[k] = f"x{i}_{k}"
        docs.append((i, " ".join(text)))
    real, verified = nd.verified, []
    monkeypatch.setattr(nd, "verified", lambda pairs, rows: (verified.append(pairs.count()), real(pairs, rows))[1])
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(documents([(i, t, "s") for i, t in docs])).collect()}
    assert got == brute(docs)
    assert sum(verified) < 4 * len(docs)


def test_components_with_more_edges(spark):
    random.seed(3)
    edges = [(random.randrange(200), 200 + random.randrange(200)) for _ in range(260)]
    frame = lambda e: spark.createDataFrame(e, "a bigint, b bigint")
    for cut in (0, 90, 260):
        got = {r.node: r.label for r in joined(components(frame(edges[:cut])), frame(edges[cut:])).collect()}
        assert got == classes_of({x for e in edges for x in e}, edges)
