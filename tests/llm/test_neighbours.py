import time

import numpy as np
from pyspark.sql import functions as F

from pivotlake.llm import neighbours
from pivotlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def every():
    return F.col("vec_id") % 20 == 0


def brute(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    want = {}
    for q in queries:
        scores = x @ x[ids == q][0]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        want[q] = [(int(ids[j]), float(scores[j])) for j in order]
    return want


def test_recall_and_scores_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    vectors = dict(rows)
    got = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
        assert abs(r.score - np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float))) < 1e-12
    assert set(got) == set(want) and all([r["rank"] for r in g] == list(range(1, 21)) for g in got.values())
    hits = sum(len({r.vec_id for r in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_edges_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0])]
    rows += [(8, [-1.0, -1.0]), (9, [1.0, 2.0, 3.0]), (40, None), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (60, [0.5, 0.5]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS h1", "2 AS v", "3 AS bucket")
    got = {}
    for r in neighbours.nearest(df, every()).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    sound = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (8, [-1.0, -1.0]), (60, [0.5, 0.5])]
    assert got == brute(sound, [0, 20, 60])
    many = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))
    found = neighbours.nearest(many, every(), k=5).where("query_id IN (0, 20, 2000)").orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, *[0, 1, 2, 3, 4] * 2] and {r.score for r in found} == {25.0}
    assert neighbours.nearest(df.limit(0), every()).count() == 0
    assert neighbours.nearest(df.where("vec_id = 8"), every()).count() == 0


def test_probes_come_in_order():
    at = np.array([3.1, -2.6, 0.5])
    cells = neighbours._perturbed(at, 27)
    assert cells[0].tolist() == [3, -3, 0] and cells[1].tolist() == [2, -3, 0]
    assert len({tuple(c) for c in cells.tolist()}) == 27
    inside = at - np.floor(at)
    costs = [sum(inside[i] ** 2 if d < 0 else (1 - inside[i]) ** 2 if d else 0 for i, d in enumerate(c - cells[0])) for c in cells]
    assert costs == sorted(costs)


def found(spark, vectors, asks):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id").isin(asks)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_a_long_vector_does_not_hide_the_others(spark):
    vectors = np.random.default_rng(1).normal(size=(4000, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[3999] *= 100
    asks = list(range(0, 4000, 40))
    got, want = found(spark, vectors, asks), brute(list(enumerate(vectors)), asks)
    assert all(len(got[q]) == 20 for q in asks)
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in asks) >= 0.95 * 20 * len(asks)


def test_every_query_gets_all_its_rows(spark):
    random = np.random.default_rng(2)
    few = random.normal(size=(21, 64))
    few /= np.linalg.norm(few, axis=1, keepdims=True)
    assert {q: len(ids) for q, ids in found(spark, few, list(range(21))).items()} == dict.fromkeys(range(21), 20)
    # A query that lies apart from the only cluster meets nothing where it is.
    many = np.array([1.0] + [0.0] * 15) + random.normal(scale=0.02, size=(3000, 16))
    many[7] = -many[7]
    asks = [7, *range(100, 400)]
    got, want = found(spark, many, asks), brute(list(enumerate(many)), asks)
    assert all(len(got[q]) == 20 for q in asks) and got[7] == [i for i, _ in want[7]]


def test_probes_go_on_past_one_cell():
    cells = neighbours._perturbed(np.array([3.1, -2.6]), furthest=4.0, reach=None)
    at = np.array([3.1, -2.6])
    every = np.array([(i, j) for i in range(-3, 10) for j in range(-9, 5)])
    near = every[neighbours._distances(at, every) <= 4.0]
    assert {tuple(c) for c in cells.tolist()} == {tuple(c) for c in near.tolist()} and np.abs(cells - [3, -3]).max() > 1
    assert neighbours._perturbed(at, furthest=4.0, reach=None, most=3) is None


def test_ties_between_different_vectors_go_to_the_smaller_ids(spark):
    random = np.random.default_rng(7)
    vectors = random.normal(size=(3000, 8))
    # All have the same product with the query, in as many different vectors.
    vectors[:, 0] = 0.5
    vectors[0] = [2.0] + [0.0] * 7
    order = random.permutation(np.arange(1, 3000))
    df = spark.createDataFrame([(0, vectors[0].tolist())] + [(int(i), vectors[i].tolist()) for i in order], "vec_id bigint, embedding array<double>").repartition(7)
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}


def test_clustered_vectors_are_found_through_buckets(spark, monkeypatch):
    random = np.random.default_rng(9)
    centres = random.normal(size=(200, 32))
    vectors = centres[random.integers(0, 200, 20_000)] + random.normal(scale=0.1, size=(20_000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    made, fit = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    asks = list(range(0, 20_000, 100))
    got, want = found(spark, vectors, asks), brute(list(enumerate(vectors)), asks)
    assert made and all(h.furthest is not None for h in made)
    assert all(len(got[q]) == 20 for q in asks)
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in asks) >= 0.9 * 20 * len(asks)


def test_many_blocks_of_candidates_are_merged_in_time(spark):
    """Queries met in many blocks: the bound on what is kept is found once a query."""
    random = np.random.default_rng(4)
    queries, blocks, k = 40, 40, 20
    rows = [(q, 0, random.normal(size=k + 1).tolist(), random.integers(0, 1 << 40, k + 1).tolist(), [0] * (k + 1)) for q in range(queries) for _ in range(blocks)]
    best = {q: sorted((s, h) for r in rows if r[0] == q for s, h in zip(r[2], r[3]))[-k - 1 :] for q in range(queries)}
    members = spark.createDataFrame([(h, 0, i) for i, h in enumerate(sorted({h for r in rows for h in r[3]}))], "h1 bigint, h2 int, vec_id bigint")
    found = neighbours._best_ids(spark.createDataFrame(rows, neighbours._BEST), members, k)
    started = time.monotonic()
    got = found.groupBy("q1").agg(F.sort_array(F.collect_list("score")).alias("scores")).collect()
    assert time.monotonic() - started < 20
    assert {r.q1: r.scores for r in got} == {q: [s for s, _ in c] for q, c in best.items()}
