"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Equal vectors are one point. Points are parted by norm, into classes within which norms
differ by less than a factor of two. In its class a point of norm r gets one more
coordinate, the root of M^2 - r^2 with M the largest norm there, and queries get a zero:
nearest by distance is then largest by inner product. Each of ``TABLES`` tables of a class
cuts the space by m random normal projections, shifted and divided into cells of width
``WIDTH``; the cell numbers are the bucket. A query visits, in every table of every class,
the buckets whose cells are near its own place: the sum of the squared distances to the
cell borders is the order of estimated success. m grows with the logarithm of the number
of points. Up to which distance buckets are visited is fitted on a bounded sample, so that
the sample's recall reaches ``RECALL``, however many cells away that is; every point is in
the tables. A class of at most ``EXACT`` points, or one in which that would
cost more than comparing all its points, is one bucket that every query visits.

Buckets are joined to their visitors in blocks of bounded size on both sides; a block
yields the best points of each visitor by exact inner products, and the best of all
blocks are merged. No task holds a whole bucket. Queries that met fewer points than asked
for are compared with every point, in the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pivotlake.llm.tables import stored

K = 20
TABLES = 4
WIDTH = 1.5
OCCUPANCY = 256
SAMPLE_POINTS, SAMPLE_QUERIES = 4096, 256
RECALL = 0.97
BLOCK = 2048
EXACT = 1024
PROBE = 64  # comparisons that cost as much as a visit of a cell


@dataclass
class Hashing:
    directions: np.ndarray  # tables x projections x (dimensions + 1)
    shifts: np.ndarray  # tables x projections
    largest: float
    furthest: float | None = 0.0  # of the cells to visit; None: the class is one bucket

    @classmethod
    def drawn(cls, dimensions: int, points: int, largest: float, seed: int = 5) -> Hashing:
        m = max(2, round(np.log2(max(points, 1) / OCCUPANCY) / 2))
        random = np.random.default_rng(seed)
        return cls(random.normal(size=(TABLES, m, dimensions + 1)), random.uniform(0, WIDTH, (TABLES, m)), largest)

    def _cells(self, vectors: np.ndarray) -> np.ndarray:
        """Positions in cells, rows x tables x projections."""
        return (np.einsum("nd,tmd->ntm", vectors, self.directions) + self.shifts) / WIDTH

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of points: rows x tables x projections."""
        unit = vectors / self.largest
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1, keepdims=True)))
        return np.floor(self._cells(np.hstack([unit, rest]))).astype(np.int64)

    def place(self, vector: np.ndarray) -> np.ndarray:
        """Position of a query in cells: tables x projections."""
        return self._cells(np.append(vector / np.linalg.norm(vector), 0.0)[None])[0]

    def probed(self, vector: np.ndarray) -> list[np.ndarray]:
        """Cells that a query visits: per table, rows in order of success."""
        return [_perturbed(row, furthest=self.furthest, reach=None) for row in self.place(vector)]


def _distances(at: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Squared distances of ``cells`` from the place ``at``, summed over projections."""
    below, above = at - cells - 1, cells - at
    return (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=-1)


def _perturbed(at: np.ndarray, probes: int | None = None, furthest: float = np.inf, reach: int | None = 1, most: float = np.inf) -> np.ndarray | None:
    """Cells at most ``furthest`` from ``at``, the nearest first, at most ``probes`` of them.

    No projection is moved more than ``reach`` cells, or any number if that is None. More
    than ``most`` cells are not made: the result is None.
    """
    home = np.floor(at).astype(np.int64)
    reach = int(np.sqrt(furthest)) + 1 if reach is None else reach
    steps = np.arange(-reach, reach + 1)
    cells, costs = np.empty((1, 0), np.int64), np.zeros(1)
    for start, x in zip(home, at, strict=True):
        step = _distances(np.array(x), (start + steps)[:, None])
        total = costs[:, None] + step[None]
        row, column = np.nonzero(total <= furthest)
        if len(row) > most:
            return None
        cells, costs = np.hstack([cells[row], (start + steps[column])[:, None]]), total[row, column]
    return cells[np.argsort(costs, kind="stable")[:probes]]


def _buckets(cells: np.ndarray) -> np.ndarray:
    """One number per row of cell numbers."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        key = (key ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fit(points: DataFrame, asking: list, count: int, dimensions: int, largest: float, k: int = K) -> Hashing:
    """Hashing that reaches the wanted recall on a sample of ``points``, those of one class.

    The sample is the first ``SAMPLE_POINTS`` by hash; ``asking`` (h1, h2, v) is one of queries.
    """
    hashing = Hashing.drawn(dimensions, count, largest)
    if count <= EXACT or not 0 < largest < np.inf:
        hashing.furthest = None
        return hashing
    sample = points.orderBy("h1", "h2").limit(SAMPLE_POINTS).select("h1", "h2", "v").collect()
    vectors = np.array([r.v for r in sample], np.float64).reshape(len(sample), dimensions)
    cells, names = hashing.points(vectors), {(r.h1, r.h2): i for i, r in enumerate(sample)}
    # The distance at which each wanted point is met, the least over all tables.
    met, places = [], []
    for r in asking:
        vector = np.array(r.v, np.float64)
        near = vectors @ vector
        if (r.h1, r.h2) in names:
            near[names[r.h1, r.h2]] = -np.inf
        wanted = np.argsort(-near)[: min(k, len(vectors) - 1)]
        places.append(hashing.place(vector))
        met.append(_distances(places[-1], cells[wanted]).min(axis=1))
    ranked = np.sort(np.concatenate([*met, np.zeros(0)]))
    if len(ranked):
        # Rounding must not shut out the very cell at this distance.
        hashing.furthest = float(ranked[int(np.ceil(RECALL * len(ranked))) - 1]) * (1 + 1e-9)
    work = 0.0
    for at in places:
        found = [_perturbed(row, furthest=hashing.furthest, reach=None, most=count) for row in at]
        if any(f is None for f in found):
            work = np.inf
            break
        work += sum(map(len, found)) * PROBE + (_distances(at, cells) <= hashing.furthest).sum() * count / len(cells)
    # Where cells cost more than they leave out, every point is compared.
    if work >= count * max(1, len(places)):
        hashing.furthest = None
    return hashing


def _valid(vectors: DataFrame, is_query: Column) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.xxhash64(v).alias("h1"), F.hash(v).alias("h2"), v.alias("v"))


_ENTRIES = "t int, bucket bigint, h1 bigint, h2 int, v array<double>, id bigint"
_BEST = "q1 bigint, q2 int, scores array<double>, h1s array<bigint>, h2s array<int>"


def _entries(classes: dict[int, Hashing], probing: bool):
    schema = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("v", pa.list_(pa.float64())), ("id", pa.int64())])

    def buckets(part: int, vectors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Table, bucket and row."""
        hashing = classes[part]
        if hashing.furthest is None:
            yield from ((part * TABLES, 0, i) for i in rows.tolist())
        elif probing:
            for i in rows.tolist():
                for t, cells in enumerate(hashing.probed(vectors[i])):
                    yield from ((part * TABLES + t, b, i) for b in dict.fromkeys(_buckets(cells).tolist()))
        elif len(rows):
            for i, found in zip(rows.tolist(), _buckets(hashing.points(vectors[rows])).tolist(), strict=True):
                yield from ((part * TABLES + t, b, i) for t, b in enumerate(found))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = np.array(batch.column(2).to_pylist()), batch.column(3).to_numpy()
            every = np.arange(len(vectors))
            rows = chain.from_iterable(buckets(c, vectors, every if probing else np.flatnonzero(own == c)) for c in classes)
            while some := list(islice(rows, 1 << 14)):
                t, bucket, i = zip(*some, strict=True)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(bucket, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(4).take(take)], schema=schema)

    return put


def _best(k: int):
    def match(points: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asking):
            return pd.DataFrame([], columns=["q1", "q2", "scores", "h1s", "h2s"])
        q, p = np.stack(asking["v"]), np.stack(points["v"])
        scores = q @ p.T
        n = min(k, len(p))
        # What may be as good as the last of the n best, rounding of matrix products considered.
        least = np.partition(scores, len(p) - n, axis=1)[:, len(p) - n]
        least = least - 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(p, axis=1).max()
        h1, h2, ids = points["h1"].to_numpy(), points["h2"].to_numpy(), points["id"].to_numpy()
        found = {"scores": [], "h1s": [], "h2s": []}
        for v, near, bound in zip(q, scores, least, strict=True):
            some = np.flatnonzero(near >= bound)
            # A product summed the same way for a pair in any block, unlike that of matrices.
            exact = np.einsum("d,kd->k", v, p[some])
            best = np.lexsort((ids[some], -exact))[:n]
            found["scores"].append(exact[best])
            found["h1s"].append(h1[some[best]])
            found["h2s"].append(h2[some[best]])
        return pd.DataFrame({"q1": asking["h1"], "q2": asking["h2"], **found})

    return match


def _norm() -> Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def _compared(entries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The best of every block of each bucket for each of its visitors."""
    blocks = lambda df, name: df.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = stored(blocks(entries, "parts").join(blocks(probes, "askers"), ["t", "bucket"]), "sizes")
    part = lambda n: F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["t", "bucket", "part", "asker"]
    left = entries.join(sizes, ["t", "bucket"]).withColumns({"part": part("parts"), "asker": each("askers")}).select(*key, "h1", "h2", "v", "id")
    right = probes.join(sizes, ["t", "bucket"]).withColumns({"part": each("parts"), "asker": part("askers")}).select(*key, "h1", "h2", "v", "id")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_best(k + 1), _BEST)


def _best_ids(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The ``k`` + 1 best ids of each query: q1, q2, vec_id, score."""
    # A query has at most tables x probes x parts rows of k + 1 candidates, which are put
    # together in one array; candidates as good as the last of the k + 1 best stay with it.
    zipped = F.arrays_zip(F.col("scores").alias("score"), F.col("h1s").alias("h1"), F.col("h2s").alias("h2"))
    best = found.groupBy("q1", "q2").agg(F.sort_array(F.flatten(F.collect_list(zipped)), False).alias("c"))
    # A point is met once a table at most, so this many hold k + 1 different ones.
    first = F.array_distinct(F.slice("c", 1, TABLES * (k + 1)))
    last = F.element_at(first, F.least(F.size(first), F.lit(k + 1)))["score"]
    # Held beside the candidates, the last is found once; inside the filter it would be for each of them.
    held = F.array(F.struct("c", last.alias("last")))
    good = F.transform(held, lambda b: F.array_distinct(F.filter(b["c"], lambda x: x["score"] >= b["last"])))
    best = best.select("q1", "q2", F.explode(good[0]).alias("c")).select("q1", "q2", "c.score", "c.h1", "c.h2")
    by_query = Window.partitionBy("q1", "q2")
    ids = best.join(members.select("h1", "h2", "vec_id"), ["h1", "h2"])
    ids = ids.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    return ids.select("q1", "q2", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) that is a query, its nearest others.

    Columns: query_id, rank (from 1), vec_id, score, the inner product in double
    precision. The ``k`` nearest found, nearest first, equal scores by smaller vec_id;
    a query's own vec_id is no candidate. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without vec_id or vectors whose
    length is not the most frequent one (of equally frequent ones the largest). Repeated
    rows count once. Other columns are ignored.
    """
    rows = _valid(vectors, is_query)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(_norm()).alias("norm"))
    chosen = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if chosen is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = stored(rows.where(F.size("v") == chosen.d).dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    # Of equal vectors only the k + 1 least ids can ever be among the k nearest of a query.
    order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = stored(rows.select("vec_id", "h1", "h2", "v").withColumn("place", order).where(F.col("place") <= k + 1), "members")
    # Norms within a factor of two are one class; a norm beyond the range of doubles is -1.
    part = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.floor(F.log2(F.lit(chosen.norm)) - F.log2("norm"))).otherwise(-1)
    # A point goes by the least of its ids, which decides between points of equal score.
    points = members.where("place = 1").select("h1", "h2", "v", F.col("vec_id").alias("id"), _norm().alias("norm"))
    points = stored(points.select("h1", "h2", "v", "id", "norm", F.greatest(part, F.lit(-1)).cast("int").alias("class")), "points")
    asking = stored(rows.where("asks").dropDuplicates(["h1", "h2"]).select("h1", "h2", "v", F.lit(0).alias("class"), F.lit(0).cast("bigint").alias("id")), "asking")
    some = asking.orderBy("h1", "h2").limit(SAMPLE_QUERIES).collect()
    # A class for each power of two, so at most about two thousand rows.
    parts = points.groupBy("class").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()
    classes = {r["class"]: fit(points.where(F.col("class") == r["class"]), some, r.n, chosen.d, r.norm, k) for r in parts}

    placed = points.select("h1", "h2", "v", "class", "id")
    found = _compared(placed.mapInArrow(_entries(classes, False), _ENTRIES), asking.mapInArrow(_entries(classes, True), _ENTRIES), k)
    ids = stored(_best_ids(found, members, k), "found")
    # Queries that met too few: every query is itself among the points.
    met = ids.groupBy("q1", "q2").agg(F.count("*").alias("met")).where(F.col("met") >= min(k + 1, members.count()))
    short = stored(asking.join(met, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left_anti"), "short")
    if not short.isEmpty():
        every = {0: Hashing(np.empty(0), np.empty(0), chosen.norm, None)}
        found = _compared(placed.withColumn("class", F.lit(0)).select(placed.columns).mapInArrow(_entries(every, False), _ENTRIES), short.mapInArrow(_entries(every, True), _ENTRIES), k)
        ids = ids.join(met.select("q1", "q2"), ["q1", "q2"], "left_semi").unionByName(_best_ids(found, members, k))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    pairs = asked.join(ids.select("q1", "q2", "vec_id", "score"), ["q1", "q2"]).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
