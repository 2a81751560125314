"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: its words in lower case, and the first four to six
letters of longer words, each hashed to one of 2^18 places. The score is the logistic
function of

    bias + sum of w_i + (sum over pairs of <v_i, v_j>) / number of terms

over the places present, so a pair may count for more than its terms do. Every place has
a weight and factors; none is left out. A weight is learnt in steps scaled by what the
term tells alone (its log odds, discounted where few rows speak for them); the factors are
learnt alike for all terms, so terms that tell nothing alone can tell much together. The
division keeps the many pairs of a long text from drowning its few telling terms.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, the first by
hash of id). Scoring covers every whole text where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pivotlake.llm.tables import give_back, remainder, stored_by_few, utf8

SAMPLE_ROWS = 20_000
FOLDS = 5
PREFIXES = (4, 5, 6)
BITS = 18
PLACES = 1 << BITS
FACTORS = 4
EPOCHS = 8
BATCH = 256
SLICE = 256
RATE, FACTOR_RATE = 0.3, 0.05
START = 0.1
DECAY = 1e-2
DOUBT = 20.0

_WORD = re.compile(r"[^\W_]+")


class Terms(dict):
    """Word -> hashes of its terms, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> bytes:
        parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
        hashes = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64).tobytes()
        if len(self) < self.LIMIT:
            self[word] = hashes
        return hashes

    def of(self, text: bytes) -> np.ndarray:
        words = set(_WORD.findall(text.decode().lower()))
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64))


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # by place
    factors: np.ndarray  # places x factors

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for rows of places, as from :meth:`known`."""
        out = [self._scores(rows[i : i + SLICE]) for i in range(0, len(rows), SLICE)]
        return np.concatenate([*out, np.empty(0)])

    def _scores(self, rows: list[np.ndarray]) -> np.ndarray:
        counts = np.array([len(r) for r in rows])
        index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), counts)
        linear = np.bincount(owner, self.weights[index], len(rows))
        pairs = np.zeros(len(rows))
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f].astype(np.float64)
            pairs += np.bincount(owner, v, len(rows)) ** 2 - np.bincount(owner, v * v, len(rows))
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2 / np.maximum(counts, 1), -30, 30)))

    @staticmethod
    def known(hashes: np.ndarray) -> np.ndarray:
        """The places of hashes, ascending and once each."""
        return np.unique(hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _told(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """What each place tells alone: its log odds times a trust between 0 and 1 that grows
    with the G statistic of place and label."""
    n, n1 = len(labels), labels.sum()
    with_one, without = np.zeros(PLACES), np.zeros(PLACES)
    for row, label in zip(rows, labels, strict=True):
        # A row holds a place once.
        (with_one if label else without)[row] += 1
    present = with_one + without
    g = np.zeros(PLACES)
    for seen, size, share in ((with_one, present, n1), (without, present, n - n1), (n1 - with_one, n - present, n1), (n - n1 - without, n - present, n - n1)):
        some = seen > 0
        g[some] += 2 * seen[some] * np.log(seen[some] * n / (size[some] * share))
    odds = np.log((with_one + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n - n1 + 1))
    g = np.maximum(g, 0)
    return np.where(present > 0, odds * (g / (g + DOUBT)) ** 2, 0.0)


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """A model from rows of places; without both labels it is the share of label 1.

    Adagrad on the log loss, in batches of rows; only the places of a batch are touched.
    """
    ones, n = labels.sum(), len(labels)
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else -5.0
    if not 0 < ones < n:
        return Model(bias, np.zeros(PLACES, np.float32), np.zeros((PLACES, FACTORS), np.float32))
    random = np.random.default_rng(seed)
    counts = np.array([len(r) for r in rows])
    told = _told(rows, labels)
    weights, factors = np.zeros(PLACES), random.normal(0, START, (FACTORS, PLACES))
    seen_bias, seen_weights, seen_factors = 1e-8, np.full(PLACES, 1e-8), np.full((FACTORS, PLACES), 1e-8)
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            size = np.maximum(counts[batch], 1)
            owner = np.repeat(np.arange(len(batch)), counts[batch])
            index = np.concatenate([rows[k] for k in batch])
            places, inverse = np.unique(index, return_inverse=True)
            total = lambda values: np.bincount(owner, values, len(batch))  # noqa: B023, E731
            at = factors[:, index]
            inner = np.array([total(v) for v in at])
            pairs = ((inner**2).sum(axis=0) - total((at**2).sum(axis=0))) / 2 / size
            z = bias + total((weights * told)[index]) + pairs
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            back = lambda values: np.bincount(inverse, values, len(places))  # noqa: B023, E731
            seen_bias += error.sum() ** 2
            bias -= float(RATE * error.sum() / np.sqrt(seen_bias))
            step = back(error[owner]) * told[places]
            seen_weights[places] += step**2
            weights[places] -= RATE * step / np.sqrt(seen_weights[places])
            each = (error / size)[owner]
            plain = back(each)
            for f in range(FACTORS):
                step = back(each * inner[f][owner]) - plain * factors[f, places] + DECAY / n * factors[f, places]
                seen_factors[f, places] += step**2
                factors[f, places] -= FACTOR_RATE * step / np.sqrt(seen_factors[f, places])
    return Model(bias, (weights * told).astype(np.float32), factors.T.astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(doc_id, FOLDS) == 0, F.lit(False))


def _hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Terms()
    for batch in batches:
        found = [Model.known(known.of(text)).astype("<i4").tobytes() for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "places"])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic) that are not held out.

    Label rows with a null id or label are left out; an id with several labels has the
    greatest, and of several documents of an id the least text is the example. Terms are
    hashed where the texts are read; the driver gets the places of at most ``sample_rows``
    examples, four bytes each.
    """
    mine = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    mine = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "label_id")
    # At most sample_rows rows on the broadcast side.
    rows = documents.select("doc_id", "text").join(F.broadcast(mine), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text")
    rows = rows.groupBy("label_id", "label").agg(F.min("text").alias("text")).select("label", utf8().alias("text"))
    # Ordered, so that training repeats exactly.
    sample = stored_by_few(rows.mapInArrow(_hash_rows, "label int, places binary"), "examples").orderBy("label", "places").toArrow()
    given = sample.column("label").to_numpy().astype(np.float64)
    return train([p for chunk in sample.column("places").chunks for p in _views(chunk)], given)


def _views(chunk: pa.Array) -> list[np.ndarray]:
    """The places of each row as a view of the chunk, which is not copied."""
    offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    data = chunk.buffers()[2]
    places = np.frombuffer(data, "<i4", len(data) // 4) if data else np.empty(0, "<i4")
    return [places[a // 4 : b // 4] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of ``documents``: row (the row itself), score and predicted (1 from 0.5 on).

    A null or empty text is scored by the bias alone. Only the text is read.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Terms()
        for texts in batches:
            scores = [np.empty(0)]
            for i in range(0, len(texts), SLICE):
                scores.append(model.score([model.known(known.of(t)) for t in texts.slice(i, SLICE).to_pylist()]))
            yield pa.array(np.concatenate(scores))
        known.clear()
        give_back()

    rows = documents.select(F.struct("*").alias("row"), score(utf8()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` not predicted toxic, with their columns."""
    return scored(documents, fit(documents, labels)).where("predicted = 0").select("row.*")
