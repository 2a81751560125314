"""Language identification by rank-order profiles.

A profile ranks the ``PROFILE`` most frequent n-grams (one to three letters of a word
padded by spaces) of a language's training texts. A document's own profile is compared
to each: every n-gram adds how far it is out of place, at most ``PROFILE``. The nearest
language is predicted.

Training counts cover all training texts: tasks count the words of a batch per language,
turn distinct words into n-grams, and an aggregate adds up. Only the profiles, at most
``PROFILE`` rows a language, come to the driver.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pivotlake.llm.tables import remainder, utf8

PROFILE = 300
LENGTHS = (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


# In lower-case text: white space for all of ASCII but its letters.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def runs(text: bytes) -> list[str]:
    """What stands between ASCII signs and white space, in lower case. Nearly always a word."""
    return text.decode().lower().encode().translate(_LETTERS).decode().split()


def words_of(run: str) -> list[str]:
    """The words of a run. Those without a letter, such as of superscripts, are none."""
    return [run] if run.isalpha() else [w for w in _WORD.findall(run) if any(map(str.isalpha, w))]


def words(text: bytes) -> Counter:
    """Words with their counts."""
    return Counter(w for run in runs(text) for w in words_of(run))


def grams(word: str) -> list[str]:
    padded = f" {word} "
    # A single space is none.
    return [*word] + [padded[i : i + n] for n in LENGTHS[1:] for i in range(len(padded) - n + 1)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang[lang].update(runs(text))
        for lang, found in by_lang.items():
            counts: Counter = Counter()
            for run, n in found.items():
                for word in words_of(run):
                    for gram in grams(word):
                        counts[gram] += n
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "gram": list(counts), "n": list(counts.values())})


def fit(documents: DataFrame, profile: int = PROFILE) -> dict[str, dict[str, int]]:
    """Language -> n-gram -> rank, from all rows of ``documents`` that are not held out.

    Rows with a null lang or text teach nothing. Equal counts are ranked by the n-gram.
    """
    rows = documents.where(F.col("lang").isNotNull() & ~held_out()).select("lang", utf8().alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One row per language and n-gram; a group limit runs before the shuffle by language.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    profiles: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= profile).collect():
        profiles[r.lang][r.gram] = r["rank"] - 1
    return dict(profiles)


class _Numbers(dict):
    """Run -> numbers of the n-grams of its words as 32-bit integers, remembered up to a bound."""

    def __init__(self, number: dict[str, int], limit: int):
        super().__init__()
        self.number, self.limit = number, limit

    def __missing__(self, run: str) -> bytes:
        found = array("i", [self.number[g] for w in words_of(run) for g in grams(w)]).tobytes()
        if len(self) < self.limit:
            self[run] = found
        return found


class Classifier:
    """Compares documents to profiles; runs are turned into n-gram numbers once."""

    LIMIT = 500_000

    def __init__(self, profiles: dict[str, dict[str, int]], profile: int = PROFILE):
        self.langs = sorted(profiles)
        self.profile = profile
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        for lang in self.langs:
            for gram in profiles[lang]:
                self.number[gram]
        self.ranks = np.full((len(self.langs), len(self.number)), profile, np.int32)
        for row, lang in zip(self.ranks, self.langs, strict=True):
            for gram, rank in profiles[lang].items():
                row[self.number[gram]] = rank
        self.learned = len(self.number)
        self.known = _Numbers(self.number, self.LIMIT)

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and score: how much nearer the best profile is than the worst possible."""
        if not self.langs:
            return UNDETERMINED, 0.0
        if max(len(self.known), len(self.number)) >= self.LIMIT:
            self.known.clear()
            for gram in [g for g, i in self.number.items() if i >= self.learned]:
                del self.number[gram]
        found = np.frombuffer(b"".join(map(self.known.__getitem__, runs(text))), np.int32)
        # Every word has n-grams.
        if not len(found):
            return UNDETERMINED, 0.0
        counts = np.bincount(found)
        seen = np.flatnonzero(counts)
        if len(seen) > self.profile:
            least = np.partition(counts[seen], len(seen) - self.profile)[len(seen) - self.profile]
            seen = seen[counts[seen] >= least]
        # Equal counts share the middle of their ranks, so that no order among them matters.
        order = np.argsort(-counts[seen], kind="stable")
        seen, n = seen[order], counts[seen][order]
        first = np.searchsorted(-n, -n, side="left")
        rank = (first + np.searchsorted(-n, -n, side="right") - 1) / 2
        table = np.full((len(self.langs), len(seen)), self.profile, np.int32)
        old = seen < self.ranks.shape[1]
        table[:, old] = self.ranks[:, seen[old]]
        away = np.where(table < self.profile, np.minimum(np.abs(table - rank), self.profile), self.profile).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.profile * len(seen)))


def identified(documents: DataFrame, profiles: dict[str, dict[str, int]], profile: int = PROFILE) -> DataFrame:
    """Per row of ``documents``: row (the row itself), lang_pred and score (0 to 1).

    ``und`` with score 0 for a null text, one without letters, and if no language was
    learned. Equal distances go to the first language by name. Only the text is read.
    """

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(profiles, profile)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=["lang", "score"])

    found = documents.select(F.struct("*").alias("row"), predict(utf8()).alias("found"))
    return found.select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
