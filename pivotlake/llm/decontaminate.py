"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` turns a corpus into index segments of about a million words. A segment
holds, for every term in it, the ascending positions of that term (its postings), and
where each document begins. Segments are built where the rows are read and stored as
one row each, so no posting is shuffled and a hot term costs as much as its words.

``search`` looks a set of phrases up: in each segment the postings of a phrase's terms
are intersected after subtracting each term's offset in the phrase, from the rarest
term on, so that common terms are only probed at the few places left. What is left at
the end are exact matches. Proximity matches let each term be up to ``slack`` words
away from its place.

Phrases are read in blocks of bounded size, so a test set may be larger than memory.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pivotlake.llm.tables import stored, utf8
from pivotlake.llm.words import folded_words

WINDOW = 13
SEGMENT_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20

INDEX_SCHEMA = "doc_ids array<bigint>, sizes array<int>, terms binary, ends binary, postings binary"
_INDEX_ARROW = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("ends", pa.binary()),
        ("postings", pa.binary()),
    ]
)


def _segment(doc_ids: list, sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
    postings = np.argsort(ids, kind="stable").astype("<u4")
    ends = np.cumsum(np.bincount(ids, minlength=len(number))).astype("<u4")
    row = {
        "doc_ids": [doc_ids],
        "sizes": [sizes],
        "terms": [b"\n".join(number)],
        "ends": [ends.tobytes()],
        "postings": [postings.tobytes()],
    }
    return pa.RecordBatch.from_pydict(row, schema=_INDEX_ARROW)


def build_index(documents: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Index segments of all rows of ``documents`` (doc_id, text).

    A null text and a text without words take part with no postings. Every row is a
    document of its own, also when ids repeat or are null. Other columns are ignored.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, words = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = folded_words(text)
                doc_ids.append(doc_id)
                sizes.append(len(found))
                words += found
                if len(words) >= segment_words or len(doc_ids) >= segment_words:
                    yield _segment(doc_ids, sizes, words)
                    doc_ids, sizes, words = [], [], []
        if doc_ids:
            yield _segment(doc_ids, sizes, words)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))
    return rows.mapInArrow(build, INDEX_SCHEMA)


class Phrases:
    """Distinct phrases of a block of test items, their terms numbered."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        phrases: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = folded_words(text)
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                phrases[tuple(words[i : i + width])].add(item)
        self.terms: dict[bytes, int] = {}
        self.window = window
        self.items = list(phrases.values())
        self.width = np.array([len(p) for p in phrases], dtype=np.int64)
        self.grid = np.full((len(phrases), window), -1, dtype=np.int64)
        for row, phrase in enumerate(phrases):
            self.grid[row, : len(phrase)] = [self.terms.setdefault(w, len(self.terms)) for w in phrase]


class Segment:
    """One index segment, opened for the terms of some phrases."""

    def __init__(self, sizes: np.ndarray, terms: bytes, ends: bytes, postings: bytes, phrases: Phrases):
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.sizes, self.phrases = sizes, phrases
        place = {term: i for i, term in enumerate(terms.split(b"\n"))} if len(ends) else {}
        stop = np.frombuffer(ends, dtype="<u4").astype(np.int64)
        start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        places = np.frombuffer(postings, dtype="<u4")
        at = [place.get(term) for term in phrases.terms]
        self.lists = [places[start[i] : stop[i]].astype(np.int64) if i is not None else None for i in at]
        self.counts = np.array([0 if x is None else len(x) for x in self.lists] + [np.iinfo(np.int64).max])

    def _within(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Those starts whose phrase stays inside one document."""
        starts = starts[starts >= 0]
        doc = np.searchsorted(self.ends, starts, side="right")
        inside = doc < len(self.ends)
        inside[inside] = starts[inside] + width <= self.ends[doc[inside]]
        return starts[inside]

    def matches(self, slack: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(phrase, exact starts, near starts): where each phrase occurs in this segment."""
        grid, width = self.phrases.grid, self.phrases.width
        counts = self.counts[grid]
        for row in np.flatnonzero((counts > 0).all(axis=1)):
            rarest = np.argsort(counts[row, : width[row]], kind="stable")
            lists = [(self.lists[grid[row, j]], j) for j in rarest]
            exact = near = self._within(lists[0][0] - lists[0][1], width[row])
            for postings, offset in lists[1:]:
                # A term may stray, but not into another document.
                doc = np.searchsorted(self.ends, near, side="right")
                low = np.maximum(near + offset - slack, self.ends[doc] - self.sizes[doc])
                high = np.minimum(near + offset + slack, self.ends[doc] - 1)
                i = np.searchsorted(postings, low)
                near = near[(i < len(postings)) & (postings[np.minimum(i, len(postings) - 1)] <= high)]
                at = exact + offset
                i = np.searchsorted(postings, at)
                exact = exact[(i < len(postings)) & (postings[np.minimum(i, len(postings) - 1)] == at)]
                if not len(near):
                    break
            if len(near):
                yield row, exact, near


_HITS = "segment string, place int, doc_id bigint, n_words int, hits array<int>, items array<string>, near array<string>"
_HITS_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("place", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int32()),
        ("hits", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
        ("near", pa.list_(pa.string())),
    ]
)


def _search_block(index: DataFrame, items: list[tuple[str, bytes]], window: int, slack: int) -> DataFrame:
    """Per document, word numbers hit by an exact match and the matching items."""

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                segment = Segment(sizes, row["terms"], row["ends"], row["postings"], phrases)
                edge = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
                exact_items, near_items = defaultdict(set), defaultdict(set)
                for phrase, exact, near in segment.matches(slack):
                    np.add.at(edge, exact, 1)
                    np.add.at(edge, exact + phrases.width[phrase], -1)
                    for starts, found in ((exact, exact_items), (near, near_items)):
                        for doc in np.unique(np.searchsorted(segment.ends, starts, side="right")):
                            found[doc] |= phrases.items[phrase]
                hit = np.flatnonzero(np.cumsum(edge) > 0)
                owner = np.searchsorted(segment.ends, hit, side="right")
                first = segment.ends - sizes
                hits = [[] for _ in sizes]
                for doc in np.unique(owner):
                    hits[doc] = (hit[owner == doc] - first[doc]).tolist()
                name = hashlib.md5(row["ends"] + row["postings"] + str(row["doc_ids"]).encode()).hexdigest()
                n = len(sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [name] * n,
                        "place": list(range(n)),
                        "doc_id": row["doc_ids"],
                        "n_words": row["sizes"],
                        "hits": hits,
                        "items": [sorted(exact_items.get(i, ())) for i in range(n)],
                        "near": [sorted(near_items.get(i, ())) for i in range(n)],
                    },
                    schema=_HITS_ARROW,
                )

    return index.mapInArrow(look_up, _HITS)


def search(index: DataFrame, tests: DataFrame, window: int = WINDOW, slack: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document of ``index`` with the items of ``tests`` (item_id, text) found in it.

    Columns: doc_id, n_words, hits (numbers of the words inside exact matches), items
    and near_items (sorted ids as strings). A phrase is ``window`` consecutive words of
    an item; an item of fewer words, but not none, is one phrase. A null item id is
    listed as the empty string; rows of one item id count as one item. Test items are
    taken in blocks of about ``block_bytes``, one after another: each is sent to the tasks
    whole, reads the index once, and its finds are written; then they are put together per
    document.
    """
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    texts = tests.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        part = _search_block(index, [(r.item, bytes(r.text)) for r in mine.collect()], window, slack)
        if blocks > 1:
            # One block at a time: what it found is written before the next one is read.
            part = stored(part, "found")
        found = part if found is None else found.union(part)
    if blocks > 1:
        merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        # Equal rows of equal segments stay apart by how often a block returned them.
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(
            *(merge(c).alias(c) for c in ("hits", "items", "near")), (F.count("*") / blocks).cast("int").alias("times")
        ).withColumn("times", F.explode(F.sequence(F.lit(1), "times")))
    return found.select("doc_id", "n_words", "hits", "items", F.col("near").alias("near_items"))


def contamination(documents: DataFrame, tests: DataFrame, window: int = WINDOW, slack: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``search`` over a fresh index of ``documents``, with the verdict per document.

    contaminated: at least one word is hit, and at least a twentieth of all words.
    """
    index = stored(build_index(documents), "postings")
    return search(index, tests, window, slack, block_bytes).select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hits").cast("bigint").alias("n_hit"),
        "items",
        "near_items",
        ((F.size("hits") > 0) & (20 * F.size("hits").cast("bigint") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns.

    A row is judged by its id and its text together: rows that share an id, or have none,
    stay or go on their own; only equal texts of an id share their fate.
    """
    key = F.xxhash64("doc_id", "text")
    bad = contamination(documents.select(key.alias("doc_id"), "text"), tests).where("contaminated").select(F.col("doc_id").alias("bad_key")).distinct()
    return documents.join(bad, key == F.col("bad_key"), "left_anti")
