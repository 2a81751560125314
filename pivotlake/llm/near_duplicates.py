"""Near-duplicate documents by Order MinHash and banded alignment.

Shingles are runs of five words, labelled with the number of their occurrence in the
text, so that repeated lines count as often as they stand there. A sample takes the
``SAMPLE`` shingles with the least hashes and keeps them in text order; two texts agree
in it if they hold the same shingles in the same order, which edits rarely disturb and
reordering does. ``BANDS`` independent samples per text are the bucket keys: at
similarity 0.8 two texts agree in one sample with probability 0.41, and in none of 24
with 3 in a million. Texts of up to ``SHORT`` shingles take more samples of two
shingles, because few shingles make few different samples.

Exact copies are counted together first and take part as one text. In each bucket all
texts are compared with one leader, the first by a hash of the id. Where more than one
component of links is left in a bucket, ``ROUNDS`` rounds compare one text of each with
one of the bucket's largest component, drawn anew each time; a round makes as many pairs
as there are components. The texts of buckets that are still open are joined exactly, by
their rarest shingles and the places of these, across components only. Groups of close
copies end after the first steps, and texts that share a passage do not meet in the last.

Each text has ``MARKS`` bits: the parity of the number of its shingles that fall on each.
Two texts differ in no more bits than shingles, so pairs whose bits differ too often are
not verified; no similar pair is lost by that. Among texts of some hundreds of shingles
hardly any but similar pairs are left; those of thousands differ in more shingles than
there are bits, and pass.

A pair is verified on its whole texts: the two shingle sequences are aligned within the
band of offsets that a similarity at the threshold leaves open, and the similarity is
the number of shingles aligned in order over the number of shingles in either.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pivotlake.llm.components import components, joined
from pivotlake.llm.tables import give_back, rows_of, stored, stored_by_few, utf8
from pivotlake.llm.words import WordCodes, folded_words, gram_codes, mixed

SHINGLE = 5
THRESHOLD = 0.8
SAMPLE, BANDS = 4, 24
SHORT, SHORT_SAMPLE, SHORT_BANDS = 16, 2, 24
# So many ids are sent to all tasks at most; beyond, texts are shuffled.
FEW_IDS = 500_000
CELLS = 1 << 20
ROUNDS = 3
MARKS = 1024
KNOWN_WORDS = 150_000
# Ids from here on are made for rows that have none.
NO_ID = 1 << 62


def shingles(text: bytes, known: WordCodes) -> np.ndarray:
    """Codes of the occurrence-labelled shingles in text order; a shorter text is one shingle."""
    words = folded_words(text)
    if not words:
        return np.empty(0, np.uint64)
    grams = mixed(gram_codes(known.of(words), min(SHINGLE, len(words))))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if same.any():
        index = np.arange(len(grams))
        occurrence = np.empty(len(grams), np.uint64)
        occurrence[order] = index - np.maximum.accumulate(np.where(same, 0, index))
        grams = mixed(grams + occurrence * np.uint64(0xA0761D6478BD642F))
    return grams


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _samples(grams: np.ndarray, size: int, multipliers: np.ndarray) -> np.ndarray:
    """One key per multiplier: the ``size`` shingles of least hash, in text order."""
    size = min(size, len(grams))
    keys = []
    step = max(1, CELLS // len(grams))
    for i in range(0, len(multipliers), step):
        some = multipliers[i : i + step, None]
        chosen = np.argpartition(grams[None, :] * some, size - 1, axis=1)[:, :size]
        chosen.sort(axis=1)
        key = some[:, 0]
        for column in range(size):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grams[chosen[:, column]])
        keys.append(key)
    return np.concatenate(keys)


def sketch(grams: np.ndarray, long=_multipliers(BANDS, 1), short=_multipliers(SHORT_BANDS, 2)) -> np.ndarray:
    if not len(grams):
        return np.empty(0, np.int64)
    keys = [_samples(grams, SAMPLE, long)]
    if len(grams) <= SHORT:
        keys.append(_samples(grams, SHORT_SAMPLE, short))
    return np.concatenate(keys).view(np.int64)


def marks(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles on each of ``MARKS`` bits, as 64-bit numbers."""
    odd = np.bincount((grams % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Shingles aligned in order over shingles in either; 0 where it cannot reach the threshold."""
    total = len(x) + len(y)
    need = ceil(threshold * total / (1 + threshold) - 1e-9)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    # An alignment of ``need`` shingles leaves at most len - need behind on either side.
    inside = (i - j <= len(x) - need) & (j - i <= len(y) - need)
    order = np.argsort(i[inside])
    j = j[inside][order]
    if len(j) < need or not total:
        return 0.0
    aligned = len(j)
    if (j[1:] < j[:-1]).any():
        tails: list[int] = []
        for place in j.tolist():
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
        aligned = len(tails)
    return aligned / (total - aligned) if aligned >= need else 0.0


def _id():
    """The doc_id; a null one becomes a large number made from the text."""
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1)), 2) + F.lit(NO_ID)
    return F.coalesce(F.col("doc_id").cast("bigint"), made)


def _rows(documents: DataFrame) -> DataFrame:
    """id, two codes of the text, and the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        _id().alias("id"), F.col("doc_id").isNull().alias("made"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), utf8().alias("text")
    )


_SKETCHED = pa.schema([("id", pa.int64()), ("made", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int32()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])


def _sketch_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordCodes(KNOWN_WORDS)
    for batch in batches:
        sizes, keys, marked = [], [], []
        for *_, text in rows_of(batch):
            grams = shingles(text, known)
            sizes.append(len(grams))
            keys.append(sketch(grams))
            marked.append(marks(grams))
        given = [batch.column(i) for i in range(4)]
        made = [pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(marked, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*given, *made], schema=_SKETCHED)
    known.clear()
    give_back()


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordCodes(KNOWN_WORDS)
    last, x = None, None
    for batch in batches:
        out = []
        for a, b, text_a, text_b in rows_of(batch):
            if text_a != last:
                last, x = text_a, shingles(text_a, known)
            out.append((a, b, similarity(x, shingles(text_b, known))))
        out = [row for row in out if row[2] >= THRESHOLD]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_LINKS)
    known.clear()
    give_back()


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the rows with one of ``ids``."""
    ids = stored(ids.distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi").select("id", "text")


def _marks_allow(n: str, x: str, n2: str, y: str):
    """True where the marks ``x`` and ``y`` of texts of ``n`` and ``n2`` shingles allow the threshold.

    Texts at similarity t differ in (n + n2) (1 - t) / (1 + t) shingles at most.
    """
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(MARKS // 64)), F.lit(0))
    return differ <= (F.col(n) + F.col(n2)) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-6


def _possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose marks (node, n, marks) allow the threshold."""
    of = lambda end: marked.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("marks").alias(f"marks_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    # An id with several texts has several marks.
    return stored(both.where(_marks_allow("n_a", "marks_a", "n_b", "marks_b")).select("a", "b").distinct(), "possible")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar, with their similarity."""
    texts = _texts(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    with_b = pairs.join(texts, F.col("b") == F.col("id")).select("a", "b", F.col("text").alias("text_b"))
    both = with_b.join(texts, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("text_a"), "text_b")
    return stored_by_few(both.mapInArrow(_align, "a bigint, b bigint, similarity double"), "links")


def _pair(x: str, nx: str, y: str, ny: str, rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of texts whose sizes allow the threshold."""
    fits = F.least(nx, ny) >= F.greatest(nx, ny) * (THRESHOLD - 1e-9)
    return rows.where((F.col(x) != F.col(y)) & fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _gram_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordCodes(KNOWN_WORDS)
    for batch in batches:
        for node, text in rows_of(batch):
            grams = shingles(text, known).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node, np.int64)), pa.array(grams)], names=["node", "gram"])


def _by_prefix(left: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    """All pairs of texts in ``left`` (node, n, label) of unequal labels that may be similar.

    At similarity t two texts share one of the n - t n + 1 rarest shingles of either, and
    behind the rarest of all that they share enough others must follow in both. A
    shingle of a passage that many texts hold is none of the rarest ones, so texts that
    only share the passage do not meet. Pairs are judged by places and marks where they
    meet; those that pass both are mostly similar.
    """
    grams = _texts(rows, left.select(F.col("node").alias("id"))).mapInArrow(_gram_rows, "node bigint, gram bigint")
    grams = stored_by_few(grams.distinct(), "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    in_text = Window.partitionBy("node")
    met = grams.join(often, "gram").join(left, "node")
    # Shingles that no other text holds come before all of these.
    place = F.col("n") - F.count("*").over(in_text) + F.row_number().over(in_text.orderBy("often", "gram"))
    prefix = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1
    met = met.withColumn("place", place).where(F.col("place") <= prefix)
    met = stored(met.select("gram", "node", "n", "label", "place").join(marked, ["node", "n"]), "prefixes")
    other = met.select("gram", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "place", "marks")))
    behind = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    enough = behind + 1 >= (F.col("n") + F.col("n2")) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6
    found = met.join(other, "gram").where(F.expr("label < label2") & enough & _marks_allow("n", "marks", "n2", "marks2"))
    return _pair("node", "n", "node2", "n2", found)


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets in which more than one component meets, with their labels."""
    placed = shared.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return stored(placed.join(open_keys, "key"), "open")


def _between_components(still: DataFrame, turn: int) -> DataFrame:
    """Pairs of one text of each component in a bucket with a text of the bucket's largest
    component; texts are drawn anew each turn. As many pairs as components."""
    drawn = F.xxhash64(F.lit(turn), "node")
    one = still.groupBy("key", "label").agg(F.min(F.struct(drawn.alias("turn"), "node", "n")).alias("one"), F.count("*").alias("size"))
    one = one.select("key", "size", F.xxhash64(F.lit(turn), "label").alias("draw"), "label", "one.node", "one.n")
    first = one.groupBy("key").agg(F.max(F.struct("size", "draw", "label", F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("lead"))
    return _pair("node", "n", "leader", "leader_n", one.join(first.select("key", "lead.leader", "lead.leader_n"), "key"))


def _classes(documents: DataFrame) -> DataFrame:
    """Per row: id, made, class_of (the least id of the class), text_id and n_links."""
    rows = _rows(documents)
    sketched = stored_by_few(rows.mapInArrow(_sketch_rows, "id bigint, made boolean, h1 bigint, h2 int, n int, keys array<bigint>, marks array<bigint>"), "sketches")
    worded = sketched.where("n > 0")
    nodes = worded.groupBy("h1", "h2").agg(F.min("id").alias("node"))
    own = stored(worded.select("id", "made", "h1", "h2").join(nodes, ["h1", "h2"]), "texts")
    first = own.where("id = node").select("node", "h1", "h2").distinct()
    texts = worded.join(first, ["h1", "h2"]).where("id = node")
    marked = stored(texts.select("node", "n", "marks").distinct(), "marks")
    buckets = texts.select("node", "n", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    leader = F.min(F.struct(F.xxhash64("node").alias("turn"), F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("lead")
    leaders = buckets.groupBy("key").agg(leader, F.count("*").alias("size")).where("size > 1").select("key", "lead.leader", "lead.leader_n", "size")
    shared = stored(buckets.join(leaders, "key"), "buckets")
    pairs = stored(_pair("node", "n", "leader", "leader_n", shared), "pairs")
    links = verified(_possible(pairs, marked), rows)
    labels = components(links)

    # Buckets of two are settled; so are those within one component.
    shared = shared.where("size > 2").select("key", "node", "n")
    for turn in range(1, ROUNDS + 1):
        still = _open(shared, labels)
        met = stored(_between_components(still, turn).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if met.isEmpty():
            break
        found = verified(_possible(met, marked), rows)
        pairs = stored(pairs.union(met), "pairs")
        if not found.isEmpty():
            links = stored(links.union(found), "links")
            labels = joined(labels, found)
    left = _open(shared, labels).select("node", "n", "label").distinct()
    more = stored(_by_prefix(stored(left, "open"), rows, marked).join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = verified(more, rows)
    links = links.union(found).select("a", "b").distinct()

    labels = joined(labels, found)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = labels.join(degree, "node").withColumnRenamed("node", "text_node")
    grouped = own.join(classes, F.col("node") == F.col("text_node"), "left").select(
        "id", "made", F.coalesce("label", "node").alias("class_of"), F.col("node").alias("text_id"), "n_links"
    )
    empty = sketched.where("n = 0").select("id", "made", F.col("id").alias("class_of"), F.col("id").alias("text_id"), F.lit(0).alias("n_links"))
    return grouped.union(empty)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, class_id, text_id, n_links.

    Texts are linked if they are equal or their similarity is 0.8 or more; classes are
    the connected components of links. class_id is the least doc_id of the class, text_id
    the least doc_id of the rows with the very same text. n_links is the number of verified
    links found of that text to different texts: to leaders of its buckets, and to left-over
    texts of other components. Links of two texts that are already in one component are
    not looked for, so it is no count of all similar texts. Rows that share an id count as one document.
    Rows without an id take part; their class_id is null if no row of the class has an
    id. Texts without words, and nulls, are equal to nothing: their class_id is their
    own doc_id. Other columns are ignored.
    """
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    found = _classes(documents).withColumnRenamed("class_of", "class_id")
    return found.select(
        F.when(~F.col("made"), F.col("id")).alias("doc_id"), real("class_id"), real("text_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class, the one with the least doc_id, all columns kept.

    Rows of one id are one document: the row of the least code of its text stays. Rows
    without an id are known by their texts, and come after all ids.
    """
    leads = _classes(documents).where("id = class_of").select(F.col("id").alias("lead")).distinct()
    rows = documents.select(_id().alias("id"), F.xxhash64("text").alias("code"), F.struct("*").alias("row"))
    kept = rows.join(leads, F.col("id") == F.col("lead"))
    return kept.groupBy("id").agg(F.min_by("row", F.struct("code", F.xxhash64("row"))).alias("row")).select("row.*")
