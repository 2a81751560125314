"""Removing repeated passages by seed and extend.

Seeds: every run of ``SEED`` words has a code; of the seeds inside a window of
``WINDOW`` words the least is its anchor (winnowing). Equal windows have equal anchors,
and neighbouring windows mostly share one, so about one word in eight is an anchor and
each window belongs to exactly one.

Join and extend: occurrences of an anchor are brought together by a sort on anchor,
extension and place. The extension is the code of all words that the anchor's windows
reach to its left and right. Occurrences that agree in it agree in all their windows:
all but the first are repeats, and nothing more has to be compared. The first
occurrences of unequal extensions ("contested", such as those at the edges of a repeated
passage) are extended step by step: each of their windows becomes a row, and the
earliest place of each window is kept by a combining aggregate. No pairs are made, so a
passage shared by a third of all documents costs as much as its words.

The sort spreads a hot anchor over several tasks, because the place is part of its key.
A task cannot know whether its first and last anchors go on in other tasks; it treats
them as contested, which is always right. Windows that repeat are put together to
maximal repeats of at least ``WINDOW`` words.

A window is known by two independent 64-bit codes, of its anchor and of all its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pivotlake.llm.tables import stored, utf8
from pivotlake.llm.words import WordCodes, gram_codes, mixed

WINDOW = 20
SEED = 6
# Stands for a null id inside; null ids come before all others.
NO_ID = -(1 << 63)
CODE_BITS, LENGTH_BITS = 24, 4

_RUNS = pa.schema([("anchor", pa.int64()), ("extension", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
_JUDGED = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("repeat", pa.bool_())])
_WINDOWS = pa.schema([("anchor", pa.int64()), ("words", pa.int64()), ("id", pa.int64()), ("code", pa.int32()), ("start", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _anchored(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window: the code of its anchor's words, of its own words, and the anchor's place."""
    seeds = mixed(gram_codes(codes, SEED))
    windows = mixed(gram_codes(codes, WINDOW))
    reach = WINDOW - SEED + 1
    at = np.lib.stride_tricks.sliding_window_view(seeds, reach).argmin(axis=1) + np.arange(len(windows))
    return seeds, windows, at


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


def _documents(documents: DataFrame) -> DataFrame:
    """id, code and text of each row; the code tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code"),
        utf8().alias("text"),
    )


def _find_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one anchor; place holds start, length - 1 and the row's code."""
    known = WordCodes()
    for batch in batches:
        out = [[], [], [], []]
        for doc, code, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.split()
            if len(words) < WINDOW:
                continue
            seeds, windows, at = _anchored(known.of(words))
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            stop = np.append(start[1:], len(at))
            length = (stop - start - 1).astype(np.uint64)
            out[0].append(seeds[at[start]])
            out[1].append(mixed(windows[start] * np.uint64(0xD6E8FEB86659FD93) + windows[stop - 1] + length))
            out[2].append(np.full(len(start), doc, np.int64))
            out[3].append(start.astype(np.uint64) << np.uint64(CODE_BITS + LENGTH_BITS) | length << np.uint64(CODE_BITS) | np.uint64(code))
        if out[0]:
            anchor, extension, doc, place = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(anchor)), pa.array(_signed(extension)), pa.array(doc), pa.array(_signed(place))], schema=_RUNS)


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as repeats (True) or contested ones (False); runs that occur once are left out.

    Carried over from batch to batch: the first run of the anchor at hand and the first
    run of the extension at hand, with whether they have been put out yet.
    """
    carried = np.empty((4, 0), np.int64)
    done = np.empty(0, bool)
    first_anchor = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        rows = np.concatenate([carried, rows], axis=1)
        old = np.arange(rows.shape[1]) < len(done)
        put_out = np.concatenate([done, np.zeros(rows.shape[1] - len(done), bool)])
        anchor, extension, doc, place = rows
        if first_anchor is None:
            first_anchor = anchor[0]
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], extension[1:] != extension[:-1]])
        index = np.arange(len(anchor))
        first = np.maximum.accumulate(np.where(new, index, 0))
        start = place >> (CODE_BITS + LENGTH_BITS)
        later = (doc != doc[first]) | (start != start[first])
        group = np.cumsum(new_anchor) - 1
        several = (np.bincount(group[new], minlength=group[-1] + 1) > 1)[group] | (anchor == first_anchor)
        repeat = ~new & later & ~old
        # A run at the very place of the first, from another row of the same id.
        twin = ~new & ~later & ~old & (place != place[first])
        contested = (new & several & ~put_out) | twin
        chosen = repeat | contested
        if chosen.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[chosen]), pa.array(place[chosen]), pa.array(repeat[chosen])], schema=_JUDGED)
        keep = np.unique([index[new_anchor][-1], first[-1]])
        carried, done = rows[:, keep], (put_out | contested)[keep]
    if carried.shape[1] and not done[0]:
        yield pa.RecordBatch.from_arrays([pa.array(carried[2, :1]), pa.array(carried[3, :1]), pa.array([False])], schema=_JUDGED)


def _take_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of contested runs."""
    known = WordCodes()
    for batch in batches:
        out = [[], [], [], [], []]
        for doc, code, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seeds, windows, at = _anchored(known.of(text.split()))
            for place in places:
                start = place >> (CODE_BITS + LENGTH_BITS)
                stop = start + (place >> CODE_BITS) % (1 << LENGTH_BITS) + 1
                out[0].append(_signed(seeds[at[start:stop]]))
                out[1].append(_signed(windows[start:stop]))
                out[2].append(np.full(stop - start, doc, np.int64))
                out[3].append(np.full(stop - start, code, np.int32))
                out[4].append(np.arange(start, stop))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_WINDOWS)


def repeated_windows(documents: DataFrame) -> DataFrame:
    """Runs of windows that also start earlier: id, code, start, n (windows in the run)."""
    rows = _documents(documents)
    key = ["anchor", "extension", "id", "place"]
    runs = rows.mapInArrow(_find_runs, _ddl(_RUNS)).repartitionByRange(*key).sortWithinPartitions(*key)
    judged = stored(runs.mapInArrow(_judge, _ddl(_JUDGED)), "runs")
    code = F.col("place").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code")
    contested = judged.where(~F.col("repeat")).groupBy("id", code).agg(F.collect_set("place").alias("places"))
    windows = stored(
        rows.join(contested, ["id", "code"]).select("id", "code", "text", "places").mapInArrow(_take_apart, _ddl(_WINDOWS)), "windows"
    )
    at = F.struct("id", "start")
    earliest = windows.groupBy("anchor", "words").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").drop("last")
    single = windows.join(earliest, ["anchor", "words"]).where(at > F.col("first")).select("id", "code", "start", F.lit(1).alias("n"))
    whole = judged.where("repeat").select(
        "id",
        code,
        F.shiftright("place", CODE_BITS + LENGTH_BITS).alias("start"),
        (F.shiftright("place", CODE_BITS).bitwiseAND((1 << LENGTH_BITS) - 1) + 1).cast("int").alias("n"),
    )
    return whole.union(single)


_KEPT = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, n_removed bigint, kept string"
_KEPT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
    ]
)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, starts, ns = (c.to_pylist() for c in batch.columns)
        out = {name: [] for name in _KEPT_ARROW.names}
        for doc, text, start, n in zip(docs, texts, starts, ns, strict=True):
            words = text.split()
            spans, removed, kept = [], 0, words
            if start:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.array(start), 1)
                np.add.at(edge, np.array(start) + np.array(n) + WINDOW - 1, -1)
                inside = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
                spans = [{"start": a, "stop": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
                removed = int(inside.sum())
                ends = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(words)]
                kept = [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
            row = (None if doc == NO_ID else doc, len(words), spans, removed, b" ".join(kept).decode())
            for name, value in zip(_KEPT_ARROW.names, row, strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_KEPT_ARROW)


def without_repeats(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) without the words of repeated windows.

    Columns: doc_id, n_words, spans (maximal repeats as word ranges), n_removed, kept
    (the other words, joined by one space). Words are what ASCII white space separates.
    A window is a repeat if its words also start earlier: in a smaller doc_id, or before
    in the same document. Null ids are the smallest; rows of one id are one document, so
    equal places in them are not earlier than one another. Null and empty texts have no
    words. Windows are judged on the input. Other columns are ignored.
    """
    found = repeated_windows(documents).groupBy("id", "code").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    rows = _documents(documents).join(found, ["id", "code"], "left")
    return rows.select("id", "text", "starts", "ns").mapInArrow(_cut, _KEPT)
