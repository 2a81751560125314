"""Conversation prefix trie with count-min screening of prefix digests.

Every prefix of a conversation gets a digest, chained turn by turn. Two conversations share
a trie node exactly if they share a digest. Most prefixes belong to one conversation only,
so grouping all of them would shuffle the corpus for nothing:

1. A count-min sketch counts all prefix digests. It never counts too little, so an estimate
   of one proves a singleton; and what continues a singleton is a singleton.
2. Below a proven singleton, nodes are emitted where their rows are read.
3. Only prefixes whose parent may be shared are shuffled and grouped exactly. Prefixes that
   the sketch suspects wrongly come out of that grouping as what they are.

Every node belongs to its smallest member. In depth order a conversation owns nothing, then
everything: the trie is a set of paths, one per conversation. Sums over a subtree are
therefore sums over members: a member adds the leaf it owns, and the savings of the nodes
it owns from the depth in question on. No round per depth is needed.

The sketch has four rows of cells, as many as needed for a quarter of load but at most
``MOST_CELLS``: beyond that more prefixes are suspected and shuffled, and results stay the
same. Tasks send the cells they hit; merged, one bit a cell tells "exactly one", at most 16 MB
for all tasks. Hot prefixes are counted before the shuffle, and their rows get the counts
without one. Ids of conversations
that end in one node are joined in slices of bounded size and hashed along them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pivotlake.llm.mixing import sizes
from pivotlake.llm.tables import rows_of, stored

ROOT = bytes(16)
SKETCH_ROWS = 4
MOST_CELLS = 1 << 25
BLOCK_BITS = 16
SLICE = 4096
HOT = 1024
_OUT_ROWS = 8192

_PREFIXES = "conv_id bigint, depth bigint, code binary, parent binary, words bigint, last boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("code", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])


# Prefixes ---------------------------------------------------------------------------------


def heads(conv_id: Column, most: int) -> Column:
    """How many turns a conversation takes over: unsigned crc32 of its decimal id, modulo ``most``."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % most, F.lit(0)).cast("int")


def prefixes(conversations: DataFrame, family: int | None = None, most: int = 4) -> DataFrame:
    """One row per prefix of every conversation: conv_id, depth, code, parent, words, last.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by turn, nulls
    first, then role and the digest of the turn; repeated rows are repeated turns; a null
    role or text is empty. Rows without conv_id make up one conversation without an id.
    Further columns are not looked at. Depth 0 is the root.

    With ``family`` a conversation c takes over the first :func:`heads` turns of
    conversation c - c % family, as many as that has, in place of as many of its own.

    Turns are reduced to digest and word count before they are shuffled. A family is read
    as a stream, one turn at a time, so a conversation need not fit into memory; its chain
    of digests is made by one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = sizes(conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")))
    of = F.col("conv_id") if family is None else F.col("conv_id") - F.col("conv_id") % family
    told = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = turns.select(
        of.alias("family"),
        (F.coalesce(F.col("conv_id") != of, F.lit(False))).alias("guest"),
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5(told.cast("binary"))).alias("turn_code"),
        F.col("size").alias("words"),
        (F.lit(0) if family is None else heads(F.col("conv_id"), most)).alias("head"),
    )
    # The lender of a family comes first.
    sorted_turns = turns.repartition("family").sortWithinPartitions("family", "guest", "conv_id", F.col("turn").asc_nulls_first(), "role", "turn_code")
    return sorted_turns.select("family", "guest", "conv_id", "turn_code", "words", "head").mapInArrow(lambda batches: _chained(batches, most), _PREFIXES)


def _chained(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    out = []

    def step(turn):
        """One more turn of the conversation at hand; the prefix before it is not the last."""
        out.append([*now[:5], False])
        now[1], now[3], now[2], now[4] = now[1] + 1, now[2], hashlib.md5(now[2] + turn[0]).digest(), turn[1]

    now = at = lent_by = None
    lent: list[tuple[bytes, int]] = []
    for batch in batches:
        for family, guest, conv, code, words, head in rows_of(batch, _OUT_ROWS):
            if at != (family, conv):
                if now:
                    out.append([*now, True])
                at, own, now = (family, conv), 0, [conv, 0, ROOT, None, 0]
                if lent_by != (family,):
                    lent_by, lent = (family,), []
                if guest:
                    for turn in lent[:head]:
                        step(turn)
            if not guest and own < most - 1:
                lent.append((code, words))
            own += 1
            if not guest or own > head:
                step((code, words))
            if len(out) >= _OUT_ROWS:
                yield _batch(out)
                out.clear()
    if now:
        out.append([*now, True])
    if out:
        yield _batch(out)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


# Screening --------------------------------------------------------------------------------


def _cells(codes: pa.Array, cells: int) -> np.ndarray:
    """The cell of every digest in every row of the sketch; digests are 16 bytes each."""
    raw = b"".join(codes.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(-1, SKETCH_ROWS) & np.uint32(cells - 1)


def _add(counts: np.ndarray, cells: np.ndarray, times: np.ndarray) -> None:
    """Counts beyond two say no more than two."""
    counts[cells] = np.minimum(counts[cells].astype(np.int64) + times, 2)


def cells_for(n: int, most_cells: int = MOST_CELLS) -> int:
    return int(min(most_cells, 1 << max(BLOCK_BITS, (4 * n).bit_length())))


def sketch(prefix_rows: DataFrame, cells: int) -> list[np.ndarray]:
    """For each row of the sketch, one bit per cell: whether exactly one prefix fell into it."""
    block = min(cells, 1 << BLOCK_BITS)

    def hits(batches):
        counts = np.zeros((SKETCH_ROWS, cells), np.uint8)
        for batch in batches:
            at = _cells(batch.column(0), cells)
            for r in range(SKETCH_ROWS):
                _add(counts[r], *np.unique(at[:, r], return_counts=True))
        for r in range(SKETCH_ROWS):
            for b in range(cells // block):
                part = counts[r, b * block : (b + 1) * block]
                hit = np.flatnonzero(part).astype(np.uint16)
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([r * (cells // block) + b], pa.int32()), "cells": [hit.tobytes()], "times": [part[hit].tobytes()]})

    def merge(batches):
        counts, at = np.zeros(block, np.uint8), None
        done = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "bits": [np.packbits(counts == 1).tobytes()]})
        for batch in batches:
            for name, where, times in rows_of(batch):
                if name != at:
                    if at is not None:
                        yield done()
                    at, counts = name, np.zeros(block, np.uint8)
                _add(counts, np.frombuffer(where, np.uint16), np.frombuffer(times, np.uint8))
        if at is not None:
            yield done()

    found = prefix_rows.select("code").mapInArrow(hits, "block int, cells binary, times binary")
    merged = found.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits = np.zeros((SKETCH_ROWS * (cells // block), block // 8), np.uint8)
    for name, part in merged.collect():
        bits[name] = np.frombuffer(part, np.uint8)
    return list(bits.reshape(SKETCH_ROWS, cells // 8))


def _screened(prefix_rows: DataFrame, ones: list[np.ndarray], cells: int) -> DataFrame:
    """With alone and parent_alone: whether the sketch proves the prefix, or the one before
    it, to be a singleton. The root has no parent that could prove anything."""
    shared = prefix_rows.sparkSession.sparkContext.broadcast(ones)

    def proven(codes: pa.Array) -> np.ndarray:
        at = _cells(codes, cells)
        out = np.zeros(len(at), bool)
        for r, bits in enumerate(shared.value):
            out |= (bits[at[:, r] >> 3] >> (7 - (at[:, r] & 7)).astype(np.uint8)) & 1 == 1
        return out

    def screen(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            root = np.asarray(batch.column("parent").is_null())
            alone = proven(batch.column("code"))
            above = proven(batch.column("parent").fill_null(ROOT)) & ~root
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above)], names=[*batch.schema.names, "alone", "parent_alone"])

    return prefix_rows.mapInArrow(screen, f"{_PREFIXES}, alone boolean, parent_alone boolean")


# Nodes ------------------------------------------------------------------------------------


def _id_hash(ids: Column) -> Column:
    return F.sha2(F.coalesce(ids, F.lit("")).cast("binary"), 256)


def ends(rows: DataFrame) -> DataFrame:
    """(code, ends_sha256) of all codes in ``rows`` (code, conv_id): the ids in ascending order.

    A slice holds at most ``SLICE`` ids; slices of a code are hashed one after another.
    """
    by_slice = rows.where("conv_id IS NOT NULL").groupBy("code", F.floor(F.col("conv_id") / SLICE).alias("slice"))
    texts = by_slice.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    along = texts.repartition("code").sortWithinPartitions("code", "slice").select("code", "ids")

    def hashed(batches):
        at = digest = None
        done = lambda: pa.RecordBatch.from_pydict({"code": pa.array([at], pa.binary()), "ends_sha256": [digest.hexdigest()]})
        for batch in batches:
            for code, ids in rows_of(batch):
                if code != at:
                    if at is not None:
                        yield done()
                    at, digest = code, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at is not None:
            yield done()

    return along.mapInArrow(hashed, "code binary, ends_sha256 string")


def _with_counts(suspects: DataFrame, counted: DataFrame) -> DataFrame:
    """Every row with the counts of its prefix. Rows of prefixes that hold more than
    1/``HOT`` of all rows, which are fewer than ``HOT`` prefixes, stay where they are; the
    others are shuffled, and no prefix among them is a large part of the shuffle."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > F.lit(total)
    hot = F.broadcast(counted.where(is_hot))
    cold = suspects.join(hot, "code", "left_anti").join(counted.where(~is_hot), "code")
    return suspects.join(hot, "code").unionByName(cold)


def nodes(prefix_rows: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per trie node: code, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``prefix_rows`` are :func:`prefixes`. conv_id is the smallest member, so the text of a
    node is turn ``depth`` of that conversation; parent_conv_id that of the parent, null for
    the root. n_leaves counts childless nodes of the subtree, top included; saved_tokens
    adds (n_convs - 1) times the words of each of its nodes' last turn; ends_sha256 is the
    hash of the ascending, comma-joined ids that end here. A conversation without an id is a
    member, but gives no id to any of these. Conversations without turns end in the root. No
    conversations, no nodes.
    """
    given = stored(prefix_rows, "prefixes")
    cells = cells_for(given.count(), most_cells)
    rows = stored(_screened(given, sketch(given, cells), cells), "screened")
    no_children, one_end = F.when(F.col("last"), 0).otherwise(1).cast("bigint"), F.when(F.col("last"), _id_hash(F.col("conv_id").cast("string"))).otherwise(_id_hash(F.lit("")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    single = [one.alias("n_convs"), no_children.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), one_end.alias("ends_sha256")]
    tails = rows.where("parent_alone").select("code", "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single)

    suspects = rows.where("NOT parent_alone AND NOT alone").select("conv_id", "depth", "code", "words", "last")
    counted = suspects.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if("last").alias("ending"))
    shared = _with_counts(suspects, stored(counted, "counted")).withColumn("suspect", F.lit(True))
    tops = rows.where("NOT parent_alone AND alone").select("code", "conv_id", "depth", "words", "last", one.alias("n"), F.col("conv_id").alias("least"), F.col("last").cast("bigint").alias("ending"), F.lit(False).alias("suspect"))
    both = shared.select(*tops.columns).unionByName(tops).withColumn("own", F.col("conv_id").eqNullSafe(F.col("least")))

    # Along a conversation from its deepest prefix here upwards.
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spared = F.when(F.col("own"), (F.col("n") - 1) * F.col("words")).otherwise(0)
    # What goes on below this stage is a tail, which ends in a leaf of its own.
    leaf = F.when(F.col("last"), F.col("own") & (F.col("n") == F.col("ending"))).otherwise(True)
    above = F.when(F.lead("depth").over(up) == F.col("depth") - 1, F.lead("least").over(up)).otherwise(F.col("conv_id"))
    paths = both.select(
        "*",
        F.sum(spared).over(so_far).alias("spared"),
        F.first(leaf).over(so_far).cast("bigint").alias("leaf"),
        F.coalesce(F.lag(F.col("own").cast("bigint")).over(up), F.lit(0)).alias("child"),
        F.when(F.col("depth") > 0, above).alias("above"),
    )
    paths = stored(paths, "paths")
    tops = paths.where("NOT suspect").select("code", "conv_id", "depth", F.col("above").alias("parent_conv_id"), *single)
    grouped = paths.where("suspect").groupBy("code").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.max(F.when(F.col("own"), F.col("above"))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("spared").alias("saved_tokens"),
    )
    ended = ends(paths.where("suspect AND last").select("code", "conv_id"))
    grouped = grouped.join(ended, "code", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", _id_hash(F.lit(""))))
    return tails.unionByName(tops).unionByName(grouped)
