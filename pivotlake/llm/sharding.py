"""Sharding by longest-processing-time scheduling: equal texts stay together, sizes even out.

Groups of equal texts, largest first, go to the shard with the least load, found through a
heap. The heap runs on the driver over a bounded number of items, at any size of the corpus:

- a group of more than 1/bundles of all bytes is an item of its own; there are fewer than
  ``bundles`` of them;
- all other groups are dealt by hash into ``bundles`` bundles, each one item.

The last and smallest items level the loads, so shards differ by about one bundle, unless a
single group is larger than a shard: it must stay together and has a shard to itself.

Sizes of groups are combined before the shuffle, so copies cost nothing. A shard may hold a
large part of the corpus; slots are therefore numbered along a global order by shard, whose
partitions cut through shards, and only counts per partition and shard are brought together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pivotlake.llm.tables import stored
from pivotlake.operators.ordering import POSITION, with_position

BUNDLES_PER_SHARD = 256
ROW_BYTES = 16
_ROW_BITS = 33


def schedule(items: Iterable[tuple], shards: int) -> list[int]:
    """The shard of each (size, ...) item: largest first to the least loaded shard.

    Equal sizes go in the order of the rest of the item, equal loads to the smaller shard.
    """
    items = list(items)
    heap = [(0, shard) for shard in range(shards)]
    placed = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1:])):
        load, shard = heap[0]
        placed[i] = shard
        heapq.heapreplace(heap, (load + items[i][0], shard))
    return placed


def _bundle(code: Column, bundles: int) -> Column:
    return F.pmod(code, F.lit(bundles))


def assignment(rows: DataFrame, shards: int, bundles: int) -> DataFrame:
    """(alone, name, shard): the shard of each large group by its code, and of each bundle.

    ``rows`` has code and size. At most 2 * ``bundles`` rows, which is all that the driver
    ever holds.
    """
    groups = rows.groupBy("code").agg(F.sum("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    alone = F.col("size") > F.lit(total / bundles)
    items = groups.select(alone.alias("alone"), F.when(alone, F.col("code")).otherwise(_bundle(F.col("code"), bundles)).alias("name"), "size")
    found = [(r["size"], r["alone"], r["name"]) for r in items.groupBy("alone", "name").agg(F.sum("size").alias("size")).collect()]
    placed = [(alone, name, shard) for (_, alone, name), shard in zip(found, schedule(found, shards))]
    return rows.sparkSession.createDataFrame(placed, "alone boolean, name bigint, shard int")


def sharded(documents: DataFrame, shards: int = 40, keep: Sequence[str] | None = None, order_by: Sequence[str] = ("doc_id",), bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """Per row of ``documents`` (text, ...): row, size, shard, slot.

    ``row`` holds the columns ``keep``, or all. ``size`` is the number of UTF-8 bytes of the
    text plus 16; a null text is an empty one. ``slot`` counts from 0 within a shard without
    gaps, along ``order_by``, then the text's code; rows equal in these come in any order.
    Rows of equal text share a shard; two texts share one for no reason but their sizes.
    An empty table gives no rows; fewer groups than shards leave shards empty.
    """
    bundles = bundles_per_shard * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [f"`{c}`" for c in (documents.columns if keep is None else keep)]
    rows = documents.select(
        F.struct(*kept).alias("row"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.xxhash64(text).alias("code"),
        F.struct(*(F.col(f"`{c}`") for c in order_by)).alias("order"),
    )
    rows = stored(rows, "sharding")
    placed = assignment(rows, shards, bundles)
    # Bounded by 2 * bundles rows, whatever the corpus.
    alone = F.broadcast(placed.where("alone").select(F.col("name").alias("code"), F.col("shard").alias("own")))
    bundled = F.broadcast(placed.where("NOT alone").select(F.col("name").alias("bundle"), F.col("shard").alias("common")))
    rows = rows.withColumn("bundle", _bundle(F.col("code"), bundles)).join(alone, "code", "left").join(bundled, "bundle", "left")
    rows = rows.select("row", "size", F.coalesce("own", "common").alias("shard"), "order", "code", F.xxhash64(F.monotonically_increasing_id()).alias("any"))
    # The last key only deals rows equal in all others over tasks.
    along = with_position(rows, [F.col(c) for c in ("shard", "order", "code", "any")])
    at = F.shiftright(F.col(POSITION), _ROW_BITS)
    parts = along.groupBy("shard", at.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(POSITION).alias("first"))
    # One row per shard and partition that meet: at most shards + partitions.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("shard").alias("of"), "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = along.join(F.broadcast(parts), (F.col("shard") == F.col("of")) & (at == F.col("part")))
    return numbered.select("row", "size", "shard", (F.col(POSITION) + F.col("shift")).alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Whole rows below ``path``, one folder per shard, with size and slot; files of a
    shard follow each other by slot. Columns of these names in ``documents`` give way."""
    rows = sharded(documents, shards, **options)
    own = [f"row.`{c}`" for c in rows.schema["row"].dataType.names if c not in ("size", "shard", "slot")]
    rows.select(*own, "size", "shard", "slot").write.partitionBy("shard").parquet(path)
