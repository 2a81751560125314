"""Sort keys, and positions in a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pivotlake.session import materialise

POSITION = "__position"
_BLOCK = "__block"
_CARRY = "__carry"
# monotonically_increasing_id keeps the partition number above its lower 33 bits.
_ROW_BITS = 33


def sort_key(col: Column, direction: str = "asc") -> Column:
    return col.desc_nulls_last() if direction.lower() in ("desc", "descending") else col.asc_nulls_last()


def with_position(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of ``df`` along ``order``.

    The global sort range-partitions the rows, so a row's partition number and its
    place inside the partition give an increasing position. The result is
    checkpointed: positions stay the same however often they are read.
    """
    return materialise(df.orderBy(*order).withColumn(POSITION, F.monotonically_increasing_id()))


def forward_fill(positioned: DataFrame, fills: dict[str, Column], skip: Column | None = None) -> DataFrame:
    """Give blank cells the last non-blank value above them.

    ``fills`` maps a column to its value with blanks as null. Rows where ``skip``
    holds neither give nor take. Each block of the global order is filled on its
    own; only one carried value per block crosses blocks.
    """
    blocked = positioned.withColumn(_BLOCK, F.shiftright(F.col(POSITION), _ROW_BITS))
    values = {
        name: value if skip is None else F.when(~skip, value) for name, value in fills.items()
    }
    last_of_block = blocked.groupBy(_BLOCK).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(POSITION))).alias(n) for n, v in values.items()]
    )
    # One row per partition of the sorted frame, so this window is bounded.
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_block.select(
        _BLOCK, *[F.last(F.col(n), ignorenulls=True).over(before).alias(_CARRY + n) for n in fills]
    )
    inside = Window.partitionBy(_BLOCK).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(
        "*", *[F.last(v, ignorenulls=True).over(inside).alias("__local" + n) for n, v in values.items()]
    ).join(F.broadcast(carried), _BLOCK, "left")
    out = []
    for name in positioned.columns:
        if name in fills:
            above = F.coalesce(F.col("__local" + name), F.col(_CARRY + name), F.col(name))
            out.append((above if skip is None else F.when(skip, F.col(name)).otherwise(above)).alias(name))
        else:
            out.append(F.col(name))
    return local.select(*out)
