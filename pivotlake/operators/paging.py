"""Pages of a sorted view, any of them at the cost of a page.

``limit`` with an offset makes one task hold all rows up to the page. Here the view is
sorted once and kept in its range partitions, with the number of rows in each; a page is
then read from the one or two partitions in which it lies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pivotlake.operators.ordering import POSITION, with_position

_PART, _PLACE = "__part", "__place"
_ROW_BITS = 33


class PageIndex:
    """A sorted view below ``path``: ``rows`` by partition, and ``counts`` of the partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # One row per range partition.
        counts = sorted((r[_PART], r["n"]) for r in spark.read.parquet(f"{self.path}/counts").collect())
        self.parts = [part for part, _ in counts]
        self.starts = [0]
        for _, n in counts:
            self.starts.append(self.starts[-1] + n)
        # The schema is kept apart, because a view without rows has no file to tell it.
        self._stored = spark.read.schema(spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    @property
    def total(self) -> int:
        return self.starts[-1]

    def slice(self, offset: int, size: int) -> DataFrame:
        """``size`` rows from ``offset`` on, in order; fewer at the end."""
        offset, size = max(0, offset), max(0, size)
        end = min(offset + size, self.total)
        shown = [c for c in self._stored.columns if c not in (_PART, _PLACE)]
        if offset >= end:
            return self._stored.where(F.lit(False)).select(*[F.col(f"`{c}`") for c in shown])
        first, last = bisect_right(self.starts, offset) - 1, bisect_right(self.starts, end - 1) - 1
        wanted = None
        for i in range(first, last + 1):
            low, high = max(0, offset - self.starts[i]), end - self.starts[i]
            inside = (F.col(_PART) == self.parts[i]) & F.col(_PLACE).between(low, high - 1)
            wanted = inside if wanted is None else wanted | inside
        found = self._stored.where(F.col(_PART).isin(self.parts[first : last + 1]) & wanted)
        return found.orderBy(_PART, _PLACE).select(*[F.col(f"`{c}`") for c in shown])

    def page(self, number: int, size: int) -> DataFrame:
        """The page ``number``, counted from 0."""
        return self.slice(max(0, number) * size, size)


def page_index(rows: DataFrame, order: Sequence[Column], path: str) -> PageIndex:
    """Sort ``rows`` along ``order`` and keep them below ``path`` for paging.

    Rows equal in ``order`` keep one order for all pages.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    placed = with_position(rows, order)
    part = F.shiftright(POSITION, _ROW_BITS).cast("int").alias(_PART)
    place = F.col(POSITION).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(_PLACE)
    named = [F.col(f"`{c}`") for c in rows.columns]
    stored = placed.select(*named, place, part)
    stored.write.partitionBy(_PART).parquet(f"{path}/rows")
    stored.where(F.lit(False)).coalesce(1).write.parquet(f"{path}/schema")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")
    return PageIndex(spark, path)
