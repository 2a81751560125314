"""Pivot aggregates as mergeable partial states.

The raw rows are aggregated once, by row and column groups, into partial states.
Cells, and the true grand totals, are both finished from those states, so an
``average`` needs no second scan of the raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pivotlake.errors import PivotError
from pivotlake.functions.dates import from_micros, micros
from pivotlake.functions.names import is_date, is_float, is_numeric, present, q
from pivotlake.operators import exact
from pivotlake.spec import AGGREGATIONS, Measure


def state(i: int) -> str:
    return f"__state{i}"


def seen(i: int) -> str:
    return f"__seen{i}"


def check_measure(m: Measure, dtype: T.DataType) -> None:
    if m.aggregation not in AGGREGATIONS:
        raise PivotError(f"unsupported aggregation: {m.aggregation}")
    if m.aggregation == "sum" and not is_numeric(dtype):
        raise PivotError(f"sum needs a numeric field, {m.field} is {dtype.simpleString()}")
    if m.aggregation == "average" and not (is_numeric(dtype) or is_date(dtype)):
        raise PivotError(f"average needs a numeric or date field, {m.field} is {dtype.simpleString()}")


def piece(i: int, k: int) -> str:
    return f"__state{i}_{k}"


@dataclass(frozen=True)
class ExactSum:
    """How a sum that must not depend on order, nor overflow, is held: doubles by ranges of
    their powers of two, whole numbers (``ranges`` is None) as decimals."""

    ranges: exact.Ranges | None


def sums_exactly(m: Measure, dtype: T.DataType) -> bool:
    """Whether a measure adds doubles, or whole numbers that may overflow."""
    return (m.aggregation in ("sum", "average") and is_float(dtype)) or (m.aggregation == "sum" and isinstance(dtype, T.IntegralType))


def exact_plan(df: DataFrame, measures: list[Measure], types: Mapping[str, T.DataType]) -> dict[int, ExactSum]:
    """The plan of each measure that needs one; columns of doubles are read once for it."""
    doubles = [i for i, m in enumerate(measures) if sums_exactly(m, types[m.field]) and is_float(types[m.field])]
    found = exact.ranges(df, [present(q(measures[i].field), types[measures[i].field]).cast("double") for i in doubles]) if doubles else []
    plans = {i: ExactSum(None) for i, m in enumerate(measures) if sums_exactly(m, types[m.field])}
    return plans | {i: ExactSum(r) for i, r in zip(doubles, found, strict=True)}


def _pieces(i: int, of: ExactSum) -> list[str]:
    return [piece(i, k) for k in range(of.ranges.count + 1)]


def partial(i: int, m: Measure, dtype: T.DataType, of: ExactSum | None = None) -> list[Column]:
    """Aggregates over raw rows. Missing values, NaN among them, take no part; whole
    numbers are summed for an average as decimals, which do not overflow."""
    col = present(q(m.field), dtype)
    if of is not None and of.ranges is not None:
        sums = [c.alias(name) for c, name in zip(exact.parts(col.cast("double"), of.ranges), _pieces(i, of), strict=True)]
        return sums + ([F.count(col).alias(seen(i))] if m.aggregation == "average" else [])
    if of is not None:
        return [F.sum(col.cast("decimal(20,0)")).alias(state(i))]
    if m.aggregation == "count":
        return [F.count(col).alias(state(i))]
    if m.aggregation == "sum":
        return [F.sum(col).alias(state(i))]
    if m.aggregation == "average":
        summed = micros(col) if is_date(dtype) else col.cast("decimal(20,0)") if isinstance(dtype, T.IntegralType) else col
        return [F.sum(summed).alias(state(i)), F.count(col).alias(seen(i))]
    fold = F.min if m.aggregation == "min" else F.max
    return [fold(col).alias(state(i))]


def merged(i: int, m: Measure, of: ExactSum | None = None) -> list[Column]:
    """Aggregates over partial states, under the same names."""
    if of is not None and of.ranges is not None:
        return [F.sum(c).alias(c) for c in _pieces(i, of) + ([seen(i)] if m.aggregation == "average" else [])]
    if m.aggregation in ("min", "max"):
        fold = F.min if m.aggregation == "min" else F.max
        return [fold(state(i)).alias(state(i))]
    columns = [F.sum(state(i)).alias(state(i))]
    if m.aggregation == "average":
        columns.append(F.sum(seen(i)).alias(seen(i)))
    return columns


def finished(i: int, m: Measure, dtype: T.DataType, of: ExactSum | None = None) -> Column:
    """The cell value of a state."""
    if of is not None and of.ranges is not None:
        *sums, infinite = [F.col(c) for c in _pieces(i, of)]
        total = exact.rounded(sums, infinite, of.ranges)
        return F.when(F.col(seen(i)) > 0, total / F.col(seen(i))) if m.aggregation == "average" else total
    if of is not None:
        return F.coalesce(F.col(state(i)), F.lit(0)).cast("decimal(38,0)")
    if m.aggregation in ("count", "sum"):
        return F.coalesce(F.col(state(i)), F.lit(0))
    if m.aggregation == "average":
        some = F.col(seen(i)) > 0
        if is_date(dtype):
            return F.when(some, from_micros(F.col(state(i)) / F.col(seen(i))))
        return F.when(some, F.col(state(i)).cast("double") / F.col(seen(i)))
    return F.col(state(i))


def can_be_null(m: Measure) -> bool:
    return m.aggregation in ("average", "min", "max")


def recombined(m: Measure, cell: str, dtype: T.DataType) -> Column:
    """A total over finished cells: sums and counts add, extremes fold, and an
    average becomes the unweighted mean of the cells."""
    if m.aggregation == "average":
        if is_date(dtype):
            return from_micros(F.sum(micros(F.col(cell))) / F.nullif(F.count(cell), F.lit(0)))
        return F.avg(cell)
    if m.aggregation in ("min", "max"):
        fold = F.min if m.aggregation == "min" else F.max
        return fold(cell)
    return F.sum(cell)
