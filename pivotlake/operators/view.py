"""What a grid does with a result frame: search, filter, collapse, page, cap, export."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pivotlake.functions.formats import date_text, number_text
from pivotlake.functions.names import all_of, q
from pivotlake.operators.filters import apply_filters
from pivotlake.operators.ordering import sort_key
from pivotlake.spec import ROW_TOTAL, Display

# Rows of one page of the grid, and of one capped result.
PAGE_SIZES = (20, 50, 100, 200)
RESULT_CAP = 10_000


def visible(df: DataFrame, columns: Sequence[str], hidden: Iterable[str] = ()) -> DataFrame:
    """The visible columns in order."""
    hide = set(hidden)
    return df.select(*[q(c) for c in columns if c not in hide])


def quick_search(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which every word of ``text`` occurs in some visible cell."""
    hay = F.lower(F.concat_ws("\n", *[q(c).cast("string") for c in columns or df.columns]))
    words = [w for w in text.lower().split() if w]
    return df.where(all_of(F.instr(hay, w) > 0 for w in words)) if words else df


def having(df: DataFrame, conditions: Mapping[str, Any]) -> DataFrame:
    """Filter a result by its own columns, with the same forms as row filters."""
    return apply_filters(df, conditions)


def collapse(
    df: DataFrame, collapsed: Iterable[str] | DataFrame, kind: str = "row_kind", parent: str = "parent_key"
) -> DataFrame:
    """Hide the leaf rows of collapsed groups; totals stay. The groups are a list of
    parent keys, or a table with the parent key as its only column."""
    is_leaf = F.col(kind) == "leaf"
    if isinstance(collapsed, DataFrame):
        keys = collapsed.select(q(collapsed.columns[0]).alias("__parent")).distinct()
        return df.join(keys, is_leaf & (F.col(parent) == F.col("__parent")), "left_anti")
    keys = list(collapsed)
    hidden = is_leaf & F.coalesce(F.col(parent).isin(keys), F.lit(False))
    return df.where(~hidden) if keys else df


def collapse_all(df: DataFrame, kind: str = "row_kind", parent: str = "parent_key") -> DataFrame:
    """Hide every leaf row that has a parent group."""
    return df.where(~((F.col(kind) == "leaf") & (F.coalesce(F.col(parent), F.lit("")) != "")))


def ordered(df: DataFrame, sorting: Mapping[str, str], ties: Sequence[str] = ()) -> list[Column]:
    """The sort key of ``sorting``, ties broken ascending by ``ties``."""
    keys = [sort_key(q(c), d) for c, d in sorting.items() if c in df.columns]
    return keys + [sort_key(q(c)) for c in ties if c not in sorting]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of the sorted view."""
    return df.orderBy(*order).offset(number * size).limit(size)


def capped(df: DataFrame, order: Sequence[Column], limit: int = RESULT_CAP) -> DataFrame:
    """The first ``limit`` rows in order, each with the full row count and whether
    rows are missing. Totals are computed before, over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.orderBy(*order)
        .limit(limit)
        .withColumn("total_rows", total)
        .withColumn("truncated", F.col("total_rows") > limit)
    )


def formatted(df: DataFrame, display: Display) -> DataFrame:
    """Replace cells by their formatted text where the display options name a format."""
    out = []
    for f in df.schema.fields:
        col = q(f.name)
        if f.name in display.number_format:
            col = number_text(col, f.dataType, display.number_format[f.name])
        elif f.name in display.date_format:
            col = date_text(col, f.dataType, display.date_format[f.name])
        out.append(col.alias(f.name))
    return df.select(*out)


def export_frame(rows: DataFrame, grand: DataFrame | None, columns: Sequence[str], hidden: Iterable[str] = ()) -> DataFrame:
    """The visible view as text cells with the grand total as the last row.

    ``rows`` is the view after its filter and sort. The grand cell of ``row_total``
    is the sum over the rows shown. ``line`` is 0 for view rows and 1 for the total.
    """
    shown = [c for c in columns if c not in set(hidden)]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = rows.select(F.lit(0).alias("line"), *[text(q(c)).alias(c) for c in shown])
    if grand is None:
        return body
    source = grand
    if ROW_TOTAL in shown:
        total = rows.agg(F.coalesce(F.sum(q(ROW_TOTAL)), F.lit(0)).alias("t")).scalar()
        source = grand.withColumn(ROW_TOTAL, total)
    last = source.select(
        F.lit(1).alias("line"),
        *[(text(q(c)) if c in source.columns else F.lit("")).alias(c) for c in shown],
    )
    return body.unionByName(last)


def tab_separated(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One text line per row: tabs and line breaks inside cells become blanks."""
    cells = []
    for c in columns or df.columns:
        cell = F.regexp_replace(q(c).cast("string"), "\t", " ")
        cells.append(F.coalesce(F.regexp_replace(cell, "\r?\n", " "), F.lit("")))
    return df.select(F.array_join(F.array(*cells), "\t").alias("line"))


def selected_groups(selected: DataFrame, first_field: str | None) -> DataFrame:
    """One row: distinct values of the first row field, a null counting as one;
    without row fields every row is its own group."""
    if first_field is None:
        return selected.agg(F.count(F.lit(1)).alias("groups"))
    col = q(first_field)
    return selected.groupBy(col.alias("g")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("groups"))

