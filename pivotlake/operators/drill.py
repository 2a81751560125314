"""Raw rows behind pivot rows, for one selection or for many in one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pivotlake.errors import PivotError
from pivotlake.functions.names import any_of, is_text, present, q
from pivotlake.operators.filters import (
    any_selection,
    apply_filters,
    group_column,
    resolve_field,
    selected_text,
    selection_condition,
    typed_key,
)
from pivotlake.operators.ordering import sort_key
from pivotlake.session import materialise
from pivotlake.spec import BLANK, HEADER_JOIN, PivotSpec

# Rows of one drill-down window.
DEFAULT_ROWS = 500
MOST_ROWS = 5000

# Selections up to this count are broadcast; each is a handful of group values.
BROADCAST_SELECTIONS = 100_000
# Up to this count they also become a predicate that can skip row groups of the scan.
PUSHED_SELECTIONS = 32
_HITS = "__hits"


@dataclass
class Drilldown:
    """Raw rows and, as a one-row frame, how many rows match before the cap."""

    rows: DataFrame
    matched: DataFrame
    limit: int | None = None

    @property
    def truncated(self) -> DataFrame:
        """One row: whether rows were left out by the cap."""
        return self.matched.select((F.lit(False) if self.limit is None else F.col("matched_rows") > self.limit).alias("truncated"))


def drilldown(
    df: DataFrame,
    spec: PivotSpec,
    selection: Mapping[str, Any],
    order_by: Sequence[str],
    limit: int = DEFAULT_ROWS,
    ceiling: int | None = MOST_ROWS,
) -> Drilldown:
    """The raw rows behind one pivot row, the first ``limit`` along ``order_by``.

    No more than ``ceiling`` rows are given, None being no ceiling; ``truncated`` tells
    whether any were left out.
    """
    limit = max(1, limit if ceiling is None else min(limit, ceiling))
    found = apply_filters(df, spec.filters)
    found = found.where(selection_condition(found, selection, spec.date_grouping))
    return Drilldown(
        found.orderBy(*[sort_key(q(c)) for c in order_by]).limit(limit),
        found.agg(F.count(F.lit(1)).alias("matched_rows")),
        limit,
    )


def selections_of(rows: DataFrame, spec: PivotSpec, headers: Sequence[str] = ()) -> DataFrame:
    """One selection per pivot row: its shown row fields and nothing else.

    Measures, markers and headers with a pipe never are row fields, so they drop out.
    """
    fields = [spec.shown(f) for f in spec.rows]
    leaf = rows.where(F.col("row_kind") == "leaf") if "row_kind" in rows.columns else rows
    kept = [f for f in fields if f in rows.columns and f not in headers and HEADER_JOIN.strip() not in f]
    return leaf.select(*[q(f) for f in kept])


def _null_safe_key(col: Column, dtype: T.DataType) -> Column:
    """Group keys as compared: blank text and null are the same group."""
    return F.nullif(col, F.lit(BLANK)) if is_text(dtype) else present(col, dtype)


def _as_frames(df: DataFrame, selections, spec: PivotSpec) -> list[tuple[list[str], DataFrame]]:
    """(fields, distinct keys with their multiplicity) for each set of fields used."""
    spark = df.sparkSession
    if isinstance(selections, DataFrame):
        named = {resolve_field(df, c, spec.date_grouping): c for c in selections.columns}
        named.pop(None, None)
        if not named:
            return []
        keys, misfits = [], []
        for i, (field, name) in enumerate(named.items()):
            _, dtype = group_column(df, field, spec.date_grouping)
            key = typed_key(q(name), selections.schema[name].dataType, dtype)
            keys.append(_null_safe_key(key.value, dtype).alias(f"__sel{i}"))
            misfits.append(key.misfit.alias(f"__misfit{i}"))
        # The join is null-safe, so what fits no value must be gone before it.
        frame = selections.select(*keys, *misfits)
        frame = frame.where(~any_of(F.col(m) for m in frame.columns[len(keys):])).select(*frame.columns[: len(keys)])
        return [(list(named), frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias(_HITS)))]

    by_fields: dict[tuple[str, ...], list[tuple]] = {}
    for selection in selections:
        entry: dict[str, Any] = {}
        for name, value in selection.items():
            field = resolve_field(df, name, spec.date_grouping)
            if field is not None:
                entry[field] = None if value is None or value == BLANK or value != value else value
        if selection and not entry:
            continue
        fields = tuple(sorted(entry))
        by_fields.setdefault(fields, []).append(tuple(entry[f] for f in fields))
    frames = []
    for fields, entries in by_fields.items():
        if not fields:
            raise PivotError("an empty selection would match every row")
        # The list is a request by a person; its rows travel as text and are cast once.
        schema = T.StructType([T.StructField(f"t{i}", T.StringType()) for i in range(len(fields))])
        types = [group_column(df, f, spec.date_grouping)[1] for f in fields]
        # A value that is none of the column's type must match nothing, not nulls.
        entries = [e for e in entries if all(v is None or selected_text(v, t) is not None for v, t in zip(e, types))]
        texts = [tuple(None if v is None else selected_text(v, t) for v, t in zip(e, types)) for e in entries]
        casts = [
            F.col(f"t{i}").try_cast(t).alias(f"__sel{i}")
            for i, t in enumerate(types)
        ]
        valid = [F.col(f"t{i}").isNull() | c.isNotNull() for i, c in enumerate(casts)]
        made = spark.createDataFrame(texts, schema)
        for ok in valid:
            made = made.where(ok)
        # One partition, so counting repeated selections needs no exchange.
        made = made.select(*casts).coalesce(1)
        frames.append((list(fields), made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias(_HITS))))
    return frames


def _joined(base: DataFrame, fields: Sequence[str], keys: DataFrame, spec: PivotSpec, small: bool, hits: str) -> DataFrame:
    """Left join of the raw rows with the selections of one field set."""
    # The keys are projected first; inside a null-safe join condition each would be
    # computed twice per row.
    given = {}
    for i, field in enumerate(fields):
        col, dtype = group_column(base, field, spec.date_grouping)
        given[f"__key{i}"] = col if field in spec.date_grouping else _null_safe_key(col, dtype)
    base = base.withColumns(given)
    on = None
    for i in range(len(fields)):
        same = F.col(f"__key{i}").eqNullSafe(F.col(f"__sel{i}"))
        on = same if on is None else on & same
    keys = keys.withColumnRenamed(_HITS, hits)
    sel = [*given, *(f"__sel{i}" for i in range(len(fields)))]
    return base.join(F.broadcast(keys) if small else keys, on, "left").drop(*sel)


def matched_hits(
    df: DataFrame, spec: PivotSpec, selections: DataFrame | Sequence[Mapping[str, Any]], hits: str = _HITS
) -> DataFrame:
    """The filtered rows some selection matches, with the number of matches.

    Few selections are broadcast and the table is not shuffled. Many are joined by a
    shuffle; they are distinct, so the rows of a group that holds a third of the table
    can be split over tasks.
    """
    base = apply_filters(df, spec.filters)
    frames = _as_frames(base, selections, spec)
    if not frames:
        return base.where(F.lit(False)).withColumn(hits, F.lit(0).cast("bigint"))
    if not isinstance(selections, DataFrame) and len(selections) <= PUSHED_SELECTIONS:
        base = base.where(any_selection(base, selections, spec.date_grouping))
    if isinstance(selections, DataFrame):
        frames = [(fields, materialise(keys)) for fields, keys in frames]
        small = frames[0][1].count() <= BROADCAST_SELECTIONS
    else:
        small = len(selections) <= BROADCAST_SELECTIONS
    columns = [q(c) for c in base.columns]
    out, total = base, F.lit(0)
    for n, (fields, keys) in enumerate(frames):
        out = _joined(out, fields, keys, spec, small, f"{hits}{n}")
        total = total + F.coalesce(F.col(f"{hits}{n}"), F.lit(0))
    return out.select(*columns, total.alias(hits)).where(F.col(hits) > 0)


def drilldown_many(
    df: DataFrame, spec: PivotSpec, selections: DataFrame | Sequence[Mapping[str, Any]]
) -> Drilldown:
    """The raw rows behind several pivot rows, each distinct row once.

    All selections are answered in one scan. ``matched`` adds the matches of every
    selection, so overlaps and repeated selections count again.
    """
    hit = matched_hits(df, spec, selections)
    return Drilldown(
        hit.select(*[q(c) for c in df.columns]).distinct(),
        hit.agg(F.coalesce(F.sum(_HITS), F.lit(0)).alias("matched_rows")),
    )
