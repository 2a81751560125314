"""Compile a pivot definition into lazy DataFrames.

raw rows -> filters -> one grouped scan into partial states ("long")
         -> column keys, cells, totals over cells, true grand totals, counts

Only the distinct column keys reach the driver, and their number is bounded.
Internal column names (``__row0``, ``__cell3``) keep user names with dots, pipes or
blanks out of every step; the last projection gives the shown names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pivotlake.errors import PivotError
from pivotlake.functions.dates import as_timestamp, code, from_micros, label, micros
from pivotlake.functions.names import all_of, any_of, is_date, is_numeric, is_text, present, q, quoted
from pivotlake.operators import measures as ms
from pivotlake.operators.filters import apply_filters, filter_condition
from pivotlake.operators.ordering import POSITION, forward_fill, sort_key, with_position
from pivotlake.plans.checks import require_valid
from pivotlake.session import can_materialise, materialise
from pivotlake.spec import (
    BLANK,
    COLUMN_TOTAL,
    COMPACT_COLUMN,
    HEADER_JOIN,
    LABEL_JOIN,
    PARENT_JOIN,
    ROW_TOTAL,
    Measure,
    PivotSpec,
)

# A wide frame needs one column per key; beyond this a pivot is refused, not cut. It is
# the default of a parameter.
MAX_PIVOT_COLUMNS = 2_000

LEAF, SUBTOTAL, TOTAL = "leaf", "subtotal", "column_total"
ROW_KIND, LEVEL, PARENT = "row_kind", "level", "parent_key"

# The order of several aggregations of one field in a result.
_FUNCTION_ORDER = ("count", "max", "average", "min", "sum")

_ROWS_SEEN = "__rows_seen"
_INSIDE = "__inside"
_NUMBER = "__number"
# The present cells of a row group, by number; and the number of the marker before them.
_HELD = "__held"
_MARKER = -1


@dataclass(frozen=True)
class Cell:
    """One value column of the result; ``name`` is the column, or place in a column, of
    the compiled frame that holds its values."""

    name: str
    header: str
    measure: Measure
    dtype: T.DataType


@dataclass
class PivotResult:
    """The lazy pieces of one computed pivot."""

    spec: PivotSpec
    source: DataFrame
    long: DataFrame
    measures: list[Measure]
    types: dict[str, T.DataType]
    cells: list[Cell]
    row_types: list[T.DataType]
    frame: DataFrame = field(repr=False)
    ordered: bool = True
    markers: bool = False
    source_rows: DataFrame | None = None
    exact: dict[int, ms.ExactSum] = field(default_factory=dict)

    @property
    def row_fields(self) -> list[str]:
        """The group columns as shown: the fields, or one column in compact layout."""
        if _is_compact(self.spec):
            return [COMPACT_COLUMN]
        return [self.spec.shown(f) for f in self.spec.rows]

    @property
    def has_row_total(self) -> bool:
        return _has_row_total(self.spec, self.measures, self.cells)

    @property
    def columns(self) -> list[str]:
        """The visible columns, in order."""
        label = ["measure"] if self.spec.columns and not self.spec.rows else []
        headers = list(dict.fromkeys(c.header for c in self.cells))
        return self.row_fields + label + headers + ([ROW_TOTAL] if self.has_row_total else [])

    @property
    def aggregations(self) -> list[dict[str, str]]:
        return [{"field": m.field, "aggregation": m.aggregation, "label": m.name} for m in self.measures]

    @cached_property
    def rows(self) -> DataFrame:
        """Leaf rows, subtotals and the column total, in display order."""
        return _shown_rows(self)

    @cached_property
    def grand(self) -> DataFrame:
        """One row: every measure over all filtered raw rows, null when switched off."""
        totals = self.long.agg(*[c for i, m in enumerate(self.measures) for c in ms.merged(i, m, self.exact.get(i))])
        return totals.select(
            *[
                (
                    ms.finished(i, m, self.types[m.field], self.exact.get(i))
                    if self.spec.totals.grand
                    else F.lit(None).cast(_finished_type(m, self.types[m.field]))
                ).alias(m.name)
                for i, m in enumerate(self.measures)
            ]
        )

    @cached_property
    def counts(self) -> DataFrame:
        """One row: rows before filters, rows after filters, leaf rows of the result."""
        # One pass over the grouped states; without filters it counts the source as well.
        groups = [F.col(f"__row{i}") for i in range(len(self.spec.rows))]
        kept = F.bool_or(_some_value(self.measures))
        seen = self.long.groupBy(*groups).agg(F.sum(_ROWS_SEEN).alias("n"), kept.alias("kept"))
        filtered = F.coalesce(F.sum("n"), F.lit(0))
        if self.spec.rows:
            shown = F.count_if("kept")
        elif self.spec.columns:
            shown = F.when(F.coalesce(F.bool_or("kept"), F.lit(False)), len(self.measures)).otherwise(0).cast("bigint")
        else:
            shown = F.lit(1).cast("bigint")
        counted = seen.agg(filtered.alias("filtered_rows"), shown.alias("result_rows"))
        source = F.col("filtered_rows")
        if self.spec.filters:
            counted_source = self.source_rows if self.source_rows is not None else self.source.agg(F.count(F.lit(1)).alias("n"))
            source = counted_source.scalar()
        return counted.select(source.alias("source_rows"), "filtered_rows", "result_rows")

    @cached_property
    def statistics(self) -> DataFrame:
        """One row: the counts with the settings they were computed under."""
        grouped = ", ".join(f"{f}: {g}" for f, g in self.spec.date_grouping.items())
        used = ", ".join(f"{m.aggregation}({m.field})" for m in self.measures)
        return self.counts.select(
            "*",
            F.lit(self.spec.layout).alias("layout"),
            F.lit(grouped).alias("date_grouping"),
            F.lit(used).alias("aggregations"),
        )


def pivot(
    df: DataFrame,
    spec: PivotSpec,
    *,
    ordered: bool = True,
    markers: bool = False,
    reuse: bool | None = None,
    max_cells: int | None = None,
    max_columns: int = MAX_PIVOT_COLUMNS,
    count_source: bool = False,
    exact_sums: bool = False,
) -> PivotResult:
    """Compile ``spec`` over ``df``.

    ``reuse`` checkpoints the grouped states so that the raw rows are scanned once
    for all results; by default that is done when the column keys have to be read
    first. ``count_source`` lets the rows before filters be counted by the same scan: the
    others then go along as one marked group, so the filters no longer skip parts of the
    files; without it ``counts`` of a filtered pivot counts the source in a scan of its own,
    which reads no column. With ``exact_sums`` cells and grand totals that add doubles are
    the exact sum, rounded once, whatever the order of the rows, and sums of whole numbers are
    decimals of 38 digits; the columns are read once before, for the range of their values.
    Totals over cells add the cells as shown. ``max_cells`` refuses pivots with more estimated cells, ``max_columns`` those
    with more column groups. ``markers`` adds the row kind, level and parent key to the
    rows.
    """
    require_valid(df, spec)
    measures = spec.measures(df.columns[0])
    types = {m.field: df.schema[m.field].dataType for m in measures}
    marked = [_INSIDE] if count_source and spec.filters else []
    base = _marked(df, spec, measures) if marked else apply_filters(df, spec.filters)

    exact = ms.exact_plan(base, measures, types) if exact_sums else {}
    row_keys, row_labels, row_types = _group_keys(base, spec, spec.rows, "__row")
    col_keys, col_labels, _ = _group_keys(base, spec, spec.columns, "__col")
    grouped = base.groupBy(*row_keys, *col_keys, *marked).agg(
        F.count(F.lit(1)).alias(_ROWS_SEEN),
        *[c for i, m in enumerate(measures) for c in ms.partial(i, m, types[m.field], exact.get(i))],
    )
    states = grouped.columns[len(row_keys) + len(col_keys) + len(marked):]
    long = grouped.where(F.col(_ROWS_SEEN) > 0).select(*row_labels, *col_labels, *states, *marked)

    if reuse is None:
        reuse = bool(spec.columns or marked) and can_materialise(df.sparkSession)
    if reuse:
        long = materialise(long)
    source_rows = None
    if marked:
        source_rows = long.agg(F.coalesce(F.sum(_ROWS_SEEN), F.lit(0)).alias("n"))
        long = long.where(_INSIDE).drop(_INSIDE)
    if max_cells is not None:
        _check_cells(long, spec, measures, max_cells)

    ordered_measures = measures
    if spec.rows or spec.columns:
        ordered_measures = sorted(measures, key=lambda m: (m.field, _FUNCTION_ORDER.index(m.aggregation)))
    kept = _drop_empty_groups(long, measures)
    values = kept.select(
        *[f"__row{i}" for i in range(len(spec.rows))],
        *[f"__col{i}" for i in range(len(spec.columns))],
        *[
            ms.finished(measures.index(m), m, types[m.field], exact.get(measures.index(m))).alias(f"__value{j}")
            for j, m in enumerate(ordered_measures)
        ],
    )
    if not spec.columns:
        leaf, cells = _narrow(values, spec, ordered_measures)
        frame = _with_totals(leaf, spec, cells)
    elif spec.rows:
        frame, cells = _widen(values, spec, ordered_measures, max_columns)
    else:
        leaf, cells = _widen_measures(values, spec, ordered_measures, max_columns)
        frame = _with_row_total(leaf.withColumn(ROW_KIND, F.lit(LEAF)), spec, measures, cells)
    return PivotResult(spec, df, long, measures, types, cells, row_types, frame, ordered, markers, source_rows, exact)


def _marked(df: DataFrame, spec: PivotSpec, measures: list[Measure]) -> DataFrame:
    """The used columns with whether the filters keep the row; rows they drop are empty."""
    used = list(dict.fromkeys([*spec.rows, *spec.columns, *(m.field for m in measures)]))
    inside = df.withColumn(_INSIDE, F.coalesce(filter_condition(df, spec.filters), F.lit(False)))
    return inside.select(*[F.when(F.col(_INSIDE), q(c)).alias(c) for c in used], _INSIDE)


def pivot_cells(result: PivotResult) -> DataFrame:
    """One row: distinct row groups, column groups, value fields and their product."""
    spec = result.spec
    return _cell_estimate(result.long, spec, result.measures)


# Grouping -----------------------------------------------------------------------


def _group_keys(df, spec, fields, prefix) -> tuple[list[Column], list[Column], list[T.DataType]]:
    """Group expressions over raw rows, the labels made of them afterwards, and types.

    Date buckets are grouped as numbers and become text once per group. Null text
    becomes the blank label; other keys stay null unless the definition asks for text.
    """
    keys, labels, types = [], [], []
    for i, name in enumerate(fields):
        key = f"{prefix}{i}"
        dtype = df.schema[name].dataType
        grain = spec.date_grouping.get(name)
        if grain:
            keys.append(code(as_timestamp(q(name), dtype), grain).alias(key))
            labels.append(F.coalesce(label(F.col(key), grain), F.lit(BLANK)).alias(key))
            types.append(T.StringType())
            continue
        as_text = is_text(dtype) or spec.blank_as_text
        if is_text(dtype):
            # Before grouping: a null and the literal label are one group.
            keys.append(F.coalesce(q(name), F.lit(BLANK)).alias(key))
            labels.append(F.col(key))
        else:
            keys.append(present(q(name), dtype).alias(key))
            labels.append(F.coalesce(F.col(key).cast("string"), F.lit(BLANK)).alias(key) if as_text else F.col(key))
        types.append(T.StringType() if as_text else dtype)
    return keys, labels, types


def _drop_empty_groups(long: DataFrame, measures: list[Measure]) -> DataFrame:
    """Groups in which every measure is null do not appear."""
    return long.where(_some_value(measures))


def _some_value(measures: list[Measure]) -> Column:
    if not all(ms.can_be_null(m) for m in measures):
        return F.lit(True)
    return any_of(
        F.col(ms.seen(i)) > 0 if m.aggregation == "average" else F.col(ms.state(i)).isNotNull()
        for i, m in enumerate(measures)
    )


def _cell_estimate(long: DataFrame, spec: PivotSpec, measures: list[Measure]) -> DataFrame:
    def groups(prefix: str, fields) -> Column:
        if not fields:
            return F.lit(1).cast("bigint")
        keys = [F.col(f"{prefix}{i}") for i in range(len(fields))]
        return long.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()

    fields = len({m.field for m in measures})
    one = long.sparkSession.range(1)
    return one.select(
        groups("__row", spec.rows).alias("row_groups"),
        groups("__col", spec.columns).alias("column_groups"),
        F.lit(fields).cast("bigint").alias("value_fields"),
    ).withColumn("cells", F.col("row_groups") * F.col("column_groups") * F.col("value_fields"))


def _check_cells(long, spec, measures, bound) -> None:
    found = _cell_estimate(long, spec, measures).first()
    if found["cells"] > bound:
        raise PivotError(
            f"the pivot would have about {found['cells']:,} cells, more than {bound:,} "
            f"({found['row_groups']:,} row groups, {found['column_groups']:,} column groups, "
            f"{found['value_fields']} value fields)"
        )


# Cells --------------------------------------------------------------------------


def _narrow(values, spec, measures) -> tuple[DataFrame, list[Cell]]:
    cells = [Cell(f"__cell{j}", m.name, m, values.schema[f"__value{j}"].dataType) for j, m in enumerate(measures)]
    leaf = values.select(
        *[f"__row{i}" for i in range(len(spec.rows))],
        *[_zero_filled(F.col(f"__value{j}"), c.dtype).alias(c.name) for j, c in enumerate(cells)],
    )
    if not spec.rows:
        # No groups: one row of plain aggregates, where nothing is filled.
        leaf = values.select(*[F.col(f"__value{j}").alias(c.name) for j, c in enumerate(cells)])
    return leaf, cells


def _numbered(values: DataFrame, spec: PivotSpec, most: int) -> tuple[DataFrame, list[str]]:
    """``values`` with the number of their column group, and the groups' headers.

    Groups are numbered ascending by their typed values and found again by value, so
    two timestamps a microsecond apart stay two groups.
    """
    cols = [f"__col{i}" for i in range(len(spec.columns))]
    order = [sort_key(F.col(c)) for c in cols]
    header = F.concat_ws(HEADER_JOIN, *[F.coalesce(F.col(c).cast("string"), F.lit(BLANK)) for c in cols])
    keys = values.select(*cols).distinct().orderBy(*order).limit(most + 1)
    # At most one row more than the bound, so numbering them in one task is small.
    keys = keys.select(
        (F.row_number().over(Window.orderBy(*order)) - 1).alias(_NUMBER),
        header.alias("header"),
        *[F.col(c).alias(f"__of{i}") for i, c in enumerate(cols)],
    )
    if can_materialise(values.sparkSession):
        keys = materialise(keys)
    found = sorted((r[_NUMBER], r["header"]) for r in keys.select(_NUMBER, "header").collect())
    if len(found) > most:
        raise PivotError(f"more than {most:,} column groups; filter or bucket the column fields")
    same = all_of(F.col(c).eqNullSafe(F.col(f"__of{i}")) for i, c in enumerate(cols))
    numbered = values.join(F.broadcast(keys.drop("header")), same).drop(*cols, *[f"__of{i}" for i in range(len(cols))])
    return numbered, [h for _, h in found]


def _unique(headers: list[str]) -> list[str]:
    """Different keys may show the same text; later ones get a number."""
    used: dict[str, int] = {}
    out = []
    for h in headers:
        used[h] = used.get(h, 0) + 1
        out.append(h if used[h] == 1 else f"{h} ({used[h]})")
    return out


def _widen(values, spec, measures, most) -> tuple[DataFrame, list[Cell]]:
    """Row groups against column groups, with totals.

    A row group holds its present cells as one array; totals are computed from the present
    cells, and only the last projection makes one column per cell. Nothing but present
    cells is shuffled, and the plan hardly grows with the number of columns.
    """
    numbered, found = _numbered(values, spec, most)
    n = len(found)
    several = len({m.field for m in measures}) < len(measures)
    plan = [(j, m, k) for j, m in enumerate(measures) for k in range(n)]
    headers = _unique([f"{m.name if several else m.field}{HEADER_JOIN}{found[k]}" for _, m, k in plan])
    names = [f"__value{j}" for j in range(len(measures))]
    types = [values.schema[v].dataType for v in names]
    cells = [Cell(f"__dense{j}[{k}]", headers[i], m, types[j]) for i, (j, m, k) in enumerate(plan)]
    rows = [f"__row{i}" for i in range(len(spec.rows))]

    held = numbered.groupBy(*rows).agg(
        F.array_sort(F.collect_list(F.struct(_NUMBER, *[_zero_filled(F.col(v), t).alias(v) for v, t in zip(names, types)]))).alias(_HELD)
    )
    held = held.withColumn(ROW_KIND, F.lit(LEAF))
    if spec.totals.column or (spec.totals.subtotals and len(rows) >= 2):
        held = held.unionByName(_held_totals(held, spec, measures, names, types))
    if _has_row_total(spec, measures, cells):
        held = held.withColumn(ROW_TOTAL, _row_total(F.col(_HELD), names[0], cells[0].dtype))
    total = [c for c in held.columns if c == ROW_TOTAL]
    if can_materialise(held.sparkSession):
        # Before the wide projection: adaptive execution plans it again after every stage.
        held = materialise(held)
    arrays = [_dense(F.col(_HELD), v, t, n).alias(f"__dense{j}") for j, (v, t) in enumerate(zip(names, types))]
    return held.select(*rows, *arrays, ROW_KIND, *total), cells


def _held_totals(leaf, spec, measures, names, types) -> DataFrame:
    """Subtotals and the column total of every column group, from the present cells alone.

    A cell that is not there counts as zero, so what a total needs besides the present
    cells is how many row groups it spans. One marker per row group, numbered before all
    column groups, is counted along in the same pass of grouping sets.
    """
    rows = [f"__row{i}" for i in range(len(spec.rows))]
    sets = []
    if spec.totals.subtotals and len(rows) >= 2:
        sets.append([*rows[:-1], _NUMBER])
    if spec.totals.column:
        sets.append([_NUMBER])
    parts = [(m, v, _part(m, F.col(v), t), t) for m, v, t in zip(measures, names, types)]
    cells = leaf.select(*rows, F.inline(_HELD)).select(*rows, _NUMBER, *[p.alias(v) for _, v, p, _ in parts])
    marker = leaf.select(*rows, F.lit(_MARKER).alias(_NUMBER), *[F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema.fields[len(rows) + 1 :]])
    by = [*rows, _NUMBER]
    grouped = cells.unionByName(marker).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(
        F.grouping_id().alias("__grouping"),
        F.count(F.lit(1)).alias("__rows"),
        *[c for m, v, _, _ in parts for c in (_fold(m)(v).alias(v), F.count(v).alias(f"{v}_n"))],
    )
    states = F.struct(_NUMBER, "__rows", *[c for v in names for c in (v, f"{v}_n")])
    held = grouped.groupBy(*rows, "__grouping").agg(F.array_sort(F.collect_list(states)).alias(_HELD))
    groups = F.get(F.col(_HELD), F.lit(0))["__rows"]

    def total(state: Column) -> Column:
        done = [_total(m, state[v], state[f"{v}_n"], state["__rows"], F.col("__groups"), t).alias(v) for m, v, _, t in parts]
        return F.struct(state[_NUMBER].alias(_NUMBER), *done)

    held = held.withColumn("__groups", groups)
    # The number is in every set, so its bit, the lowest, is never set.
    kind = F.when(F.col("__grouping") == 2 ** len(by) - 2, TOTAL).otherwise(SUBTOTAL)
    return held.select(*rows, F.transform(F.slice(_HELD, 2, F.size(_HELD)), total).alias(_HELD), kind.alias(ROW_KIND))


def _part(m: Measure, cell: Column, dtype: T.DataType) -> Column:
    """What a cell adds to a total of its column group."""
    return micros(cell) if m.aggregation == "average" and is_date(dtype) else cell


def _fold(m: Measure):
    return {"min": F.min, "max": F.max}.get(m.aggregation, F.sum)


def _total(m: Measure, folded: Column, n: Column, present_rows: Column, groups: Column, dtype: T.DataType) -> Column:
    """A total over ``groups`` row groups of which ``present_rows`` have a cell, ``n`` a value."""
    if m.aggregation == "average":
        return from_micros(folded / F.nullif(n, F.lit(0))) if is_date(dtype) else (folded / groups).cast(dtype)
    if m.aggregation in ("min", "max") and is_numeric(dtype):
        with_zero = (F.least if m.aggregation == "min" else F.greatest)(folded, F.lit(0).cast(dtype))
        return F.when(present_rows < groups, with_zero).otherwise(folded)
    return folded.cast(dtype)


def _dense(held: Column, name: str, dtype: T.DataType, n: int) -> Column:
    """The cells of a row as one array over all column groups; the gaps between present
    cells are filled like shown ones, each gap at once."""
    fill = F.lit(0).cast(dtype) if is_numeric(dtype) else F.lit(None).cast(dtype)
    number = lambda i: F.get(held, i)[_NUMBER]

    def with_gap(cell: Column, i: Column) -> Column:
        gap = cell[_NUMBER] - F.coalesce(number(i - 1), F.lit(-1)) - 1
        return F.concat(F.array_repeat(fill, gap), F.array(cell[name]))

    rest = F.lit(n - 1) - number(F.size(held) - 1)
    return F.concat(F.flatten(F.transform(held, with_gap)), F.array_repeat(fill, rest))


def _row_total(held: Column, name: str, dtype: T.DataType) -> Column:
    """The plain sum of a row's cells, whatever the aggregation; missing cells are zero."""
    if isinstance(dtype, T.DecimalType):
        dtype = T.DecimalType(38, dtype.scale)
    return F.aggregate(held, F.lit(0).cast(dtype), lambda a, x: (a + x[name]).cast(dtype))


def _widen_measures(values, spec, measures, most) -> tuple[DataFrame, list[Cell]]:
    """Column groups without row groups: one result row per measure."""
    values, found_headers = _numbered(values, spec, most)
    found = [values.schema[f"__value{j}"].dataType for j in range(len(measures))]
    if all(t == found[0] for t in found):
        common = found[0]
    elif all(is_numeric(t) for t in found):
        common = T.DoubleType()
    else:
        common = T.StringType()
    entries = F.array(
        *[
            F.struct(
                F.lit(j).alias("__row0"),
                F.lit(m.name).alias("__measure"),
                F.col(f"__value{j}").cast(common).alias("v"),
            )
            for j, m in enumerate(measures)
        ]
    )
    wide = (
        values.select(_NUMBER, F.inline(entries))
        .groupBy("__row0", "__measure")
        .pivot(_NUMBER, list(range(len(found_headers))))
        .agg(F.first("v"))
    )
    headers = _unique(found_headers)
    cells = [Cell(f"__cell{n}", h, measures[0], common) for n, h in enumerate(headers)]
    leaf = wide.select(
        "__row0", "__measure", *[_zero_filled(q(str(k)), common).alias(c.name) for k, c in enumerate(cells)]
    )
    return leaf, cells


def _zero_filled(col: Column, dtype: T.DataType) -> Column:
    return F.coalesce(col, F.lit(0).cast(dtype)) if is_numeric(dtype) else col


# Totals over cells ---------------------------------------------------------------


def _with_totals(leaf: DataFrame, spec: PivotSpec, cells: list[Cell]) -> DataFrame:
    """Add subtotal and column-total rows with one pass over the leaf rows.

    Grouping sets compute leaf rows, prefix subtotals and the column total in one
    exchange; the grouping id tells them apart even where a key itself is null.
    """
    n = len(spec.rows)
    rows = [f"__row{i}" for i in range(n)]
    subtotals = spec.totals.subtotals and n >= 2
    column_total = spec.totals.column and n >= 1
    if not subtotals and not column_total:
        return leaf.withColumn(ROW_KIND, F.lit(LEAF))
    sets = [rows] + ([rows[:-1]] if subtotals else []) + ([[]] if column_total else [])
    grouped = leaf.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in rows]).agg(
        F.grouping_id().alias("__grouping"),
        *[ms.recombined(c.measure, c.name, c.dtype).cast(c.dtype).alias(c.name) for c in cells],
    )
    kind = (
        F.when(F.col("__grouping") == 0, LEAF)
        .when(F.col("__grouping") == 2**n - 1, TOTAL)
        .otherwise(SUBTOTAL)
    )
    return grouped.select(
        *rows,
        *[_zero_filled(F.col(c.name), c.dtype).alias(c.name) for c in cells],
        kind.alias(ROW_KIND),
    )


def _has_row_total(spec, measures, cells) -> bool:
    return spec.totals.row and len(measures) == 1 and len(cells) > 1 and is_numeric(cells[0].dtype)


def _with_row_total(frame, spec, measures, cells) -> DataFrame:
    """The plain sum of a row's cells, whatever the aggregation."""
    if not _has_row_total(spec, measures, cells):
        return frame
    dtype = cells[0].dtype
    if isinstance(dtype, T.DecimalType):
        dtype = T.DecimalType(38, dtype.scale)
    # One expression over an array: a chain of additions would nest as deep as it is wide.
    folded = f"aggregate(array({', '.join(c.name for c in cells)}), CAST(0 AS {dtype.simpleString()}), (a, x) -> CAST(a + x AS {dtype.simpleString()}))"
    return frame.withColumn(ROW_TOTAL, F.expr(folded))


# Presentation ---------------------------------------------------------------------


def _is_compact(spec: PivotSpec) -> bool:
    return spec.layout == "compact" and len(spec.rows) > 1


def display_order(result: PivotResult) -> list[Column]:
    """The full sort key of the result rows, ties broken by the row fields.

    With subtotals the prefix fields lead, so each subtotal follows its own rows.
    """
    spec = result.spec
    fields = [spec.shown(f) for f in spec.rows]
    by_name = {name: f"__row{i}" for i, name in enumerate(fields)}
    by_name.update({f: f"__row{i}" for i, f in enumerate(spec.rows)})
    asked: dict[str, str] = {}
    for name, direction in spec.sorting.items():
        if name in by_name:
            asked.setdefault(by_name[name], direction or "asc")
            continue
        for cell in result.cells:
            if cell.header == name or (not spec.columns and cell.measure.name == name):
                asked.setdefault(cell.name, direction or "asc")
        if name == ROW_TOTAL and result.has_row_total:
            asked.setdefault(ROW_TOTAL, direction or "asc")
    rows = [f"__row{i}" for i in range(len(fields))] or (["__row0"] if spec.columns else [])
    kind_rank = F.when(F.col(ROW_KIND) == TOTAL, 1).otherwise(0).asc()
    order = [kind_rank]
    rest = list(asked)
    if spec.totals.subtotals and len(rows) >= 2:
        prefix = [c for c in asked if c in rows[:-1]] + [c for c in rows[:-1] if c not in asked]
        order += [sort_key(F.expr(c), asked.get(c, "asc")) for c in prefix]
        order.append(F.when(F.col(ROW_KIND) == LEAF, 0).otherwise(1).asc())
        rest = [c for c in asked if c not in prefix]
        rows = rows[-1:]
    order += [sort_key(F.expr(c), asked[c]) for c in rest]
    order += [sort_key(F.col(c)) for c in rows if c not in rest]
    return order


def _labels(result: PivotResult) -> list[Column]:
    """Row fields of leaf rows as they are; totals get their label or a blank."""
    n = len(result.spec.rows)
    out = []
    for i, dtype in enumerate(result.row_types):
        col = F.col(f"__row{i}")
        if is_text(dtype):
            total = F.lit(COLUMN_TOTAL if i == 0 else "")
            col = F.when(F.col(ROW_KIND) == TOTAL, total).otherwise(col)
            if i == n - 1 and n >= 2:
                col = F.when(F.col(ROW_KIND) == SUBTOTAL, F.lit("")).otherwise(col)
        out.append(col)
    return out


def _shown_rows(result: PivotResult) -> DataFrame:
    spec = result.spec
    n = len(spec.rows)
    frame = result.frame
    repeat = spec.totals.repeat_labels and n and not _is_compact(spec)
    order = display_order(result)
    if result.ordered and not repeat and (n or spec.columns):
        frame = frame.orderBy(*order)
    if repeat:
        frame = with_position(frame, order)

    labels = _labels(result)
    if _is_compact(spec):
        fields = [_compact_label(result).alias(COMPACT_COLUMN)]
    else:
        fields = [c.alias(spec.shown(f)) for c, f in zip(labels, spec.rows)]
    if spec.columns and not spec.rows:
        fields.append(F.col("__measure").alias("measure"))

    extra = []
    if result.markers or spec.totals.subtotals or spec.totals.column:
        extra.append(F.col(ROW_KIND))
    if result.markers:
        level, parent = _hierarchy(result)
        extra += [level.alias(LEVEL), parent.alias(PARENT)]
    if repeat:
        extra += [F.col(POSITION), F.col(ROW_KIND).alias("__kind")]
    # The cells are named as text: a thousand columns built call by call take longer than to run.
    led = [c.alias(f"__shown{i}") for i, c in enumerate([*fields, *extra])]
    names = frame.select(*fields, *extra).columns
    shown_as = [f"__shown{i} AS {quoted(name)}" for i, name in enumerate(names)]
    cells = [f"{c.name} AS {quoted(c.header)}" for c in result.cells] + ([ROW_TOTAL] if result.has_row_total else [])
    staged = frame.select("*", *led).selectExpr(*shown_as[: len(fields)], *cells, *shown_as[len(fields) :])
    if not repeat:
        return staged

    shown = [spec.shown(f) for f in spec.rows]
    return _repeat_labels(staged, shown, [f for f, t in zip(shown, result.row_types) if is_text(t)], result.ordered)


def _repeat_labels(staged: DataFrame, fields: list[str], text_fields: list[str], ordered: bool) -> DataFrame:
    """Fill empty group cells from the row above; a subtotal's last field stays blank."""
    last = fields[-1]
    names = {f: f"__fill{i}" for i, f in enumerate(fields)}
    renamed = staged.withColumnsRenamed(names)
    # Only empty text is filled; a null number or date is the label of a group of its own.
    fills = {names[f]: F.nullif(F.col(names[f]), F.lit("")) for f in text_fields}
    filled = forward_fill(renamed, fills, skip=F.col("__kind") == TOTAL) if fills else renamed
    if len(fields) > 1 and last in text_fields:
        filled = filled.withColumn(
            names[last], F.when(F.col("__kind") == SUBTOTAL, F.lit("")).otherwise(F.col(names[last]))
        )
    if ordered:
        filled = filled.orderBy(POSITION)
    return filled.withColumnsRenamed({v: k for k, v in names.items()}).drop(POSITION, "__kind")


def _texts(result: PivotResult) -> list[Column]:
    return [F.coalesce(F.col(f"__row{i}").cast("string"), F.lit(BLANK)) for i in range(len(result.spec.rows))]


def _compact_label(result: PivotResult) -> Column:
    texts = _texts(result)
    return (
        F.when(F.col(ROW_KIND) == TOTAL, F.lit(COLUMN_TOTAL))
        .when(F.col(ROW_KIND) == SUBTOTAL, F.concat_ws(LABEL_JOIN, *texts[:-1]))
        .otherwise(F.concat_ws(LABEL_JOIN, *texts))
    )


def _hierarchy(result: PivotResult) -> tuple[Column, Column]:
    """Depth of a row and the joined key of the groups above it."""
    texts = _texts(result)
    n = len(texts)
    if not n:
        return F.lit(0), F.lit("")
    if _is_compact(result.spec):
        parts = F.filter(F.split(_compact_label(result), LABEL_JOIN), lambda p: p != "")
        level = F.greatest(F.lit(0), F.size(parts) - 1)
        parent = F.array_join(F.slice(parts, F.lit(1), level), LABEL_JOIN)
    else:
        filled = [all_of([t != "", t != BLANK]) for t in texts]
        level = F.lit(0)
        parent = F.lit("")
        for i in range(1, n):
            level = F.when(filled[i], F.lit(i)).otherwise(level)
            parent = F.when(filled[i], F.concat_ws(PARENT_JOIN, *texts[:i])).otherwise(parent)
        level = F.when(F.col(ROW_KIND) == SUBTOTAL, F.lit(n - 2)).otherwise(level)
        parent = F.when(
            F.col(ROW_KIND) == SUBTOTAL, F.concat_ws(PARENT_JOIN, *texts[: max(n - 2, 0)])
        ).otherwise(parent)
    is_total = F.col(ROW_KIND) == TOTAL
    return F.when(~is_total, level).cast("int"), F.when(~is_total, parent)


def _finished_type(m: Measure, dtype: T.DataType) -> T.DataType:
    if m.aggregation == "count":
        return T.LongType()
    if m.aggregation == "average" and is_numeric(dtype):
        return T.DoubleType()
    return dtype
