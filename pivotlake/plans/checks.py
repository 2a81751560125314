"""Rules for pivot definitions: one definition against a schema, or a whole table
of saved definitions against the column catalog."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pivotlake.errors import DefinitionError, PivotError
from pivotlake.functions.dates import GRAINS
from pivotlake.functions.names import catalog_type, is_date
from pivotlake.operators.measures import check_measure
from pivotlake.spec import (
    AGGREGATIONS,
    DATE_FORMATS,
    DIRECTIONS,
    LAYOUTS,
    NUMBER_FORMATS,
    RULE_TYPES,
    PivotSpec,
)

ERROR, WARNING = "error", "warning"

# The catalog's type words, and the sizes a definition is warned about.
NUMERIC_WORDS = ("integer", "float", "decimal")
DATE_WORDS = ("datetime", "date")
ROWS_WARNED = 100_000
COLUMNS_WARNED = 200

# Rules that need a value to compare with.
VALUE_RULES = ("gt", "lt", "eq")


@dataclass(frozen=True)
class Finding:
    severity: str
    rule: str
    field: str | None
    detail: str | None = None

    @property
    def message(self) -> str:
        return " ".join(x for x in (self.rule, self.field, self.detail) if x)


def allowed_aggregations(data_type: str) -> tuple[str, ...]:
    return AGGREGATIONS if data_type in NUMERIC_WORDS + DATE_WORDS else ("count",)


def check_spec(
    df: DataFrame, spec: PivotSpec, *, max_rows: int | None = None, max_columns: int | None = None
) -> list[Finding]:
    """Every broken rule of one definition over the schema of ``df``.

    ``max_rows`` and ``max_columns`` are optional guards; the first costs a count.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found: list[Finding] = []

    def error(rule, field, detail=None):
        found.append(Finding(ERROR, rule, field, detail))

    def warning(rule, field, detail=None):
        found.append(Finding(WARNING, rule, field, detail))

    if spec.layout not in LAYOUTS:
        error("layout_unknown", None, spec.layout)
    for part, fields in (("row", spec.rows), ("column", spec.columns), ("filter", spec.filters)):
        for name in fields:
            if name not in types:
                error("field_missing", name, part)
    if not spec.values:
        warning("values_missing", None)
    seen = set()
    for m in spec.measures(df.columns[0]):
        if m.aggregation not in AGGREGATIONS:
            error("aggregation_unknown", m.field, m.aggregation)
        elif m.field not in types:
            error("field_missing", m.field, "value")
        elif m.aggregation not in allowed_aggregations(catalog_type(types[m.field])):
            error("aggregation_not_allowed", m.field, m.aggregation)
        if m.name in seen:
            error("label_repeated", m.field, m.name)
        seen.add(m.name)
    for name, grain in spec.date_grouping.items():
        if name not in types:
            error("field_missing", name, "date_grouping")
        elif not is_date(types[name]):
            warning("grain_on_other_type", name, grain)
        if grain not in GRAINS:
            error("grain_unknown", name, grain)
    for name, direction in spec.sorting.items():
        if name not in types:
            error("field_missing", name, "sort")
        if direction not in DIRECTIONS:
            error("direction_unknown", name, direction)
    display = spec.display
    for part, formats, allowed in (
        ("number_format", display.number_format, NUMBER_FORMATS),
        ("date_format", display.date_format, DATE_FORMATS),
    ):
        for name, fmt in formats.items():
            if name not in types:
                error("field_missing", name, part)
            elif fmt not in allowed:
                error("format_unknown", name, fmt)
    for rule in display.rules:
        if not rule.field:
            error("rule_without_field", None, rule.type)
            continue
        if rule.field not in types:
            error("field_missing", rule.field, "rule")
        if rule.type not in RULE_TYPES:
            error("rule_unknown", rule.field, rule.type)
        if rule.type in VALUE_RULES and rule.value is None:
            error("rule_value_missing", rule.field, rule.type)
    for part, fields in (("frozen", display.frozen), ("hidden", display.hidden)):
        for name in fields:
            if name not in types:
                error("field_missing", name, part)
    if max_columns is not None and len(types) > max_columns:
        warning("columns_many", None, str(len(types)))
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        warning("rows_many", None, str(max_rows))
    return found


# What stops a pivot from being computed. Display options only matter to a view, and
# the engine can also sort by a value column.
_BLOCKING = {
    "layout_unknown",
    "aggregation_unknown",
    "aggregation_not_allowed",
    "label_repeated",
    "grain_unknown",
}
_BLOCKING_PARTS = {"row", "column", "filter", "value", "date_grouping"}


def require_valid(df: DataFrame, spec: PivotSpec) -> None:
    """Raise when the definition cannot be computed over ``df``."""
    blocking = [
        f
        for f in check_spec(df, spec)
        if f.severity == ERROR
        and (f.rule in _BLOCKING or (f.rule == "field_missing" and f.detail in _BLOCKING_PARTS))
    ]
    if blocking:
        raise DefinitionError(blocking)
    for m in spec.measures(df.columns[0]):
        check_measure(m, df.schema[m.field].dataType)


def check_size(df: DataFrame, *, max_rows: int | None = None, max_columns: int | None = None) -> None:
    """Refuse tables beyond a caller's bounds; there are none by default."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise PivotError(f"{len(df.columns):,} columns, more than {max_columns:,}")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise PivotError(f"more than {max_rows:,} rows")


# Saved definitions ----------------------------------------------------------------

_SCHEMA = """
    rows array<string>, columns array<string>, values array<string>,
    filters map<string,string>, dateGrouping map<string,string>, layout string,
    sorting map<string,string>,
    displayOptions struct<
        numberFormat: map<string,string>, dateFormat: map<string,string>,
        conditionalFormats: array<struct<field: string, type: string, value: string>>,
        frozenColumns: array<string>, hiddenColumns: array<string>>
"""

_ENTRY = "array<struct<part: string, field: string, value: string, has_value: boolean>>"


def _entry(part, field: Column, value: Column | None = None, has_value: Column | None = None) -> Column:
    return F.struct(
        F.lit(part).alias("part"),
        field.alias("field"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
        (F.lit(True) if has_value is None else has_value).alias("has_value"),
    )


def _names(part: str, col: Column) -> Column:
    return F.coalesce(F.transform(col, lambda x: _entry(part, x)), F.array().cast(_ENTRY))


def _pairs(part: str, col: Column) -> Column:
    return F.coalesce(
        F.transform(F.map_entries(col), lambda e: _entry(part, e["key"], e["value"])), F.array().cast(_ENTRY)
    )


def _values(col: Column) -> Column:
    """Value entries are objects, or bare field names that are summed."""

    def one(v: Column) -> Column:
        is_object = F.ltrim(v).startswith("{")
        return _entry(
            "value",
            F.when(is_object, F.get_json_object(v, "$.field")).otherwise(v),
            F.lower(
                F.when(is_object, F.coalesce(F.get_json_object(v, "$.aggregation"), F.lit("sum"))).otherwise("sum")
            ),
        )

    return F.coalesce(F.transform(col, one), F.array().cast(_ENTRY))


def check_definitions(definitions: DataFrame, datasets: DataFrame, sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per broken rule of every saved definition.

    ``definitions`` has definition_id, dataset_id, sheet_name and definition (JSON);
    the catalog frames are ``datasets`` (id), ``sheets`` (dataset_id, sheet_name,
    row_count) and ``columns`` (dataset_id, sheet_name, column_name, data_type).
    """
    ids = ["definition_id", "dataset_id", "sheet_name"]
    # One row per sheet with all its columns, so that definitions are joined with it once.
    column = F.struct("column_name", "data_type")
    listed = sheets.select("dataset_id", "sheet_name", "row_count", F.lit(True).alias("has_sheet"), F.lit(None).cast("struct<column_name:string,data_type:string>").alias("column"))
    listed = listed.unionByName(columns.select("dataset_id", "sheet_name", column.alias("column")), allowMissingColumns=True)
    listed = listed.groupBy("dataset_id", "sheet_name").agg(
        F.max("row_count").alias("row_count"), F.max("has_sheet").alias("has_sheet"), F.collect_list("column").alias("sheet_columns")
    )
    known = (
        definitions.select(*ids, F.from_json("definition", _SCHEMA).alias("d"), "definition")
        .join(datasets.select(F.col("id").alias("dataset_id"), F.lit(True).alias("has_dataset")), "dataset_id", "left")
        .join(listed.where("has_sheet").withColumn("n_columns", F.size("sheet_columns")), ["dataset_id", "sheet_name"], "left")
    )
    has_dataset, has_sheet = F.col("has_dataset").isNotNull(), F.col("has_sheet").isNotNull()
    readable = F.try_parse_json("definition").isNotNull()
    layout = F.coalesce(F.col("d.layout"), F.lit("tabular"))
    whole = [
        (~has_dataset, ERROR, "dataset_missing", F.col("dataset_id").cast("string")),
        (has_dataset & ~has_sheet, ERROR, "sheet_missing", F.col("sheet_name")),
        (has_dataset & ~readable, ERROR, "definition_malformed", F.lit(None)),
        (has_dataset & readable & ~layout.isin(*LAYOUTS), ERROR, "layout_unknown", layout),
        (
            has_sheet & readable & (F.coalesce(F.size("d.values"), F.lit(0)) <= 0),
            WARNING,
            "values_missing",
            F.lit(None),
        ),
        (has_sheet & (F.col("row_count") > ROWS_WARNED), WARNING, "rows_many", F.col("row_count").cast("string")),
        (has_sheet & (F.col("n_columns") > COLUMNS_WARNED), WARNING, "columns_many", F.col("n_columns").cast("string")),
    ]

    options = F.col("d.displayOptions")
    entries = F.concat(
        _names("row", F.col("d.rows")),
        _names("column", F.col("d.columns")),
        _names("filter", F.map_keys(F.col("d.filters"))),
        _values(F.col("d.values")),
        _pairs("date_grouping", F.col("d.dateGrouping")),
        _pairs("sort", F.col("d.sorting")),
        _pairs("number_format", options["numberFormat"]),
        _pairs("date_format", options["dateFormat"]),
        F.coalesce(
            F.transform(
                options["conditionalFormats"],
                lambda r: _entry("rule", r["field"], r["type"], r["value"].isNotNull()),
            ),
            F.array().cast(_ENTRY),
        ),
        _names("frozen", options["frozenColumns"]),
        _names("hidden", options["hiddenColumns"]),
    )
    specific = F.when(has_sheet, F.flatten(F.transform(entries, _entry_findings)))
    both = F.concat(_findings(whole, F.lit(None).cast("string")), F.coalesce(specific, F.array().cast(_FINDINGS)))
    return known.select(*ids, F.inline(both))


_FINDINGS = "array<struct<severity: string, rule: string, field: string, detail: string>>"


def _entry_findings(entry: Column) -> Column:
    """The broken rules of one entry, as an array; ``sheet_columns`` are those of its sheet."""
    part, field, value = entry["part"], entry["field"], entry["value"]
    data_type = F.get(F.filter("sheet_columns", lambda c: c["column_name"] == field), F.lit(0))["data_type"]
    missing = data_type.isNull()
    all_allowed = data_type.isin(*NUMERIC_WORDS, *DATE_WORDS)
    named = F.coalesce(field, F.lit("")) != ""
    is_rule = part == "rule"
    rules = [
        (is_rule & ~named, ERROR, "rule_without_field", value),
        ((part == "value") & ~value.isin(*AGGREGATIONS), ERROR, "aggregation_unknown", value),
        (
            named & missing & ((part != "value") | value.isin(*AGGREGATIONS)),
            ERROR,
            "field_missing",
            part,
        ),
        (
            (part == "value") & ~missing & value.isin(*AGGREGATIONS) & (value != "count") & ~all_allowed,
            ERROR,
            "aggregation_not_allowed",
            value,
        ),
        ((part == "date_grouping") & ~value.isin(*GRAINS), ERROR, "grain_unknown", value),
        ((part == "date_grouping") & ~missing & ~data_type.isin(*DATE_WORDS), WARNING, "grain_on_other_type", value),
        ((part == "sort") & ~value.isin(*DIRECTIONS), ERROR, "direction_unknown", value),
        ((part == "number_format") & ~missing & ~value.isin(*NUMBER_FORMATS), ERROR, "format_unknown", value),
        ((part == "date_format") & ~missing & ~value.isin(*DATE_FORMATS), ERROR, "format_unknown", value),
        (is_rule & named & ~value.isin(*RULE_TYPES), ERROR, "rule_unknown", value),
        (is_rule & named & value.isin(*VALUE_RULES) & ~entry["has_value"], ERROR, "rule_value_missing", value),
    ]
    return _findings(rules, field)


def _findings(rules, field: Column) -> Column:
    made = [
        F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(
                F.lit(severity).alias("severity"),
                F.lit(rule).alias("rule"),
                field.alias("field"),
                detail.cast("string").alias("detail"),
            ),
        )
        for broken, severity, rule, detail in rules
    ]
    return F.array_compact(F.array(*made))


def to_json(spec: PivotSpec) -> str:
    """The camelCase JSON form of a definition, as saved and as kept in audits."""
    t, d = spec.totals, spec.display
    values = [v if isinstance(v, (str, dict)) else {"field": v.field, "aggregation": v.aggregation, "label": v.label} for v in spec.values]
    return json.dumps(
        {
            "rows": list(spec.rows),
            "columns": list(spec.columns),
            "values": values,
            "filters": dict(spec.filters),
            "dateGrouping": dict(spec.date_grouping),
            "sorting": dict(spec.sorting),
            "layout": spec.layout,
            "blankAsText": spec.blank_as_text,
            "totals": {
                "showGrandTotals": t.grand,
                "showRowTotals": t.row,
                "showColumnTotals": t.column,
                "showSubtotals": t.subtotals,
                "repeatItemLabels": t.repeat_labels,
            },
            "displayOptions": {
                "numberFormat": dict(d.number_format),
                "dateFormat": dict(d.date_format),
                "conditionalFormats": [
                    {"field": r.field, "type": r.type, "value": r.value, "background": r.background} for r in d.rules
                ],
                "frozenColumns": list(d.frozen),
                "hiddenColumns": list(d.hidden),
            },
        },
        default=str,
    )
