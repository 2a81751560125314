"""Row filters and pivot-row selections as Catalyst predicates.

Every literal is cast to the type of its column, so the comparison stays a plain
``column op literal`` that reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pivotlake.errors import PivotError
from pivotlake.functions.dates import bucket, display_name, label_range
from pivotlake.functions.names import all_of, any_of, is_date, is_float, is_text, missing, present, q
from pivotlake.spec import BLANK


def typed(value: Any, dtype: T.DataType) -> Column:
    """``value`` as a literal comparable with ``dtype``; null when it cannot be one.

    Numbers keep their fraction even against an integer column, so ``>= 5.5`` is
    not turned into ``>= 5``.
    """
    if isinstance(value, (datetime, date)):
        value = value.isoformat()
    if is_text(dtype):
        text = str(value).lower() if isinstance(value, bool) else value
        return F.lit(text).cast("string")
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        try:
            exact = Decimal(int(value) if isinstance(value, bool) else str(value).strip())
        except InvalidOperation:
            return F.lit(None).cast(dtype)
        if not exact.is_finite():
            return F.lit(None).cast(dtype)
        if isinstance(dtype, T.IntegralType) and exact == exact.to_integral_value():
            return F.lit(int(exact)).try_cast(dtype)
        return F.lit(exact)
    if isinstance(value, bool) and not isinstance(dtype, T.BooleanType):
        value = int(value)
    return F.lit(value).try_cast(dtype)


def _member(col: Column, dtype: T.DataType, values: Sequence[Any]) -> Column:
    """Two-valued membership: never null; a null in the list matches null rows."""
    known = [typed(v, dtype) for v in values if not _is_missing(v)]
    has_null = any(_is_missing(v) for v in values)
    if not known:
        return missing(col, dtype) if has_null else F.lit(False)
    if has_null:
        return missing(col, dtype) | F.coalesce(col.isin(*known), F.lit(False))
    return col.isin(*known)


def _is_missing(value: Any) -> bool:
    return value is None or (isinstance(value, float) and value != value)


def _structured(col: Column, dtype: T.DataType, rule: Mapping[str, Any]) -> Column:
    if "in" in rule:
        return _member(col, dtype, rule["in"])
    if "notIn" in rule:
        return ~F.coalesce(_member(col, dtype, rule["notIn"]), F.lit(False))
    if "equals" in rule:
        return col == typed(rule["equals"], dtype)
    if "contains" in rule:
        return present(col, dtype).cast("string").rlike(f"(?iu){rule['contains']}")
    bounds = []
    if "from" in rule:
        bounds.append(col >= typed(rule["from"], dtype))
        if is_float(dtype):
            # NaN sorts above every number; the bound itself still reaches the scan.
            bounds.append(~F.isnan(col))
    if "to" in rule:
        bounds.append(col <= typed(rule["to"], dtype))
    return all_of(bounds)


def condition(df: DataFrame, field: str, expected: Any) -> Column:
    """The predicate of one filter entry."""
    if field not in df.columns:
        raise PivotError(f"filter field not found: {field}")
    col, dtype = q(field), df.schema[field].dataType
    if isinstance(expected, Mapping):
        return _structured(col, dtype, expected)
    if isinstance(expected, (list, tuple, set, frozenset)):
        return _member(col, dtype, list(expected))
    if _is_missing(expected):
        return missing(col, dtype)
    return col == typed(expected, dtype)


def apply_filters(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Keep the rows that satisfy every entry."""
    return df.where(filter_condition(df, filters)) if filters else df


def filter_condition(df: DataFrame, filters: Mapping[str, Any]) -> Column:
    """The predicate of all entries together."""
    return all_of(condition(df, f, v) for f, v in filters.items())


def group_column(df: DataFrame, field: str, date_grouping: Mapping[str, str]) -> tuple[Column, T.DataType]:
    """The expression and type a group field is compared and grouped by."""
    dtype = df.schema[field].dataType
    grain = date_grouping.get(field)
    if grain:
        return bucket(q(field), dtype, grain), T.StringType()
    return q(field), dtype


def resolve_field(df: DataFrame, name: str, date_grouping: Mapping[str, str]) -> str | None:
    """The raw field behind a raw or displayed group name, or None."""
    for field, grain in date_grouping.items():
        if name in (field, display_name(field, grain)) and field in df.columns:
            return field
    return name if name in df.columns else None


def selection_condition(
    df: DataFrame, selection: Mapping[str, Any], date_grouping: Mapping[str, str]
) -> Column:
    """The rows behind one pivot row, as a conjunction of typed equalities.

    Unknown names are skipped; a selection of unknown names only matches nothing,
    an empty selection matches everything. ``(blank)`` selects nulls.
    """
    parts = []
    for name, expected in selection.items():
        field = resolve_field(df, name, date_grouping)
        if field is None:
            continue
        raw_type = df.schema[field].dataType
        if field in date_grouping and is_date(raw_type) and expected not in (None, BLANK):
            parts.append(_inside_bucket(q(field), raw_type, str(expected), date_grouping[field]))
            continue
        col, dtype = group_column(df, field, date_grouping)
        if _is_missing(expected) or expected == BLANK:
            parts.append(missing(col, dtype) | (col == F.lit(BLANK)) if is_text(dtype) else missing(col, dtype))
        else:
            parts.append(col == F.lit(selected_text(expected, dtype)).try_cast(dtype))
    if selection and not parts:
        return F.lit(False)
    return all_of(parts)


def selected_text(value: Any, dtype: T.DataType) -> str | None:
    """A selected value in the one text form that is cast to ``dtype``; None if it is no
    value of that type. Every way of applying selections goes through it."""
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        try:
            exact = Decimal(int(value) if isinstance(value, bool) else str(value).replace("_", "?").strip())
            scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
            rounded = round(exact, scale) if exact.is_finite() else None
        except InvalidOperation:
            # Not a number, or one of more digits than any column holds.
            return None
        return f"{rounded:f}" if rounded is not None and rounded == exact else None
    if isinstance(value, bool):
        return str(value).lower() if is_text(dtype) or isinstance(dtype, T.BooleanType) else str(int(value))
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def given_text(col: Column, given: T.DataType, dtype: T.DataType) -> Column:
    """:func:`selected_text` for a column of selected values of type ``given``."""
    if isinstance(given, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if is_date(given):
        seconds = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(col, "SSSSSS")
        return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    if isinstance(given, T.BooleanType):
        in_words = is_text(dtype) or isinstance(dtype, T.BooleanType)
        return col.cast("string") if in_words else col.cast("int").cast("string")
    text = present(col, given).cast("string")
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return _exact_text(F.regexp_replace(text, r"^\s+|\s+$", ""), dtype.scale if isinstance(dtype, T.DecimalType) else 0)
    if is_float(given):
        whole = col.try_cast("decimal(38,0)")
        return F.when(whole == col, whole.cast("string")).otherwise(text)
    return text


def _exact_text(text: Column, scale: int) -> Column:
    """``text`` where it is a number of at most ``scale`` decimal places, however written."""
    mantissa = F.regexp_extract(text, r"^[+-]?([\d.]*)", 1)
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    counted = F.rtrim(digits, F.lit("0"))
    places = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1)) - (F.length(digits) - F.length(counted)) - exponent
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & ((counted.rlike("^0*$")) | (places <= scale)), text)


@dataclass(frozen=True)
class TypedKey:
    """A column of selected values against a field: the value as the field's type, and
    which rows ask for missing values or for something no row can have."""

    value: Column
    wants_missing: Column
    misfit: Column


def typed_key(col: Column, given: T.DataType, dtype: T.DataType) -> TypedKey:
    """A selected value is one of three: missing (null, NaN or the blank label), a value of
    the field's type, or none. Only the first may meet missing values of the field."""
    wants = missing(col, given)
    if is_text(given):
        wants = wants | (col == BLANK)
    text = given_text(col, given, dtype)
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
        cast = text.try_cast(T.DecimalType(38, scale)).try_cast(dtype)
    else:
        cast = text.try_cast(dtype)
    value = F.when(~wants, cast)
    return TypedKey(value, wants, ~wants & value.isNull())


def _inside_bucket(col: Column, dtype: T.DataType, text: str, grain: str) -> Column:
    """The dates of one bucket as a range, which reaches the scan."""
    days = label_range(text, grain)
    if days is None:
        return F.lit(False)
    first, after = (typed(d, dtype) for d in days)
    return (col >= first) & (col < after)


def any_selection(
    df: DataFrame, selections: Sequence[Mapping[str, Any]], date_grouping: Mapping[str, str]
) -> Column:
    return any_of(selection_condition(df, s, date_grouping) for s in selections)


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """Sorted distinct non-blank values of a field over the whole table."""
    col = q(field)
    kept = ~missing(col, df.schema[field].dataType)
    if is_text(df.schema[field].dataType):
        kept = kept & (col != "")
    return df.where(kept).select(col).distinct().orderBy(col)
