"""Text forms of cells: number formats, date formats and the missing-value dash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from pivotlake.functions.dates import as_timestamp
from pivotlake.functions.names import is_numeric, is_text

# Fixed value: what a missing cell shows.
MISSING = "—"

# Text that is a plain number.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# The pattern behind each date format name.
_DATE_PATTERNS = {
    "yyyy-mm-dd": "yyyy-MM-dd",
    "dd-mm-yyyy": "dd-MM-yyyy",
    "MMM yyyy": "MMM yyyy",
    "MMMM yyyy": "MMMM yyyy",
    "year": "yyyy",
}


def as_number(col: Column, dtype: T.DataType) -> Column:
    """A finite double, or null; text is read as a number where it is one."""
    if is_text(dtype):
        text = F.trim(col)
        return F.when(text.rlike(NUMBER), text.try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    if not is_numeric(dtype):
        return F.lit(None).cast("double")
    number = col.cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        limit = F.lit(float("inf"))
        return F.when(~F.isnan(number) & (F.abs(number) != limit), number)
    return number


def _exact(col: Column, dtype: T.DataType) -> Column:
    """The number as a decimal, so that formatting rounds halves away from zero."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return col.cast("decimal(38,10)")
    return as_number(col, dtype).try_cast("decimal(38,10)")


def _grouped(value: Column, digits: int) -> Column:
    """Thousands separators and at most ``digits`` decimals, trailing zeros dropped."""
    fixed = F.format_number(F.round(value, digits), digits)
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return trimmed if digits else fixed


def number_text(col: Column, dtype: T.DataType, fmt: str) -> Column:
    """A number as integer, decimal, currency, percentage or thousands text."""
    value = _exact(col, dtype)
    if fmt == "integer":
        shown = F.format_number(F.round(value, 0), 0)
    elif fmt == "decimal":
        shown = F.format_number(F.round(value, 2), 2)
    elif fmt == "currency":
        amount = F.format_number(F.round(F.abs(value), 2), 2)
        sign = F.when(value < 0, F.lit("-$")).otherwise(F.lit("$"))
        shown = F.concat(sign, amount)
    elif fmt == "percentage":
        shown = F.concat(_grouped(value * F.lit(100), 2), F.lit("%"))
    elif fmt == "thousands":
        shown = _grouped(value, 3)
    else:
        raise ValueError(f"unknown number format: {fmt}")
    shown = F.coalesce(shown, F.lit(MISSING))
    return F.when(col == "", col).otherwise(shown) if is_text(dtype) else shown


def date_text(col: Column, dtype: T.DataType, fmt: str) -> Column:
    """A date in one of the named formats."""
    ts = as_timestamp(col, dtype)
    if fmt == "quarter":
        shown = F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string"))
    elif fmt in _DATE_PATTERNS:
        shown = F.date_format(ts, _DATE_PATTERNS[fmt])
    else:
        raise ValueError(f"unknown date format: {fmt}")
    shown = F.coalesce(shown, F.lit(MISSING))
    return F.when(col == "", col).otherwise(shown) if is_text(dtype) else shown


def dash_missing(col: Column, dtype: T.DataType) -> Column:
    """The cell as text, a dash where it is null or not finite."""
    text = col.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.when(as_number(col, dtype).isNotNull(), text)
    return F.coalesce(text, F.lit(MISSING))
