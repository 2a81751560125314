"""Date buckets: a timestamp, date or text column becomes a sortable text label."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pivotlake.functions.names import is_date, q

GRAINS = ("year", "quarter", "month", "week", "day")

_ISO_DATE = r"^\d{4}-\d{1,2}(-\d{1,2}|$)"
# A day, a month and a year in numbers, in an order that the text does not tell.
_THREE = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(.*)$"
# Numbers whose order is plain: year first, or compact; as the parts of an ISO date.
_NUMBERED = (
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
# With a month name: the pattern, and its groups of year, month, day and time; 0 where there is none.
_NAMED = (
    (r"^(\d{1,2})[- ]([A-Za-z]{3,9})\.?[-, ]+(\d{4}|\d{2})(?!\d)(.*)$", (3, 2, 1, 4)),
    (r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})(?!\d)(.*)$", (3, 1, 2, 4)),
    (r"^([A-Za-z]{3,9})\.?[-, ]+(\d{4})$", (2, 1, 0, 0)),
)
_MONTHS = "january february march april may june july august september october november december".split()
_WEEKDAY = r"^(?i)(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,? +(?=[\dA-Za-z])"
_HALF_DAY = r"(?i)(\d) ?([ap]m)$"
_HALF_DAY_FORMATS = ("yyyy-M-d h:mm a", "yyyy-M-d h:mm:ss a")
_OFFSET = r"\d:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})$"

# Fixed value: two digits below this are years of this century, the others of the last.
_CENTURY_TURN = 69


def _full_year(year: Column) -> Column:
    short = F.when(year.try_cast("int") < _CENTURY_TURN, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    return F.when(F.length(year) == 2, short).otherwise(year)


def parse_timestamp(col: Column, day_first: bool | Column = False) -> Column:
    """Text to a zone-free timestamp, null where it is not a date.

    Read are ISO dates, year and month alone, eight digits, year first with slashes or
    dots, dates with an English month name, a weekday before it or not, month name and
    year, and three numbers parted by slashes, dashes or dots, with years of two digits
    or four. Of three numbers the month comes first, or the day with ``day_first``; where
    that gives no date the other order is read. A time may follow, also of 12 hours. A time
    with an offset from UTC, or ``Z``, becomes that moment in UTC.
    """
    prefer_day = day_first if isinstance(day_first, Column) else F.lit(bool(day_first))
    text = F.regexp_replace(F.trim(col.cast("string")), _WEEKDAY, "")
    return _bound(_bound(text, lambda t: _as_iso(t, prefer_day)), _read_iso)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _as_iso(text: Column, prefer_day: Column) -> Column:
    """A date in any spelling as year, month and day, with what follows it; null if none fits."""
    iso = F.when(text.rlike(_ISO_DATE), F.when(F.length(text) <= 7, F.concat(text, F.lit("-01"))).otherwise(text))
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    one, two = part(_THREE, 1), part(_THREE, 3)
    day_leads = F.when(prefer_day, two.try_cast("int") <= 12).otherwise(one.try_cast("int") > 12)
    month_day = F.when(day_leads, F.concat(two, F.lit("-"), one)).otherwise(F.concat(one, F.lit("-"), two))
    iso = iso.when(text.rlike(_THREE), F.concat(_full_year(part(_THREE, 4)), F.lit("-"), month_day, part(_THREE, 5)))
    for pattern, parts in _NUMBERED:
        iso = iso.when(text.rlike(pattern), F.regexp_replace(text, pattern, parts))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for name in {m, m[:3], "sept" if i == 9 else m} for x in (name, i)])
    for pattern, (year, named, number, time) in _NAMED:
        month_number = F.try_element_at(months, F.lower(part(pattern, named))).cast("string")
        day_number = part(pattern, number) if number else F.lit("1")
        made = F.concat(_full_year(part(pattern, year)), F.lit("-"), month_number, F.lit("-"), day_number)
        iso = iso.when(text.rlike(pattern), F.concat(made, part(pattern, time)) if time else made)
    return iso


def _read_iso(iso: Column) -> Column:
    spaced = F.regexp_replace(iso, _HALF_DAY, "$1 $2")
    half = F.coalesce(*[F.try_to_timestamp(spaced, F.lit(f)) for f in _HALF_DAY_FORMATS]).cast("timestamp_ntz")
    # A cast wants seconds in front of an offset, and no blank.
    moment = F.regexp_replace(F.regexp_replace(iso, r"\s+(?=[Zz+-][\d:]*$)", ""), r"([T ]\d{1,2}:\d{2})(?=[Zz+-])", "$1:00")
    absolute = from_micros(F.unix_micros(moment.try_cast("timestamp")))
    return F.when(iso.rlike(_HALF_DAY), half).when(iso.rlike(_OFFSET), absolute).otherwise(iso.try_cast("timestamp_ntz"))


def order_votes(col: Column) -> tuple[Column, Column]:
    """Aggregates over a text column: how many dates can only have the day first, and how
    many only the month. A date whose first two numbers are both at most 12 does not vote."""
    text = F.trim(col.cast("string"))
    found = text.rlike(_THREE)
    one, two = F.regexp_extract(text, _THREE, 1).try_cast("int"), F.regexp_extract(text, _THREE, 3).try_cast("int")
    return F.count_if(found & (one > 12) & (two <= 12)), F.count_if(found & (one <= 12) & (two > 12))


def day_first_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """For text columns whether most of their telling dates have the day first, by one scan.

    A single cell such as 01/05/2024 does not tell its order, a column mostly does. Equal
    votes, and none, mean that the month comes first.
    """
    votes = [v.alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, v in zip(("day", "month"), order_votes(q(c)))]
    if not votes:
        return {}
    counted = df.agg(*votes).first()
    return {c: counted[f"day{i}"] > counted[f"month{i}"] for i, c in enumerate(columns)}


def dated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with text columns read as timestamps, each in the order its dates vote for."""
    first = day_first_columns(df, columns)
    return df.withColumns({c: parse_timestamp(q(c), first[c]) for c in columns})


def as_timestamp(col: Column, dtype: T.DataType) -> Column:
    return col if is_date(dtype) else parse_timestamp(col)


def code(ts: Column, grain: str) -> Column:
    """The bucket of a date as a small number, or a date for days: cheap to compute per
    row, to group by and to shuffle. :func:`label` makes it text afterwards."""
    day = ts.cast("date")
    if grain == "year":
        return F.year(day)
    if grain == "quarter":
        return F.year(day) * 4 + F.quarter(day) - 1
    if grain == "month":
        return F.year(day) * 12 + F.month(day) - 1
    if grain == "week":
        return F.date_part(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)
    if grain == "day":
        return day
    raise ValueError(f"unknown date grain: {grain}")


def label(bucket_code: Column, grain: str) -> Column:
    """The text of a bucket code; null stays null."""

    def digits(number: Column, width: int) -> Column:
        text = number.cast("int").cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))

    if grain == "year":
        return digits(bucket_code, 4)
    if grain == "quarter":
        return F.concat(digits(F.floor(bucket_code / 4), 4), F.lit("-Q"), digits(bucket_code % 4 + 1, 1))
    if grain == "month":
        return F.concat(digits(F.floor(bucket_code / 12), 4), F.lit("-"), digits(bucket_code % 12 + 1, 2))
    if grain == "week":
        return F.concat(digits(F.floor(bucket_code / 100), 4), F.lit("-W"), digits(bucket_code % 100, 2))
    return F.date_format(bucket_code, "yyyy-MM-dd")


# The buckets a single date pattern writes.
_PATTERNS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def bucket(col: Column, dtype: T.DataType, grain: str) -> Column:
    """The label of ``grain`` for each value; null where there is no date."""
    ts = as_timestamp(col, dtype)
    if grain in _PATTERNS:
        return F.date_format(ts, _PATTERNS[grain])
    return label(code(ts, grain), grain)


_LABELS = {
    "year": r"(\d{4})",
    "quarter": r"(\d{4})-Q([1-4])",
    "month": r"(\d{4})-(0[1-9]|1[0-2])",
    "week": r"(\d{4})-W(\d{2})",
    "day": r"(\d{4})-(\d{2})-(\d{2})",
}


def label_range(text: str, grain: str) -> tuple[date, date] | None:
    """The first day of a bucket and the first day after it; None for text that is no
    label. A range is what a scan can skip row groups by."""
    found = re.fullmatch(_LABELS[grain], text)
    if not found:
        return None
    parts = [int(g) for g in found.groups()]
    try:
        if grain == "week":
            start = date.fromisocalendar(*parts, 1)
            return start, start + timedelta(days=7)
        if grain == "day":
            start = date(*parts)
            return start, start + timedelta(days=1)
        months = {"year": 12, "quarter": 3, "month": 1}[grain]
        first = (parts[1] - 1) * months if len(parts) > 1 else 0
        after = parts[0] * 12 + first + months
        return date(parts[0], first + 1, 1), date(after // 12, after % 12 + 1, 1)
    except (ValueError, OverflowError):
        return None


def display_name(field: str, grain: str) -> str:
    return f"{field}_{grain}"


def micros(col: Column) -> Column:
    """Microseconds since 1970 as an exact decimal, free of the session's zone."""
    ts = col.cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts).cast("decimal(20,0)")


def from_micros(value: Column) -> Column:
    """The inverse of :func:`micros`, rounded down to whole microseconds."""
    return F.timestamp_add(
        "MICROSECOND",
        F.floor(value).cast("bigint"),
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
    )
