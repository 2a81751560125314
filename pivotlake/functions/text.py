"""Address lists, JSON lists and search text as array and string functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the accepted shape of an address.
ADDRESS = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"

_SPACE = " \t\r\n\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim blanks, tabs and line breaks."""
    return F.btrim(col, F.lit(_SPACE))


def split_addresses(col: Column) -> Column:
    """The addresses of a text split on commas, semicolons and line breaks."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), "[,;\n]+"), strip)
    return F.filter(parts, lambda p: p != "")


def is_address(col: Column) -> Column:
    return col.rlike(ADDRESS)


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of every item, in order."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def invalid_addresses(items: Column) -> Column:
    return F.filter(items, lambda x: ~is_address(x))


def json_list(col: Column) -> Column:
    """A JSON array as texts; nulls, empty items, zeros and false dropped, texts kept as
    they are. Anything but an array is empty."""
    typed = F.try_variant_get(F.try_parse_json(col), "$", "array<variant>")
    # A text "0" differs from the number 0 in its type only.
    is_word = F.transform(typed, lambda x: F.schema_of_variant(x) == "STRING")
    items = F.filter(
        F.from_json(col, "array<string>"),
        lambda x, i: x.isNotNull() & (x != "") & (is_word[i] | ~x.isin("0", "0.0", "false", "[]", "{}")),
    )
    return F.when(F.ltrim(col).startswith("["), F.coalesce(items, F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>")
    )


def haystack(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cols))
