"""Sums of doubles that do not depend on order: exact integers, rounded once.

A finite double is a whole number times a power of two. The powers are cut into ranges of
``SPAN``; within a range every value becomes a whole number of the range's least power,
and whole numbers are added as decimals, which neither round nor depend on order. How many
ranges a column needs is looked up first: two or three for ordinary data. At the end the
ranges are carried into each other and the leading digits make the double nearest to the
exact sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPAN = 32
_SPAN_SIZE = 1 << SPAN
_WIDE = "decimal(38,0)"
# More bits than a double holds, so that what follows only decides a tie.
_ENOUGH = 1 << 64


@dataclass(frozen=True)
class Ranges:
    """The ranges of powers of two that the values of a column fall into."""

    lowest: int
    count: int


def _finite(x: Column) -> Column:
    return F.when((F.abs(x) < float("inf")) & (x != 0), x)


def _power(x: Column) -> Column:
    """A power of two of which the value is a whole number, of at most 55 bits."""
    return F.floor(F.log2(F.abs(x))).cast("int") - 53


def _scaled(x: Column, by: Column) -> Column:
    """x * 2^by, in two steps because 2^by alone may leave the range of doubles."""
    half = F.floor(by / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), by - half)


def ranges(df: DataFrame, columns: list[Column]) -> list[Ranges]:
    """The ranges needed for each column of doubles, by one scan."""
    found = [F.floor(_power(_finite(c)) / SPAN) for c in columns]
    seen = df.agg(*[a for c in found for a in (F.min(c), F.max(c))]).first()
    return [Ranges(0, 0) if seen[2 * i] is None else Ranges(int(seen[2 * i]), int(seen[2 * i + 1] - seen[2 * i]) + 1) for i in range(len(columns))]


def parts(x: Column, of: Ranges) -> list[Column]:
    """Aggregates: the sum of each range, and the sum of infinite values, null if none."""
    value = _finite(x)
    power = _power(value)
    place = F.floor(power / SPAN)
    whole = _scaled(value, -power).cast("bigint").cast("decimal(20,0)")
    shifted = whole * F.pow(F.lit(2.0), power - place * SPAN).cast("bigint").cast("decimal(10,0)")
    sums = [F.sum(F.when(place == of.lowest + i, shifted)) for i in range(of.count)]
    return [*sums, F.sum(F.when(F.abs(x) == float("inf"), x))]


def rounded(sums: list[Column], infinite: Column, of: Ranges) -> Column:
    """The double nearest to the exact sum, ties to even; infinite if any value was."""
    if not of.count:
        return F.coalesce(infinite, F.lit(0.0))
    size = F.lit(_SPAN_SIZE).cast("decimal(10,0)")
    zero = F.lit(0).cast(_WIDE)
    # Digits from the lowest range upwards, each at least 0 and below the range's size.
    start = F.struct(zero.alias("carry"), F.array().cast(f"array<{_WIDE}>").alias("digits"))

    def carried(state: Column, value: Column) -> Column:
        total = (F.coalesce(value, zero) + state["carry"]).cast(_WIDE)
        digit = F.pmod(total, size).cast(_WIDE)
        return F.struct(((total - digit).cast(_WIDE) / size).cast(_WIDE).alias("carry"), F.concat(F.array(digit), state["digits"]).alias("digits"))

    folded = F.aggregate(F.array(*[s.cast(_WIDE) for s in sums]), start, carried)

    def leading(state: Column, digit: Column) -> Column:
        enough = F.abs(state["n"]) >= F.lit(str(_ENOUGH)).cast(_WIDE)
        return F.struct(
            F.when(enough, state["n"]).otherwise((state["n"] * size).cast(_WIDE) + digit).cast(_WIDE).alias("n"),
            (state["rest"] | (enough & (digit != zero))).alias("rest"),
            (state["left"] + enough.cast("int")).alias("left"),
        )

    def finish(state: Column) -> Column:
        # Twice the leading digits, odd where something follows them: never a tie then.
        twice = (state["n"] * F.lit(2).cast("decimal(1,0)")).cast(_WIDE) + state["rest"].cast("int").cast("decimal(1,0)")
        power = (F.lit(of.lowest) + state["left"]) * SPAN - 1
        return _scaled(twice.cast(_WIDE).cast("double"), power)

    first = F.struct(folded["carry"].alias("n"), F.lit(False).alias("rest"), F.lit(0).alias("left"))
    exact = F.aggregate(folded["digits"], first, leading, finish)
    return F.when(infinite.isNotNull(), infinite).otherwise(exact)


def exact_sum(df: DataFrame, x: Column) -> DataFrame:
    """One row: the exact sum of a column of doubles, rounded once; NaN and null count as 0."""
    value = F.when(~F.isnan(x), x)
    (of,) = ranges(df, [value])
    states = df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts(value, of))])
    *sums, infinite = [F.col(c) for c in states.columns]
    return states.select(rounded(sums, infinite, of).alias("sum"))

