"""Conditional flags over the cells of a result frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pivotlake.functions.formats import as_number
from pivotlake.functions.names import is_numeric, q
from pivotlake.session import materialise
from pivotlake.spec import Rule

# Rank selection: pieces per narrowing step, and distinct values that are sorted at last.
_PIECES = 256
_VALUES_SORTED = 50_000
# Duplicates: values with more rows than this are hot, the most frequent ones first. Any
# other value has fewer rows, or less than one in _HOT_VALUES of all.
_HOT_ROWS = 1_000_000
_HOT_VALUES = 1000
_DEAL = 1024


def compare_flag(df: DataFrame, rule: Rule) -> Column:
    """``gt`` and ``lt`` compare numbers; ``eq`` does where both sides are numbers, and
    compares text forms otherwise."""
    col, dtype = q(rule.field), df.schema[rule.field].dataType
    if rule.type == "eq" and is_numeric(dtype) and _number(rule.value) is not None:
        return F.coalesce(as_number(col, dtype) == _number(rule.value), F.lit(False))
    if rule.type == "eq":
        flag = col.cast("string") == F.lit(str(rule.value))
        return F.coalesce(flag & (col.cast("string") != ""), F.lit(False))
    value = float(rule.value)
    number = as_number(col, dtype)
    return F.coalesce(number > value if rule.type == "gt" else number < value, F.lit(False))


def _number(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def _leaf(df: DataFrame) -> Column:
    """Whether a row is a leaf row; subtotals and totals have no rank and no duplicates."""
    return F.col("row_kind") == "leaf" if "row_kind" in df.columns else F.lit(True)


def nth_value(values: DataFrame, column: str, share: float, top: bool) -> float | None:
    """The n-th best value, n being the given share of all values rounded up and at
    least one; None without values.

    Exact at any size: equal values are counted together, and as long as too many
    distinct values are left they are cut at approximate percentiles and only the
    piece that holds rank n is kept. The driver sees a bounded number of piece totals
    and, at the end, a bounded number of values.
    """
    left = materialise(values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    distinct, total = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if not distinct:
        return None
    rank = max(1, math.ceil(total * share))
    while distinct > _VALUES_SORTED:
        steps = F.array(*[F.lit(i / _PIECES) for i in range(1, _PIECES)])
        cuts = sorted(set(left.agg(F.percentile_approx("v", steps, F.lit(10_000))).first()[0]))
        piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut < F.col("v")))
        pieces = left.groupBy(piece.alias("piece")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
        for p in sorted(pieces, key=lambda r: r["piece"], reverse=top):
            if rank <= p["c"]:
                break
            rank -= p["c"]
        left, distinct = left.where(piece == p["piece"]), p["n"]
    for row in left.orderBy(F.desc("v") if top else F.asc("v")).collect():
        if rank <= row["c"]:
            return row["v"]
        rank -= row["c"]


def extreme_flag(df: DataFrame, field: str, name: str, *, top: bool, share: float = 0.1) -> DataFrame:
    """Flag the top or bottom share of a column, ties at the edge included."""
    number = as_number(q(field), df.schema[field].dataType)
    values = df.where(_leaf(df)).select(number.alias("n")).where(F.col("n").isNotNull())
    edge = nth_value(values, "n", share, top)
    if edge is None:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.coalesce(_leaf(df) & (number >= edge if top else number <= edge), F.lit(False)))


def duplicate_flag(df: DataFrame, field: str, name: str) -> DataFrame:
    """Flag cells whose text form occurs more than once among the leaf rows; nulls and
    empty texts never count.

    Values are counted with partial aggregation and the repeated ones are joined
    back. The most frequent values are looked up in a broadcast of bounded size and
    their rows are dealt over partitions by content, so no value makes a hot task.
    """
    text = F.when(_leaf(df), F.nullif(q(field).cast("string"), F.lit("")))
    columns = [q(c) for c in df.columns]
    repeated = materialise(
        df.where(text.isNotNull())
        .groupBy(text.alias("__text"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
    )
    hot = (
        repeated.where(F.col("__n") > _HOT_ROWS)
        .orderBy(F.desc("__n"))
        .limit(_HOT_VALUES)
        .select("__text", F.lit(True).alias("__hot"))
    )
    cold = repeated.select(F.col("__text").alias("__key"), F.lit(0).alias("__deal"), F.lit(True).alias("__hit"))
    looked_up = df.withColumn("__text", text).join(F.broadcast(hot), "__text", "left")
    is_hot = F.col("__hot").isNotNull()
    dealt = looked_up.withColumns(
        {
            "__key": F.when(~is_hot, F.col("__text")),
            "__deal": F.when(is_hot | F.col("__text").isNull(), F.pmod(F.xxhash64(*columns), F.lit(_DEAL)).cast("int")).otherwise(0),
        }
    )
    flag = F.coalesce("__hot", "__hit", F.lit(False)).alias(name)
    return dealt.join(cold, ["__key", "__deal"], "left").select(*columns, flag)


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One boolean column ``flag_<i>_<type>_<field>`` per rule."""
    out = df
    for i, rule in enumerate(rules):
        name = f"flag_{i}_{rule.type}_{rule.field}"
        if rule.type in ("top10", "bottom10"):
            out = extreme_flag(out, rule.field, name, top=rule.type == "top10")
        elif rule.type == "duplicates":
            out = duplicate_flag(out, rule.field, name)
        else:
            out = out.withColumn(name, compare_flag(out, rule))
    return out
