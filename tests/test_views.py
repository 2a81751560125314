from pyspark.sql import functions as F, types as T

import pivotlake.operators.flags as flags
from pivotlake import Display, Rule
from pivotlake.functions.formats import dash_missing, date_text, number_text
from pivotlake.operators.paging import PageIndex, page_index
from pivotlake.operators.view import (
    capped,
    collapse,
    collapse_all,
    export_frame,
    formatted,
    having,
    ordered,
    page,
    quick_search,
    selected_groups,
    tab_separated,
)
from pivotlake.sources.sinks import extract_frame, write_extract, write_tab_separated, write_view
from datetime import datetime
from tests.conftest import rows


def one(spark, value, dtype, fn, fmt):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return rows(df.select(fn(F.col("v"), dtype, fmt)))[0][0]


def test_number_formats(spark):
    def number(value, fmt, dtype=T.DoubleType()):
        return one(spark, value, dtype, number_text, fmt)

    assert number(1234567.5, "integer") == "1,234,568"
    assert number(-1234.5, "integer") == "-1,235"
    assert number(1234.5, "decimal") == "1,234.50"
    assert number(2.675, "decimal") == "2.68"
    assert number(-5.0, "currency") == "-$5.00"
    assert number(0.12345, "percentage") == "12.35%"
    assert number(0.5, "percentage") == "50%"
    assert number(12.0, "percentage") == "1,200%"
    assert number(1234.5678, "thousands") == "1,234.568"
    assert number(1000, "thousands", T.LongType()) == "1,000"
    assert number(None, "decimal") == "—"
    assert number(float("nan"), "decimal") == "—"
    assert number(float("inf"), "thousands") == "—"
    assert number("12", "decimal", T.StringType()) == "12.00"
    assert number("", "decimal", T.StringType()) == ""
    assert number("abc", "decimal", T.StringType()) == "—"


def test_date_formats(spark):
    def text(value, fmt, dtype=T.TimestampNTZType()):
        return one(spark, value, dtype, date_text, fmt)

    when = datetime(2024, 5, 7, 9)
    assert [text(when, f) for f in ("yyyy-mm-dd", "dd-mm-yyyy", "MMM yyyy", "MMMM yyyy", "quarter", "year")] == [
        "2024-05-07",
        "07-05-2024",
        "May 2024",
        "May 2024",
        "2024-Q2",
        "2024",
    ]
    assert text(None, "year") == "—"
    assert text("soon", "year", T.StringType()) == "—"
    assert text("", "year", T.StringType()) == ""


def test_missing_values_show_a_dash(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),)], "v double")
    assert rows(df.select(dash_missing(F.col("v"), T.DoubleType()))) == [("1.5",), ("—",), ("—",)]


def flagged(df, name="f"):
    return sorted(r["k"] for r in df.where(name).collect())


def test_top_tenth_includes_ties(spark, monkeypatch):
    values = [100, 90, 90] + list(range(17))
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int")
    assert flagged(flags.extreme_flag(df, "v", "f", top=True)) == [0, 1, 2]
    assert flagged(flags.extreme_flag(df, "v", "f", top=False)) == [3, 4]
    monkeypatch.setattr(flags, "_VALUES_SORTED", 2)
    assert flagged(flags.extreme_flag(df, "v", "f", top=True)) == [0, 1, 2]
    assert flagged(flags.extreme_flag(df, "v", "f", top=False)) == [3, 4]


def test_narrowing_finds_the_same_rank_as_sorting(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id AS k", "(id * 7919) % 10007 / 3.0 AS v")
    n = 2000
    expected = sorted((r["v"] for r in df.collect()), reverse=True)[n - 1]
    monkeypatch.setattr(flags, "_VALUES_SORTED", 10)
    values = df.selectExpr("double(v) AS n")
    assert abs(flags.nth_value(values, "n", 0.1, True) - float(expected)) < 1e-9


def test_extremes_without_values(spark):
    df = spark.createDataFrame([(1, None)], "k int, v double")
    assert flagged(flags.extreme_flag(df, "v", "f", top=True)) == []


def test_duplicates_and_comparisons(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7), (4, None, 8), (5, "7", 7)], "k int, t string, v int")
    out = flags.apply_rules(
        df, [Rule("t", "duplicates"), Rule("v", "gt", "6"), Rule("t", "lt", 8), Rule("v", "eq", 7), Rule("v", "top10")]
    )
    assert flagged(out, "flag_0_duplicates_t") == [1, 2]
    assert flagged(out, "flag_1_gt_v") == [3, 4, 5]
    assert flagged(out, "flag_2_lt_t") == [5]
    assert flagged(out, "flag_3_eq_v") == [3, 5]
    assert flagged(out, "flag_4_top10_v") == [4]
    assert out.count() == 5


def test_hot_duplicates_are_found_by_look_up(spark, monkeypatch):
    monkeypatch.setattr(flags, "_HOT_ROWS", 3)
    monkeypatch.setattr(flags, "_HOT_VALUES", 1)
    values = ["h"] * 9 + ["g"] * 5 + ["x", "x", "y", None, None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    out = flags.duplicate_flag(df, "t", "f")
    assert out.count() == 19 and flagged(out) == list(range(16))


def test_search_filter_page_and_cap(spark):
    df = spark.createDataFrame([(i, f"Item {i % 3}", i * 10) for i in range(7)], "k int, name string, v int")
    assert [r[0] for r in rows(quick_search(df, "item  1 4"))] == [4]
    assert quick_search(df, "  ").count() == 7
    assert [r[0] for r in rows(having(df, {"v": {"from": 50}}))] == [5, 6]
    order = ordered(df, {"v": "desc"}, ["k"])
    assert [r[0] for r in rows(page(df, order, 1, 3))] == [3, 2, 1]
    assert [(r[0], r[3], r[4]) for r in rows(capped(df, order, 2))] == [(6, 7, True), (5, 7, True)]
    assert rows(capped(df, order, 7))[0][4] is False


def test_collapsing_keeps_totals(spark):
    df = spark.createDataFrame(
        [("a1", "leaf", "a"), ("a", "subtotal", ""), ("b1", "leaf", "b"), ("t", "column_total", None), ("r", "leaf", "")],
        "k string, row_kind string, parent_key string",
    )
    assert [r[0] for r in rows(collapse(df, ["a"]))] == ["a", "b1", "t", "r"]
    assert [r[0] for r in rows(collapse_all(df))] == ["a", "t", "r"]
    assert collapse(df, []).count() == 5
    assert sorted(r[0] for r in rows(collapse(df, df.where("k = 'b1'").select("parent_key")))) == ["a", "a1", "r", "t"]


def test_export_ends_with_the_grand_total(spark):
    view = spark.createDataFrame([("a", 1, None, 1), ("b", 2, 3, 5)], "g string, `x | p` int, `x | q` int, row_total int")
    grand = spark.createDataFrame([(99,)], "sum_x int")
    out = export_frame(view, grand, ["g", "x | p", "x | q", "row_total"], hidden=["x | p"])
    assert rows(out) == [(0, "a", "", "1"), (0, "b", "3", "5"), (1, "", "", "6")]


def test_formatted_cells_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "g string, v double")
    assert rows(formatted(df, Display(number_format={"v": "decimal"}))) == [("a", "1.00"), (None, "2.00"), (None, "3.00")]
    assert rows(selected_groups(df, "g")) == [(2,)] and rows(selected_groups(df, None)) == [(3,)]


def test_tab_separated_cells_have_no_breaks(spark):
    df = spark.createDataFrame([("a\tb", "c\r\nd", None, 1)], "p string, q string, r string, s int")
    assert rows(tab_separated(df)) == [("a b\tc d\t\t1",)]


def test_written_extract_view_and_text(spark, tmp_path):
    df = spark.sql("SELECT 1 AS k, 'x' AS t, TIMESTAMP_NTZ'2024-05-06 07:08:09' AS d, array(1) AS a")
    assert rows(extract_frame(df)) == [(1, "x", "2024-05-06T07:08:09", "[1]")]
    path = write_extract(df, str(tmp_path), datetime(2024, 5, 6, 7, 8))
    assert path.endswith("Pivot_Drilldown_2024-05-06_07-08")
    assert rows(spark.read.option("header", True).csv(path).select("k", "d")) == [("1", "2024-05-06T07:08:09")]
    write_tab_separated(df.select("k", "t"), str(tmp_path / "tsv"))
    assert rows(spark.read.text(str(tmp_path / "tsv"))) == [("1\tx",)]
    write_view(df.select(F.lit(0).alias("line"), "k"), str(tmp_path / "view"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "view"))) == [("1",)]


def test_pages_by_index_are_the_pages_of_the_sorted_view(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 7 AS g", "id AS `a.b`", "CAST(id % 3 AS string) AS `__x`").repartition(5)
    order = [F.desc("g"), F.col("`a.b`")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = page_index(df, order, str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = rows(df.orderBy(*order))
    assert index.total == 1000 and len(index.parts) > 1
    for number, size in ((0, 10), (3, 33), (99, 10), (0, 2000), (30, 33), (31, 33), (0, 0)):
        got = index.page(number, size)
        assert got.columns == df.columns
        assert rows(got) == every[number * size : number * size + size]
    again = PageIndex(spark, str(tmp_path / "index"))
    assert rows(again.slice(995, 50)) == every[995:]
    plan = again.slice(500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan or "__part#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert page_index(df.where("false"), order, str(tmp_path / "none")).page(0, 10).collect() == []
