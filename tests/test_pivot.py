import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pivotlake import DefinitionError, Measure, PivotError, PivotSpec, Totals, pivot
from pivotlake.operators.exact import exact_sum
from pivotlake.plans.compile import pivot_cells
from tests.conftest import rows

PLAIN = Totals(row=False)


def test_sum_of_nothing_is_zero_and_null_groups_are_blank(nulls5):
    result = pivot(nulls5, PivotSpec(rows=["Region"], values=["Amt"]))
    assert result.columns == ["Region", "sum_Amt"]
    assert rows(result.rows) == [("(blank)", 4.0), ("N", 3.0), ("S", 0.0)]


def test_groups_without_any_value_vanish_before_widening(nulls5):
    spec = PivotSpec(
        rows=["Region"], columns=["Status"], values=[{"field": "Amt", "aggregation": "average"}], totals=PLAIN
    )
    result = pivot(nulls5, spec)
    assert result.columns == ["Region", "Amt | Closed", "Amt | Open"]
    assert rows(result.rows) == [("(blank)", 0.0, 4.0), ("N", 2.0, 1.0)]


def test_a_second_measure_keeps_a_group_whose_first_is_null(nulls5):
    spec = PivotSpec(rows=["Region"], values=[{"field": "Amt", "aggregation": "average"}, "Q"])
    assert rows(pivot(nulls5, spec).rows)[-1] == ("S", 0.0, 8)


def test_missing_cells_are_zero_and_row_total_adds_the_cells(nulls5):
    result = pivot(nulls5, PivotSpec(rows=["Region"], columns=["Status"], values=["Q"]))
    assert result.columns == ["Region", "Q | Closed", "Q | Open", "row_total"]
    assert rows(result.rows) == [("(blank)", 0, 4, 4), ("N", 2, 1, 3), ("S", 5, 3, 8)]


def test_headers_use_labels_once_a_field_has_two_aggregations(nulls5):
    spec = PivotSpec(
        rows=["Region"],
        columns=["Status"],
        values=["Q", {"field": "Q", "aggregation": "average"}, {"field": "Amt", "aggregation": "max", "label": "top"}],
    )
    result = pivot(nulls5, spec)
    assert result.columns == [
        "Region",
        "top | Closed",
        "top | Open",
        "average_Q | Closed",
        "average_Q | Open",
        "sum_Q | Closed",
        "sum_Q | Open",
    ]
    assert result.rows.columns == result.columns


def test_grand_total_is_a_true_average_over_filtered_rows(nulls5):
    spec = PivotSpec(
        rows=["Region"], values=[{"field": "Amt", "aggregation": "average"}, "Q"], filters={"Status": "Open"}
    )
    assert rows(pivot(nulls5, spec).grand) == [(2.5, 8)]
    off = pivot(nulls5, PivotSpec(rows=["Region"], values=["Q"], totals=Totals(grand=False)))
    assert rows(off.grand) == [(None,)]


def test_counts_before_and_after_filters(nulls5):
    spec = PivotSpec(rows=["Region"], columns=["Status"], values=["Q"], filters={"Region": {"notIn": ["N"]}})
    assert rows(pivot(nulls5, spec).counts) == [(5, 3, 2)]
    assert rows(pivot(nulls5, spec).statistics) == [(5, 3, 2, "tabular", "", "sum(Q)")]


def test_global_pivot_and_its_empty_form(nulls5):
    spec = PivotSpec(values=["Amt", {"field": "Amt", "aggregation": "count"}])
    assert rows(pivot(nulls5, spec).rows) == [(7.0, 3)]
    assert rows(pivot(nulls5, PivotSpec(values=["Amt"], filters={"Region": []})).rows) == []


def test_no_values_counts_the_first_column_even_when_it_is_a_row_field(nulls5):
    result = pivot(nulls5, PivotSpec(rows=["Region"]))
    assert rows(result.rows) == [("(blank)", 0), ("N", 2), ("S", 2)]
    assert result.aggregations == [{"field": "Region", "aggregation": "count", "label": "count"}]


def test_columns_only_gives_one_row_per_measure(nulls5):
    spec = PivotSpec(columns=["Status"], values=["Q", {"field": "Amt", "aggregation": "min"}])
    result = pivot(nulls5, spec)
    assert result.columns == ["measure", "Closed", "Open"]
    assert rows(result.rows) == [("min_Amt", 2.0, 1.0), ("sum_Q", 7.0, 8.0)]


def test_average_of_dates_and_text_missing_cells(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('a', 'x', TIMESTAMP_NTZ'2024-01-01 00:00:00'), "
        "('a', 'x', TIMESTAMP_NTZ'2024-01-02 00:00:00'), ('b', 'y', TIMESTAMP_NTZ'2024-03-01 00:00:00') t(k, c, d)"
    )
    result = pivot(df, PivotSpec(rows=["k"], columns=["c"], values=[{"field": "d", "aggregation": "average"}]))
    got = [[str(v) if v is not None else None for v in r] for r in rows(result.rows)]
    assert got == [["a", "2024-01-01 12:00:00", None], ["b", None, "2024-03-01 00:00:00"]]


def test_iso_weeks_and_bad_dates(spark):
    df = spark.createDataFrame(
        [("2024-12-30",), ("2021-01-03",), (None,), ("bad",), ("1/5/2024",), ("20240",)], "d string"
    )
    spec = PivotSpec(rows=["d"], values=[Measure("d", "count", "n")], date_grouping={"d": "week"})
    result = pivot(df, spec)
    assert result.columns == ["d_week", "n"]
    assert rows(result.rows) == [("(blank)", 2), ("2020-W53", 1), ("2024-W01", 1), ("2025-W01", 1)]


def test_sorting_is_stable_and_nulls_come_last(spark):
    df = spark.createDataFrame([("b", 1, 5), ("a", 2, 5), ("c", None, 7)], "k string, n int, v int")
    by_value = pivot(df, PivotSpec(rows=["k"], values=["v"], sorting={"sum_v": "desc"}))
    assert [r[0] for r in rows(by_value.rows)] == ["c", "a", "b"]
    by_number = pivot(df, PivotSpec(rows=["n", "k"], values=["v"], sorting={"n": "descending"}))
    assert [r[0] for r in rows(by_number.rows)] == [2, 1, None]


def test_numeric_groups_keep_their_type_unless_text_is_asked_for(spark):
    df = spark.createDataFrame([(1, 5), (None, 7)], "n int, v int")
    assert rows(pivot(df, PivotSpec(rows=["n"], values=["v"])).rows) == [(1, 5), (None, 7)]
    asked = PivotSpec(rows=["n"], values=["v"], blank_as_text=True)
    assert rows(pivot(df, asked).rows) == [("(blank)", 7), ("1", 5)]


def test_subtotals_follow_their_group_and_column_total_is_last(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "y", 3), ("b", "x", 5), ("a", "x", 2)], "g string, h string, v int"
    )
    spec = PivotSpec(
        rows=["g", "h"],
        values=["v", {"field": "v", "aggregation": "average"}],
        totals=Totals(subtotals=True, column=True),
    )
    assert rows(pivot(df, spec, markers=True).rows) == [
        ("a", "x", 1.5, 3, "leaf", 1, "a"),
        ("a", "y", 3.0, 3, "leaf", 1, "a"),
        ("a", "", 2.25, 6, "subtotal", 0, ""),
        ("b", "x", 5.0, 5, "leaf", 1, "b"),
        ("b", "", 5.0, 5, "subtotal", 0, ""),
        ("Column Total", "", 9.5 / 3, 11, "column_total", None, None),
    ]


def test_subtotals_stay_with_their_prefix_when_sorted_by_value(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 5), ("a", "y", 9)], "g string, h string, v int")
    spec = PivotSpec(
        rows=["g", "h"], values=["v"], sorting={"sum_v": "desc", "g": "desc"}, totals=Totals(subtotals=True)
    )
    assert [r[:3] for r in rows(pivot(df, spec).rows)] == [
        ("b", "x", 5),
        ("b", "", 5),
        ("a", "y", 9),
        ("a", "x", 1),
        ("a", "", 10),
    ]


def test_a_null_key_is_not_taken_for_a_total(spark):
    df = spark.createDataFrame([(1, None, 2), (None, None, 3)], "g int, h int, v int")
    spec = PivotSpec(rows=["g", "h"], values=["v"], totals=Totals(subtotals=True, column=True))
    kinds = [(r[2], r[3]) for r in rows(pivot(df, spec).rows)]
    assert sorted(kinds) == [(2, "leaf"), (2, "subtotal"), (3, "leaf"), (3, "subtotal"), (5, "column_total")]


def test_compact_layout_with_subtotals(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 3)], "g string, h string, v int")
    spec = PivotSpec(rows=["g", "h"], values=["v"], layout="compact", totals=Totals(subtotals=True, column=True))
    result = pivot(df, spec, markers=True)
    assert result.columns == ["Rows", "sum_v"]
    assert rows(result.rows) == [
        ("a / (blank)", 3, "leaf", 1, "a"),
        ("a / x", 1, "leaf", 1, "a"),
        ("a", 4, "subtotal", 0, ""),
        ("Column Total", 4, "column_total", None, None),
    ]


def test_repeated_labels_fill_empty_cells_but_not_blank_groups(spark):
    df = spark.createDataFrame(
        [("a", "p", "x", 1), ("a", "q", "", 2), ("b", None, "y", 3), ("b", "", "z", 4)],
        "g string, h string, i string, v int",
    )
    spec = PivotSpec(rows=["g", "h", "i"], values=["v"], totals=Totals(repeat_labels=True))
    assert rows(pivot(df, spec).rows) == [
        ("a", "p", "x", 1),
        ("a", "q", "x", 2),
        ("b", "q", "z", 4),
        ("b", "(blank)", "y", 3),
    ]


def test_names_with_dots_blanks_pipes_and_quotes(spark):
    df = spark.createDataFrame([("p | q", "1", 2), ("p", "q`", 3)], "`a.b` string, `x y` string, `v``w` int")
    result = pivot(df, PivotSpec(rows=["a.b"], columns=["x y", "a.b"], values=["v`w"]))
    assert result.columns == ["a.b", "v`w | 1 | p | q", "v`w | q` | p", "row_total"]
    assert rows(result.rows) == [("p", 0, 3, 3), ("p | q", 2, 0, 2)]


def test_column_keys_that_show_the_same_text_stay_apart(spark):
    df = spark.createDataFrame([("a | b", "c", 1), ("a", "b | c", 2)], "m string, n string, v int")
    result = pivot(df, PivotSpec(columns=["m", "n"], values=["v"]))
    assert result.columns == ["measure", "a | b | c", "a | b | c (2)", "row_total"]
    assert rows(result.rows) == [("sum_v", 2, 1, 3)]


def test_only_present_combinations_appear(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "g string, h string, v int")
    assert len(rows(pivot(df, PivotSpec(rows=["g", "h"], values=["v"])).rows)) == 2


def test_cell_estimate_and_its_bound(nulls5):
    spec = PivotSpec(rows=["Region"], columns=["Status"], values=["Q", "Amt"])
    assert rows(pivot_cells(pivot(nulls5, spec))) == [(3, 2, 2, 12)]
    with pytest.raises(PivotError, match="12"):
        pivot(nulls5, spec, max_cells=11)


@pytest.mark.parametrize(
    "spec",
    [
        PivotSpec(rows=["nope"]),
        PivotSpec(values=[Measure("Region", "sum")]),
        PivotSpec(values=[Measure("Q", "median")]),
        PivotSpec(values=["Q"], layout="wide"),
        PivotSpec(values=["Q", "Q"]),
        PivotSpec(values=["Q"], date_grouping={"Q": "hour"}),
        PivotSpec(values=["Q"], filters={"nope": 1}),
    ],
)
def test_definitions_that_cannot_be_computed(nulls5, spec):
    with pytest.raises(DefinitionError):
        pivot(nulls5, spec)


def test_sum_of_dates_is_refused(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d")
    with pytest.raises(PivotError, match="numeric"):
        pivot(df, PivotSpec(values=["d"]))


def test_json_form(nulls5):
    spec = PivotSpec.from_json(
        '{"rows":["Region"],"values":["Q",{"field":"Amt","aggregation":"MAX"}],"totals":{"showGrandTotals":"false"},'
        '"displayOptions":{"conditionalFormats":[{"field":"Q","type":"gt","value":3}]}}'
    )
    assert spec.display.rules[0].value == 3 and not spec.totals.grand
    assert pivot(nulls5, spec).columns == ["Region", "max_Amt", "sum_Q"]


def test_raw_rows_are_scanned_once_for_a_column_pivot(nulls5):
    result = pivot(nulls5, PivotSpec(rows=["Region"], columns=["Status"], values=["Q"], totals=Totals(column=True)))
    plan = result.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "LocalRelation" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spec = PivotSpec(
        rows=["o_orderstatus"],
        values=["o_totalprice"],
        filters={"o_orderdate": {"from": "1996-01-01"}, "o_orderkey": {"in": ["5", 7, "x"]}},
    )
    plan = pivot(df, spec).rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "In(o_orderkey" in plan
    assert "o_orderpriority" not in plan


def test_totals_over_sparse_cells(spark):
    """Every aggregation against totals over cells filled with zeros, in plain Python."""
    draw = random.Random(4)
    data = [
        (draw.choice("ab"), draw.randrange(6), draw.randrange(9), draw.choice([None, *range(-5, 0)]), draw.choice([None, "x", "y"]), datetime(2024, 1, draw.randrange(1, 29)))
        for _ in range(60)
    ]
    df = spark.createDataFrame(data, "g string, h int, k int, v bigint, s string, d timestamp_ntz")
    measures = [("v", "count"), ("v", "max"), ("v", "average"), ("v", "min"), ("v", "sum"), ("s", "count"), ("d", "max"), ("d", "average")]
    spec = PivotSpec(rows=["g", "h"], columns=["k"], values=[{"field": f, "aggregation": a} for f, a in measures], totals=Totals(subtotals=True, column=True))
    result = pivot(df, spec)
    got = {(r.row_kind, r["g"], r["h"]): r for r in result.rows.collect()}

    def fold(kind, values):
        values = [x for x in values if x is not None]
        if kind == "count":
            return len(values)
        if kind == "sum":
            return sum(values)
        if not values:
            return None
        if kind == "average" and isinstance(values[0], datetime):
            epoch = datetime(1970, 1, 1)
            return epoch + sum((x - epoch for x in values), timedelta()) // len(values)
        return {"average": lambda: sum(values) / len(values), "min": lambda: min(values), "max": lambda: max(values)}[kind]()

    place = {"v": 3, "s": 4, "d": 5}
    leaves = sorted({r[:2] for r in data})
    keys = sorted({r[2] for r in data})
    assert len(got) == len(leaves) + 2 + 1
    for field, kind in measures:
        for k in keys:
            cell = {leaf: fold(kind, [r[place[field]] for r in data if r[:2] == leaf and r[2] == k]) for leaf in leaves}
            if field != "d":
                cell = {leaf: 0 if x is None else x for leaf, x in cell.items()}
            header = next(c.header for c in result.cells if c.measure.field == field and c.measure.aggregation == kind and c.header.endswith(f" | {k}"))
            again = "sum" if kind == "count" else kind
            for leaf in leaves:
                assert got["leaf", *leaf][header] == cell[leaf]
            near = pytest.approx if field != "d" else lambda x: x
            for g in "ab":
                assert got["subtotal", g, None][header] == near(fold(again, [x for leaf, x in cell.items() if leaf[0] == g]))
            assert got["column_total", "Column Total", None][header] == near(fold(again, cell.values()))



def test_counts_ride_along_with_the_one_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 5 AS g", "id % 3 AS k", "id AS v", "CAST(id % 7 AS string) AS f").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for spec in (
        PivotSpec(rows=["g"], values=["v"], filters={"f": "3"}),
        PivotSpec(rows=["g"], columns=["k"], values=["v"], filters={"f": ["3", "4"], "v": {"from": 100}}),
        PivotSpec(values=["v"], filters={"f": "3"}),
        PivotSpec(rows=["g"], values=[{"field": "v", "aggregation": "max"}], filters={"f": "none"}),
    ):
        plain, along = pivot(df, spec), pivot(df, spec, count_source=True)
        assert rows(along.rows) == rows(plain.rows) and rows(along.grand) == rows(plain.grand)
        assert rows(along.counts) == rows(plain.counts) and rows(along.counts)[0][0] == 1000
        for frame in (along.rows, along.grand, along.counts):
            assert "FileScan" not in frame._jdf.queryExecution().executedPlan().toString()


def test_switches_of_a_definition():
    on = lambda value: PivotSpec.from_json({"rows": ["a"], "values": ["b"], "totals": {"showSubtotals": value}}).totals.subtotals
    assert [on(v) for v in (True, 1, "1", "true", " Yes ", "ON")] == [True] * 6
    assert [on(v) for v in (False, 0, "0", "false", "no", "off", "", None)] == [False] * 8
    for odd in ("maybe", 2, [], 1.5):
        with pytest.raises(PivotError):
            on(odd)


def _exact(values):
    values = [x for x in values if x is not None and x == x]
    return math.inf if math.inf in values else float(sum(map(Fraction, values)))


def test_exact_sums_of_any_doubles(spark):
    draw = random.Random(1)
    cases = [[0.1] * 10, [1e16, 1.0, -1e16], [1e308, 1e308, -1e308], [5e-324] * 3, [1e300, 1e-300, -1e300], [0.0, -0.0, None], [2.0**53, 1.0]]
    cases += [[2.0**53, 1.0, 2.0**-60], [-(2.0**53), -1.0, -(2.0**-60)], [-(2.0**53), -1.0], [math.inf, 1.0], [1.5, None, math.nan]]
    cases += [[draw.uniform(-1, 1) * 10 ** draw.randrange(-20, 20) for _ in range(500)], [math.ldexp(draw.uniform(-1, 1), draw.randrange(-1074, 1000)) for _ in range(300)]]
    for case in cases:
        df = spark.createDataFrame([(x,) for x in case], "x double")
        assert exact_sum(df, F.col("x")).first()[0] == _exact(case), case[:5]
    # Each case as a group of one column, with the ranges of all.
    df = spark.createDataFrame([(i, i % 2, x) for i, case in enumerate(cases) for x in case], "g int, k int, x double")
    spec = PivotSpec(rows=["g"], values=["x", {"field": "x", "aggregation": "average"}])
    for n in (1, 8, 61):
        result = pivot(df.repartition(n), spec, exact_sums=True)
        assert {r.g: r.sum_x for r in result.rows.collect()} == {i: _exact(case) for i, case in enumerate(cases)}
        assert result.grand.first()["sum_x"] == math.inf
    wide = pivot(df.where("g < 9"), PivotSpec(rows=["g"], columns=["k"], values=["x"], totals=Totals(row=False)), exact_sums=True)
    got = {r[0]: r[1 + r[0] % 2] for r in wide.rows.collect()}
    assert got == {i: _exact(case) for i, case in enumerate(cases[:9])}
    mean = {r.g: r.average_x for r in pivot(df.where("g = 0"), spec, exact_sums=True).rows.collect()}
    assert mean == {0: _exact([0.1] * 10) / 10}


def test_sums_of_whole_numbers_do_not_overflow(spark):
    df = spark.createDataFrame([("a", 2**63 - 1, 1), ("a", 2**63 - 1, 2), ("b", -(2**63), 3), ("b", None, None)], "g string, v bigint, n int")
    spec = PivotSpec(rows=["g"], values=["v", "n"])
    result = pivot(df, spec, exact_sums=True)
    assert [(r.g, int(r.sum_v), int(r.sum_n)) for r in result.rows.collect()] == [("a", 2**64 - 2, 3), ("b", -(2**63), 3)]
    assert int(result.grand.first()["sum_v"]) == 2**63 - 2
