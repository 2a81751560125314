from datetime import datetime

import pytest

from pivotlake import PivotError
from pivotlake.functions.dates import bucket, code, label, label_range
from pivotlake.operators.filters import apply_filters, distinct_values, selection_condition
from tests.conftest import rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.sql(
        "SELECT * FROM VALUES (1, 'N', 1.5D, TIMESTAMP_NTZ'2024-01-31 00:00:00', true), "
        "(2, 'S', 2.5D, TIMESTAMP_NTZ'2024-01-31 08:00:00', false), "
        "(3, CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS BOOLEAN)), "
        "(4, '', 4.0D, TIMESTAMP_NTZ'2024-02-01 00:00:00', true) t(k, r, v, d, b)"
    )


def keys(df):
    return sorted(r[0] for r in rows(df.select("k")))


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ({"r": "N"}, [1]),
        ({"r": None}, [3]),
        ({"r": []}, []),
        ({"k": ["1", 2.0]}, [1, 2]),
        ({"k": [1.5]}, []),
        ({"k": {"in": ["x", "3"]}}, [3]),
        ({"r": ["N", None]}, [1, 3]),
        ({"r": {"notIn": ["N"]}}, [2, 3, 4]),
        ({"r": {"notIn": ["N", None]}}, [2, 4]),
        ({"r": {"notIn": []}}, [1, 2, 3, 4]),
        ({"r": {"equals": "S"}}, [2]),
        ({"r": {"contains": "n|s"}}, [1, 2]),
        ({"k": {"contains": "^[12]$"}}, [1, 2]),
        ({"v": {"from": 1.75}}, [2, 4]),
        ({"k": {"from": 1.5, "to": "3"}}, [2, 3]),
        ({"d": {"to": "2024-01-31"}}, [1]),
        ({"d": {"from": "2024-01-31", "to": datetime(2024, 1, 31, 8)}}, [1, 2]),
        ({"b": True}, [1, 4]),
        ({"b": "false"}, [2]),
        ({"r": {"in": ["N"], "notIn": ["N"]}}, [1]),
        ({"r": {"notIn": ["N"]}, "v": {"from": 3}}, [4]),
        ({}, [1, 2, 3, 4]),
        ({"k": {}}, [1, 2, 3, 4]),
    ],
)
def test_filter_forms(df, filters, expected):
    assert keys(apply_filters(df, filters)) == expected


def test_unknown_filter_field(df):
    with pytest.raises(PivotError):
        apply_filters(df, {"nope": 1})


@pytest.mark.parametrize(
    ("selection", "expected"),
    [
        ({"r": "N"}, [1]),
        ({"r": "(blank)"}, [3]),
        ({"k": "(blank)"}, []),
        ({"d_month": "2024-01"}, [1, 2]),
        ({"d": "2024-02"}, [4]),
        ({"d_month": "(blank)"}, [3]),
        ({"k": "2", "nope": 1}, [2]),
        ({"v": "4"}, [4]),
        ({"nope": 1}, []),
        ({}, [1, 2, 3, 4]),
    ],
)
def test_selections(df, selection, expected):
    assert keys(df.where(selection_condition(df, selection, {"d": "month"}))) == expected


def test_distinct_values_skip_blanks(df):
    assert rows(distinct_values(df, "r")) == [("N",), ("S",)]


def test_decimal_literals_are_not_rounded(spark):
    df = spark.sql("SELECT CAST(1.12 AS DECIMAL(10,2)) AS v")
    assert rows(apply_filters(df, {"v": {"from": 1.125}})) == []
    assert len(rows(apply_filters(df, {"v": 1.12}))) == 1


@pytest.mark.parametrize("grain", ["year", "quarter", "month", "week", "day"])
def test_bucket_ranges_agree_with_labels(spark, grain):
    """Selecting a bucket by its range finds the rows that carry its label."""
    days = spark.range(0, 1500).selectExpr("dateadd(DATE'2019-11-20', int(id)) AS d").selectExpr(
        "CAST(d AS TIMESTAMP_NTZ) + INTERVAL '23:59:59.999999' HOUR TO SECOND AS d"
    )
    text = bucket(days["d"], days.schema["d"].dataType, grain)
    by_label = {r[0]: r[1] for r in days.groupBy(text.alias("l")).count().collect()}
    assert days.where(text != label(code(days["d"], grain), grain)).isEmpty()
    for text in sorted(by_label)[:: max(1, len(by_label) // 12)]:
        first, after = label_range(text, grain)
        found = days.where(selection_condition(days, {f"d_{grain}": text}, {"d": grain}))
        assert found.count() == by_label[text], text
        assert first < after


def test_text_that_is_no_label_selects_nothing(df):
    assert label_range("2024-13", "month") is None and label_range("2023-W54", "week") is None
    assert keys(df.where(selection_condition(df, {"d_month": "soon"}, {"d": "month"}))) == []


def test_bucket_selection_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    picked = orders.where(selection_condition(orders, {"o_orderdate": "1996-Q2"}, {"o_orderdate": "quarter"}))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-04-01" in plan
