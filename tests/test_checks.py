import pytest

from pivotlake import Display, Measure, PivotError, PivotSpec, Rule
from pivotlake.plans.checks import check_definitions, check_size, check_spec, to_json
from pivotlake.sources.catalog import register_tables
from tests.conftest import rows

SPECS = [
    PivotSpec(rows=["Region"], columns=["gone"], values=["Q", Measure("Region", "sum")], layout="wide"),
    PivotSpec(
        filters={"nope": 1},
        values=[Measure("Amt", "median"), "missing"],
        sorting={"Q": "up", "zzz": "asc"},
        date_grouping={"Q": "hour", "lost": "day"},
    ),
    PivotSpec(
        display=Display(
            number_format={"Q": "roman", "a": "integer"},
            date_format={"Q": "yy"},
            rules=[Rule("", "gt", 1), Rule("Q", "gt"), Rule("x", "nice", 1), Rule("Q", "top10")],
            frozen=["f"],
            hidden=["Q", "h"],
        )
    ),
    PivotSpec(rows=["Region"], values=[Measure("Amt", "average")]),
]


def test_batch_and_single_checks_agree(spark, nulls5):
    """The same definitions, checked one by one and as a table of JSON."""
    catalog = register_tables({"nulls5": nulls5})
    table = spark.createDataFrame(
        [(i, 1, "Sheet1", to_json(s)) for i, s in enumerate(SPECS)],
        "definition_id int, dataset_id long, sheet_name string, definition string",
    )
    batch = {}
    for r in check_definitions(table, *catalog).collect():
        batch.setdefault(r["definition_id"], set()).add((r["severity"], r["rule"], r["field"], r["detail"]))
    for i, spec in enumerate(SPECS):
        single = {(f.severity, f.rule, f.field or None, f.detail) for f in check_spec(nulls5, spec)}
        found = {(s, r, f or None, d) for s, r, f, d in batch.get(i, set())}
        assert found == single
    assert 3 not in batch


def test_missing_targets_stop_the_check(spark, nulls5):
    catalog = register_tables({"nulls5": nulls5})
    table = spark.createDataFrame(
        [(1, 5, "Sheet1", '{"rows":["x"]}'), (2, 1, "Other", '{"rows":["x"],"layout":"wide"}'), (3, 1, "Sheet1", "{oops")],
        "definition_id int, dataset_id long, sheet_name string, definition string",
    )
    got = rows(check_definitions(table, *catalog).select("definition_id", "rule").orderBy("definition_id", "rule"))
    assert got == [(1, "dataset_missing"), (2, "layout_unknown"), (2, "sheet_missing"), (3, "definition_malformed")]


def test_bare_names_are_summed(spark, nulls5):
    catalog = register_tables({"nulls5": nulls5})
    table = spark.createDataFrame(
        [(1, 1, "Sheet1", '{"values":["Region","Q",{"field":"Status"}]}')],
        "definition_id int, dataset_id long, sheet_name string, definition string",
    )
    got = check_definitions(table, *catalog).select("rule", "field").orderBy("field")
    assert rows(got) == [("aggregation_not_allowed", "Region"), ("aggregation_not_allowed", "Status")]


def test_size_guards_are_off_unless_given(nulls5):
    check_size(nulls5)
    with pytest.raises(PivotError):
        check_size(nulls5, max_rows=4)
    with pytest.raises(PivotError):
        check_size(nulls5, max_columns=3)
    rules = {f.rule for f in check_spec(nulls5, PivotSpec(), max_rows=4, max_columns=3)}
    assert rules == {"values_missing", "rows_many", "columns_many"}
