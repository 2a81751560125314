"""Missing values, odd texts, wide pivots and exclusion at every size."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pivotlake import PivotError, PivotSpec, Totals, pivot
from pivotlake.functions.dates import dated, day_first_columns, parse_timestamp
from pivotlake.functions.text import json_list
from pivotlake.operators.drill import drilldown_many
from pivotlake.operators.filters import apply_filters
from pivotlake.operators.tombstones import TOMBSTONE_SCHEMA, exclude_deleted, key_columns_of
from pivotlake.plans.checks import to_json
from pivotlake.sources.catalog import register_tables
from pivotlake.sources.files import audit_files, listing
from pivotlake.sources.sheets import open_sheet, read_csv
from tests.conftest import rows

NAN = float("nan")


@pytest.fixture(scope="module")
def gappy(spark):
    return spark.createDataFrame([("a", 1.0, 1.0), ("a", NAN, NAN), ("b", NAN, None), ("b", None, 2.0)], "g string, v double, k double")


def test_nan_is_missing(gappy):
    names = ("count", "sum", "average", "min", "max")
    result = pivot(gappy, PivotSpec(rows=["g"], values=[{"field": "v", "aggregation": a} for a in names]))
    assert rows(result.rows.select("g", *[f"{a}_v" for a in names])) == [("a", 1, 1.0, 1.0, 1.0, 1.0), ("b", 0, 0.0, 0.0, 0.0, 0.0)]
    assert sorted(rows(pivot(gappy, PivotSpec(rows=["k"], values=[{"field": "g", "aggregation": "count"}])).rows), key=str) == [(1.0, 1), (2.0, 1), (None, 2)]
    count = lambda f: apply_filters(gappy, f).count()
    assert [count(f) for f in ({"v": None}, {"v": [None, 1.0]}, {"v": {"from": 0}}, {"v": {"to": 5}}, {"v": {"notIn": [1]}}, {"v": NAN})] == [3, 4, 1, 1, 3, 3]


def test_selections_agree_for_any_number(spark):
    df = spark.createDataFrame([("1", 1), ("1.0", 1), ("2", 2)], "t string, n int")
    for selection, found in (({"t": 1.0}, ["1"]), ({"t": "1.0"}, ["1.0"]), ({"n": "1.0"}, ["1", "1.0"]), ({"n": 1.5}, [])):
        (field, value), = selection.items()
        few = drilldown_many(df, PivotSpec(rows=[field]), [selection])
        many = drilldown_many(df, PivotSpec(rows=[field]), [selection] + [{field: f"9{i}"} for i in range(40)])
        frame = drilldown_many(df, PivotSpec(rows=[field]), spark.createDataFrame([(value,)], [field]))
        for one in (few, many, frame):
            assert sorted(r[0] for r in rows(one.rows)) == found


@pytest.mark.parametrize("bounds", [(10, 10), (0, 10), (0, 0)])
def test_tombstones_test_the_same_at_any_size(spark, bounds):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(1, 1)] * 5, "k int, g int")
    keys = df.select("k", *key_columns_of(df)).distinct()
    # Row 1 without a hash, row 2 with another hash, row 3 as it should be.
    dead = keys.where("k IN (1, 2, 3)").withColumn("row_hash", F.when(F.col("k") == 2, F.col("row_hash") + 1).when(F.col("k") == 3, F.col("row_hash")))
    dead = dead.selectExpr("7L AS dataset_id", "'s' AS sheet_name", "source_key", "row_hash")
    left = exclude_deleted(df, dead, 7, "s", broadcast_keys=bounds[0], broadcast_hashes=bounds[1])
    assert sorted(r[0] for r in rows(left.select("k"))) == [0, 2, 4, 5, 6, 7, 8]
    assert exclude_deleted(df, spark.createDataFrame([], TOMBSTONE_SCHEMA), 7, "s").count() == 14


def test_wide_totals(spark):
    df = spark.createDataFrame([("a", "x", 1, 1.0), ("a", "x", 2, 3.0), ("a", "y", 2, 5.0), ("b", "x", 2, 7.0)], "g string, h string, c int, v double")
    spec = PivotSpec(rows=["g", "h"], columns=["c"], values=[{"field": "v", "aggregation": "average"}], totals=Totals(subtotals=True, column=True))
    got = {r[:2] + (r[-1],): r[2:-1] for r in rows(pivot(df, spec).rows)}
    # Missing cells are zeros and take part in the means of totals.
    assert got[("a", "y", "leaf")] == (0.0, 5.0, 5.0)
    assert got[("a", "", "subtotal")] == (0.5, 4.0, 4.5)
    assert got[("Column Total", "", "column_total")] == (1 / 3, 5.0, pytest.approx(16 / 3))
    with pytest.raises(PivotError):
        pivot(df, spec, max_columns=1)


def test_counts_of_every_shape(gappy):
    count = lambda **k: rows(pivot(gappy, PivotSpec(values=[{"field": "v", "aggregation": "max"}], **k)).counts)[0]
    assert count(rows=["g"]) == (4, 4, 1)
    assert count(rows=["g"], filters={"g": "b"}) == (4, 2, 0)
    assert count(columns=["g"]) == (4, 4, 1)
    assert count() == (4, 4, 1)


def test_dates_in_words_and_numbers(spark):
    at = datetime(2024, 1, 5)
    texts = ["2024-01-05", "2024/1/5", "1/5/2024", "5-Jan-2024", "Jan 5, 2024", "January 5 2024", "5 january 2024", "20240105", " 2024/01/05 "]
    texts = [(t, at) for t in texts] + [("1/5/2024 3:04 PM", at.replace(hour=15, minute=4)), ("2024/01/05 03:04:05pm", at.replace(hour=15, minute=4, second=5))]
    texts += [(t, None) for t in ("20241399", "5-Foo-2024", "Maybe 5, 2024", "1995", "12345", "13/40/2024", "", "x")] + [(None, None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(parse_timestamp(F.col("t")))
    assert [r[0] for r in rows(df)] == [want for _, want in texts]


def test_odd_spellings_of_dates(spark):
    at = datetime(2024, 1, 5)
    texts = [(t, at) for t in ("1/5/24", "01-05-2024", "1.5.2024", "Mon, 5 Jan 2024", "friday 5 January 2024", "Wednesday, January 5, 2024", "Sat Jan 5 2024", "5-Jan-24", "2024.1.5")]
    texts += [(t, at.replace(day=1)) for t in ("Jan 2024", "January, 2024", "2024-01", "2024-1")]
    texts += [("31/12/2023", datetime(2023, 12, 31)), ("12/31/69", datetime(1969, 12, 31)), ("12-31-68", datetime(2068, 12, 31))]
    texts += [("2024-01-05T10:00:00+02:00", at.replace(hour=8)), ("2024-01-05 00:30:00-0130", at.replace(hour=2)), ("2024-01-05T10:00:00Z", at.replace(hour=10)), ("5 Jan 2024 10:00 +02:00", at.replace(hour=8))]
    texts += [(t, None) for t in ("1/5-2024", "1/5/202", "32/13/2024", "13.13.13", "3.14", "1.5", "2024-13", "march", "Monday", "May I", "1-2", "10:30")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", parse_timestamp(F.col("t")))
    assert rows(df) == texts
    day_first = spark.createDataFrame([(t,) for t in ("5/1/24", "05-01-2024", "1/31/2024", "5.1.2024 10:00")], "t string").select(parse_timestamp(F.col("t"), True))
    assert [r[0] for r in rows(day_first)] == [at, at, datetime(2024, 1, 31), at.replace(hour=10)]


def test_columns_vote_for_the_order_of_day_and_month(spark):
    data = [("1/2/2024", "1/2/2024", "x", "13/13/2024"), ("13/2/2024", "2/13/2024", None, "1/1/24"), ("25.2.24", "13/2/2024", "", "2024-01-01"), ("2/25/24", "3-14-24", "5 Jan 2024", "31/12/2023")]
    df = spark.createDataFrame(data, "d string, m string, none string, one string")
    assert day_first_columns(df, df.columns) == {"d": True, "m": False, "none": False, "one": True}
    assert [r.d.isoformat()[:10] for r in dated(df, ["d"]).collect()] == ["2024-02-01", "2024-02-13", "2024-02-25", "2024-02-25"]


def test_csv_columns_of_days_first(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k,d\n1,3/4/2024\n2,25/4/2024\n3,\n")
    assert [r.d for r in read_csv(spark, str(tmp_path / "s.csv")).orderBy("k").collect()] == [datetime(2024, 4, 3), datetime(2024, 4, 25), None]


def test_json_words(spark):
    df = spark.createDataFrame([('["0", 0, "false", false, null, "", "a", 1, [], {}]',), ("{}",), ("no",), (None,)], "j string")
    assert [r[0] for r in rows(df.select(json_list(F.col("j"))))] == [["0", "false", "a", "1"], [], [], []]


def test_saved_definition_keeps_blank_as_text():
    assert PivotSpec.from_json(to_json(PivotSpec(blank_as_text=True))).blank_as_text


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "empty+1.csv").write_bytes(b"")
    (tmp_path / "full.csv").write_text("x\n1\n")
    files = {r.path.rsplit("/", 1)[-1]: r.length for r in listing(spark, str(tmp_path)).collect()}
    assert files == {"empty+1.csv": 0, "full.csv": 4}
    verdicts = {r.path.rsplit("/", 1)[-1]: r.verdict for r in audit_files(spark, str(tmp_path)).collect()}
    assert verdicts == {"empty+1.csv": "not_text", "full.csv": "ok"}


def test_sheets_by_catalog_entry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "three"))
    datasets, sheets, _ = register_tables({"three": spark.range(3), "gone": spark.range(1)})
    assert open_sheet(spark, datasets, sheets, 1, str(tmp_path)).count() == 3
    for wrong in ({"dataset_id": 9}, {"dataset_id": 1, "sheet_name": "no"}):
        with pytest.raises(PivotError):
            open_sheet(spark, datasets, sheets, folder=str(tmp_path), **wrong)
