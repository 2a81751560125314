"""Queries on values that are easy to get wrong: missing numbers, odd texts, wide and
very fine keys, and the whole path from a catalog entry to a pivot."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pivotlake import PivotSpec, Totals, pivot
from pivotlake.errors import PivotError
from pivotlake.functions.dates import dated
from pivotlake.functions.text import json_list
from pivotlake.operators.drill import drilldown, drilldown_many
from pivotlake.operators.filters import apply_filters
from pivotlake.operators.flags import apply_rules
from pivotlake.operators.tombstones import exclude_deleted, key_columns_of
from pivotlake.sources.catalog import register_tables
from pivotlake.sources.profile import profile
from pivotlake.sources.sheets import open_sheet
from pivotlake.spec import Rule
from workload.drilling import _as_tombstones
from workload.registry import query
from workload.tables import SALES_SQL, SALESN_SQL, plain, sales, salesn, table

# Missing values ------------------------------------------------------------------------------


def _gappy(spark, sf_dir):
    """Orders with NaN among whole prices and among the keys."""
    key, nan = F.col("o_orderkey"), F.lit(float("nan"))
    return table(spark, sf_dir, "orders").select(
        key,
        F.when(key % 17 == 0, nan).otherwise((F.col("o_custkey") % 3).cast("double")).alias("k"),
        F.when(key % 13 == 0, nan).otherwise(F.floor("o_totalprice").cast("double")).alias("v"),
    )


_GAPPY_SQL = """gappy AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_custkey % 3 AS DOUBLE) END AS k,
                    CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice) END AS v FROM orders)"""


@query(
    "pivot_nan",
    f"""WITH {_GAPPY_SQL} SELECT k, count(v) AS count_v, sum(v) AS sum_v, sum(v) / count(v) AS average_v,
          min(v) AS min_v, max(v) AS max_v FROM gappy GROUP BY k""",
)
def pivot_nan(spark, sf_dir):
    values = [{"field": "v", "aggregation": a} for a in ("count", "sum", "average", "min", "max")]
    return pivot(_gappy(spark, sf_dir), PivotSpec(rows=["k"], values=values)).rows


@query("filter_null_nan", f"WITH {_GAPPY_SQL} SELECT o_orderkey, k FROM gappy WHERE v IS NULL AND k >= 1")
def filter_null_nan(spark, sf_dir):
    return apply_filters(_gappy(spark, sf_dir), {"v": None, "k": {"from": 1}}).select("o_orderkey", "k")


@query(
    "pivot_avg_big",
    "SELECT o_orderstatus, CAST(sum(1700000000000000000 + o_orderkey) AS DOUBLE) / count(*) AS average_v FROM orders GROUP BY 1",
)
def pivot_avg_big(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("v", F.lit(1_700_000_000_000_000_000) + F.col("o_orderkey"))
    return pivot(df, PivotSpec(rows=["o_orderstatus"], values=[{"field": "v", "aggregation": "average"}])).rows


# Wide and fine keys ----------------------------------------------------------------------------


@query("pivot_sum_double", "SELECT o_orderstatus, sum(o_custkey % 1000) / 1024.0::DOUBLE AS sum_v FROM orders GROUP BY 1")
def pivot_sum_double(spark, sf_dir):
    """A small value between a large one and its negative: any rounding on the way shows."""
    large = F.floor("o_totalprice") * F.lit(2.0**45)
    values = F.array(large, (F.col("o_custkey") % 1000) / F.lit(1024.0), -large)
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.explode(values).alias("v"))
    return pivot(df, PivotSpec(rows=["o_orderstatus"], values=["v"]), exact_sums=True).rows


@query("pivot_sum_big", "SELECT o_orderstatus, CAST(sum(4000000000000000000 + o_orderkey) AS VARCHAR) AS sum_v FROM orders GROUP BY 1")
def pivot_sum_big(spark, sf_dir):
    """Sums beyond eight bytes."""
    df = table(spark, sf_dir, "orders").withColumn("v", F.lit(4_000_000_000_000_000_000) + F.col("o_orderkey"))
    rows = pivot(df, PivotSpec(rows=["o_orderstatus"], values=["v"]), exact_sums=True).rows
    return rows.withColumn("sum_v", F.col("sum_v").cast("string"))


@query(
    "pivot_wide",
    """WITH cells AS (SELECT o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey % 1000 AS k,
                       CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
       numbered AS (SELECT *, dense_rank() OVER (ORDER BY k) AS n FROM cells)
       SELECT coalesce(s, CASE WHEN grouping(s) = 1 THEN 'Column Total' END) AS o_orderstatus,
              CASE WHEN grouping(d) = 1 THEN '' ELSE d END AS o_orderdate_day,
              CASE WHEN grouping(s) = 1 THEN 'column_total' WHEN grouping(d) = 1 THEN 'subtotal' ELSE 'leaf' END AS row_kind,
              CAST(sum(v) AS BIGINT) AS row_total, CAST(sum(v * n) AS BIGINT) AS weighted,
              (SELECT count(DISTINCT k) FROM cells) AS n_columns
       FROM numbered GROUP BY GROUPING SETS ((s, d), (s), ())""",
)
def pivot_wide(spark, sf_dir):
    """Up to a thousand columns with all totals; the cells are checked by a weighted sum."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderstatus", "o_orderdate", (F.col("o_custkey") % 1000).alias("k"), F.floor("o_totalprice").cast("bigint").alias("v")
    )
    spec = PivotSpec(
        rows=["o_orderstatus", "o_orderdate"], columns=["k"], values=["v"], date_grouping={"o_orderdate": "day"},
        totals=Totals(subtotals=True, column=True),
    )
    result = pivot(df, spec)
    cells = [c.header for c in result.cells]
    array = ", ".join(f"`{c}`" for c in cells)
    weighted = f"aggregate(transform(array({array}), (x, i) -> x * (i + 1)), 0L, (a, x) -> a + x)"
    return result.rows.selectExpr(
        "o_orderstatus", "o_orderdate_day", "row_kind", "row_total", f"{weighted} AS weighted", f"{len(cells)}L AS n_columns"
    )


@query(
    "pivot_wide_sparse",
    """WITH cells AS (SELECT o_orderpriority AS p, CAST(floor(o_orderkey / 64) AS BIGINT) AS b, o_custkey % 1000 AS k,
                       max(CAST(floor(o_totalprice) AS BIGINT) - 150000) AS v FROM orders GROUP BY ALL),
       numbered AS (SELECT *, dense_rank() OVER (ORDER BY k) AS n FROM cells),
       spans AS (SELECT p, count(DISTINCT b) AS n_groups FROM cells GROUP BY p),
       totals AS (
         SELECT p, n, CASE WHEN count(*) < (SELECT n_groups FROM spans WHERE spans.p = numbered.p) THEN greatest(max(v), 0) ELSE max(v) END AS v,
                'subtotal' AS row_kind FROM numbered GROUP BY p, n
         UNION ALL
         SELECT 'Column Total', n, CASE WHEN count(*) < (SELECT sum(n_groups) FROM spans) THEN greatest(max(v), 0) ELSE max(v) END, 'column_total'
         FROM numbered GROUP BY n)
       SELECT p AS o_orderpriority, CAST(b AS BIGINT) AS block, 'leaf' AS row_kind, CAST(sum(v) AS BIGINT) AS row_total, CAST(sum(v * n) AS BIGINT) AS weighted
       FROM numbered GROUP BY p, b
       UNION ALL SELECT p, NULL, row_kind, CAST(sum(v) AS BIGINT), CAST(sum(v * n) AS BIGINT) FROM totals GROUP BY p, row_kind""",
)
def pivot_wide_sparse(spark, sf_dir):
    """Blocks of order keys against a thousand columns, most cells empty, with all totals; an
    empty cell counts as zero, which shows in the largest of negative values."""
    df = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.floor(F.col("o_orderkey") / 64).cast("bigint").alias("block"),
        (F.col("o_custkey") % 1000).alias("k"),
        (F.floor("o_totalprice").cast("bigint") - 150_000).alias("v"),
    )
    spec = PivotSpec(
        rows=["o_orderpriority", "block"], columns=["k"], values=[{"field": "v", "aggregation": "max"}], totals=Totals(subtotals=True, column=True)
    )
    result = pivot(df, spec, ordered=False)
    array = ", ".join(f"`{c.header}`" for c in result.cells)
    weighted = f"aggregate(transform(array({array}), (x, i) -> x * (i + 1)), 0L, (a, x) -> a + x)"
    return result.rows.selectExpr("o_orderpriority", "block", "row_kind", "row_total", f"{weighted} AS weighted")


@query(
    "pivot_ts_cols",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS c0, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS c1,
         count(*) FILTER (WHERE o_orderkey % 3 = 2) AS c2 FROM orders GROUP BY 1""",
)
def pivot_ts_cols(spark, sf_dir):
    """Column keys that lie a microsecond apart."""
    at = F.timestamp_add("MICROSECOND", F.col("o_orderkey") % 3, F.lit("2024-01-01").cast("timestamp_ntz"))
    df = table(spark, sf_dir, "orders").withColumn("at", at)
    spec = PivotSpec(rows=["o_orderstatus"], columns=["at"], values=[{"field": "o_orderkey", "aggregation": "count"}], totals=Totals(row=False))
    return pivot(df, spec).rows.toDF("o_orderstatus", "c0", "c1", "c2")


# Selections ------------------------------------------------------------------------------------


def _picked(n):
    def run(spark, sf_dir):
        """Numbers select from a text column, whether they become a scan predicate or not."""
        df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("string").alias("k"))
        found = drilldown_many(df, PivotSpec(rows=["k"]), [{"k": float(i)} for i in range(n)])
        return found.rows.withColumn("matched_rows", found.matched.scalar())

    return run


for _n in (5, 33):
    query(
        f"drilldown_multi_{_n}",
        f"""SELECT o_orderkey, CAST(o_orderkey % 100 AS VARCHAR) AS k, (SELECT count(*) FROM orders WHERE o_orderkey % 100 < {_n}) AS matched_rows
            FROM orders WHERE o_orderkey % 100 < {_n}""",
    )(_picked(_n))


@query(
    "drilldown_capped",
    f"""WITH {SALES_SQL}, hit AS (SELECT "OrderID" FROM sales WHERE "Status" = 'F')
        SELECT "OrderID", (SELECT count(*) FROM hit) AS matched_rows, (SELECT count(*) > 50 FROM hit) AS truncated
        FROM hit ORDER BY "OrderID" LIMIT 50""",
)
def drilldown_capped(spark, sf_dir):
    """More rows match than are asked for."""
    found = drilldown(sales(spark, sf_dir), PivotSpec(rows=["Status"]), {"Status": "F"}, order_by=["OrderID"], limit=50)
    return found.rows.select("OrderID", found.matched.scalar().alias("matched_rows"), found.truncated.scalar().alias("truncated"))


@query(
    "soft_delete_copies_cold",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem x
       WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_shipdate < TIMESTAMP '1996-01-01'
         AND d.l_quantity = x.l_quantity AND d.l_linenumber = x.l_linenumber AND d.l_returnflag = x.l_returnflag
         AND d.l_linestatus = x.l_linestatus)
       GROUP BY 1, 2""",
)
def soft_delete_copies_cold(spark, sf_dir):
    """As with very many tombstones: nothing is broadcast."""
    lines = table(spark, sf_dir, "lineitem")
    narrow = ("l_quantity", "l_linenumber", "l_returnflag", "l_linestatus")
    doomed = lines.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    keys = _as_tombstones(doomed.select(*key_columns_of(lines, narrow)).distinct())
    left = exclude_deleted(lines.select(*narrow), keys, 1, "Sheet1", narrow, broadcast_keys=0, broadcast_hashes=0)
    return left.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


# Texts -----------------------------------------------------------------------------------------

_SPELLINGS = ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy h:mm a", "d-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd", "d MMMM yyyy")


@query(
    "date_text_month",
    "SELECT strftime(o_orderdate, '%Y-%m') AS d_month, count(*) AS count_o_orderkey FROM orders GROUP BY 1",
)
def date_text_month(spark, sf_dir):
    """Seven spellings of a date in one text column."""
    text = None
    for i, spelling in enumerate(_SPELLINGS):
        this, chosen = F.date_format("o_orderdate", spelling), F.col("o_orderkey") % len(_SPELLINGS) == i
        text = F.when(chosen, this) if text is None else text.when(chosen, this)
    df = table(spark, sf_dir, "orders").withColumn("d", text)
    return pivot(df, PivotSpec(rows=["d"], values=[{"field": "o_orderkey", "aggregation": "count"}], date_grouping={"d": "month"})).rows


@query(
    "profile_spellings",
    """SELECT 0 AS position, 'padded' AS column_name, CASE WHEN count(*) > 0 THEN 'boolean' END AS data_type, count(*) < 0 AS is_nullable FROM orders
       UNION ALL SELECT 1, 'slashed', CASE WHEN count(o_orderdate) = count(*) THEN 'datetime' END, count(*) < 0 FROM orders
       UNION ALL SELECT 2, 'named', CASE WHEN count(o_orderdate) = count(*) THEN 'datetime' END, count(*) < 0 FROM orders""",
)
def profile_spellings(spark, sf_dir):
    """Padded words are words, and dates are dates in any spelling."""
    df = table(spark, sf_dir, "orders").select(
        F.rpad(F.when(F.col("o_orderstatus") == "F", "yes").otherwise("NO"), 40, " ").alias("padded"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("slashed"),
        F.date_format("o_orderdate", "d-MMM-yyyy").alias("named"),
    )
    return profile(df)


def _months_sql(where="TRUE"):
    return f"SELECT strftime(o_orderdate, '%Y-%m') AS d_month, count(*) AS count_o_orderkey FROM orders WHERE {where} GROUP BY 1"


def _by_month(df):
    counted = PivotSpec(rows=["d"], values=[{"field": "o_orderkey", "aggregation": "count"}], date_grouping={"d": "month"})
    return pivot(dated(df, ["d"]), counted).rows


@query("date_text_dayfirst", _months_sql())
def date_text_dayfirst(spark, sf_dir):
    """Days before months, parted by slashes; most cells alone would not tell."""
    return _by_month(table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "dd/MM/yyyy")))


@query("date_text_short_years", _months_sql())
def date_text_short_years(spark, sf_dir):
    """Months first with years of two digits, with dashes or with dots."""
    short, long = F.date_format("o_orderdate", "M-d-yy"), F.date_format("o_orderdate", "M.d.yyyy")
    return _by_month(table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderstatus") == "F", long).otherwise(short)))


@query(
    "date_text_offsets",
    """SELECT strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d') AS d_day, count(*) AS count_o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def date_text_offsets(spark, sf_dir):
    """Moments with their offset from UTC, in two spellings."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    df = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    df = df.withColumn("d", F.concat(iso, F.when(F.col("o_orderstatus") == "F", "+02:00").otherwise("+0200")))
    counted = PivotSpec(rows=["d"], values=[{"field": "o_orderkey", "aggregation": "count"}], date_grouping={"d": "day"})
    return pivot(df, counted).rows


@query(
    "filter_contains_accents",
    "SELECT c_custkey FROM customer WHERE regexp_matches(CASE WHEN c_custkey % 3 = 0 THEN 'MÜLLER ' ELSE 'MUELLER ' END || c_name, 'müller', 'i')",
)
def filter_contains_accents(spark, sf_dir):
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "MÜLLER ").otherwise("MUELLER "), "c_name")
    df = table(spark, sf_dir, "customer").withColumn("name", name)
    return apply_filters(df, {"name": {"contains": "müller"}}).select("c_custkey")


@query(
    "json_list_words",
    "SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) || '|false|x|1' AS items FROM orders",
)
def json_list_words(spark, sf_dir):
    """Texts that read like empty values are kept, empty values are not."""
    made = F.concat(F.lit('["'), (F.col("o_orderkey") % 3).cast("string"), F.lit('", 0, false, null, "false", "x", "", [], {}, 1]'))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(json_list(made), "|").alias("items"))


@query(
    "repeat_labels_numbers",
    """SELECT CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 END AS n, o_orderstatus, count(o_orderkey) AS count_o_orderkey
       FROM orders GROUP BY 1, 2""",
)
def repeat_labels_numbers(spark, sf_dir):
    """The group of missing numbers keeps its own label."""
    df = table(spark, sf_dir, "orders").withColumn("n", F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5))
    spec = PivotSpec(rows=["n", "o_orderstatus"], values=[{"field": "o_orderkey", "aggregation": "count"}], totals=Totals(repeat_labels=True))
    return pivot(df, spec).rows


# Flags -----------------------------------------------------------------------------------------


@query("cf_eq_double", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity = 25 AS flag_0_eq_l_quantity FROM lineitem")
def cf_eq_double(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    return apply_rules(df, [Rule("l_quantity", "eq", 25)])


@query(
    "cf_duplicates_text",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN o_orderstatus
                    WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS t FROM orders)
       SELECT o_orderkey, t, coalesce(t <> '' AND count(*) OVER (PARTITION BY t) > 1, false) AS flag_0_duplicates_t FROM t""",
)
def cf_duplicates_text(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, "").when(key % 7 == 0, F.col("o_orderstatus")).when(key % 11 > 0, key.cast("string"))
    return apply_rules(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), [Rule("t", "duplicates")])


@query(
    "cf_top10_subtotals",
    f"""WITH {SALES_SQL}, leaf AS (SELECT "Nation" AS n, "Segment" AS s, sum("Amount") AS v FROM sales GROUP BY 1, 2),
        edge AS (SELECT min(v) AS v FROM (SELECT v FROM leaf ORDER BY v DESC LIMIT (SELECT CAST(greatest(1, ceil(count(*) * 0.1)) AS BIGINT) FROM leaf)))
        SELECT n AS "Nation", s AS "Segment", 'leaf' AS row_kind, CAST(v AS DOUBLE) AS "sum_Amount", v >= (SELECT v FROM edge) AS flag FROM leaf
        UNION ALL SELECT n, '', 'subtotal', CAST(sum(v) AS DOUBLE), false FROM leaf GROUP BY 1
        UNION ALL SELECT 'Column Total', '', 'column_total', CAST(sum(v) AS DOUBLE), false FROM leaf""",
)
def cf_top10_subtotals(spark, sf_dir):
    """Totals have no rank."""
    spec = PivotSpec(rows=["Nation", "Segment"], values=["Amount"], totals=Totals(subtotals=True, column=True))
    flagged = apply_rules(pivot(sales(spark, sf_dir), spec).rows, [Rule("sum_Amount", "top10")])
    return plain(flagged).withColumnRenamed("flag_0_top10_sum_Amount", "flag")


# The path of a request -------------------------------------------------------------------------


@query(
    "sheet_pivot",
    """WITH left_over AS (SELECT * FROM orders WHERE o_orderkey % 29 <> 0)
       SELECT o_orderstatus, count(*) AS count_o_orderkey, CAST(sum(floor(o_totalprice)) AS DOUBLE) AS sum_whole,
              (SELECT count(*) FROM left_over WHERE o_orderstatus = 'F') AS behind_f
       FROM left_over GROUP BY 1""",
)
def sheet_pivot(spark, sf_dir):
    """Catalog entry, stored file, exclusion of deleted rows, pivot and drill-down."""
    datasets, sheets, _ = register_tables({f"{n}.parquet": table(spark, sf_dir, n) for n in ("customer", "orders")})
    wanted = datasets.where("filename = 'orders.parquet'").first().id
    orders = table(spark, sf_dir, "orders")
    dead = _as_tombstones(orders.where("o_orderkey % 29 = 0").select(*key_columns_of(orders))).withColumn("dataset_id", F.lit(wanted).cast("bigint"))
    name = sheets.where(F.col("dataset_id") == wanted).first().sheet_name
    dead = dead.withColumn("sheet_name", F.lit(name))
    df = open_sheet(spark, datasets, sheets, wanted, sf_dir, tombstones=dead).withColumn("whole", F.floor("o_totalprice").cast("double"))
    spec = PivotSpec(rows=["o_orderstatus"], values=[{"field": "o_orderkey", "aggregation": "count"}, "whole"])
    behind = drilldown(df, spec, {"o_orderstatus": "F"}, order_by=["o_orderkey"]).matched.scalar()
    return pivot(df, spec).rows.withColumn("behind_f", behind)


@query(
    "pivot_statistics",
    f"""WITH {SALESN_SQL} SELECT (SELECT count(*) FROM salesn) AS source_rows, count(*) AS filtered_rows,
          (SELECT count(*) FROM (SELECT DISTINCT "Region", strftime("OrderDate", '%Y-%m') FROM salesn WHERE "Status" = 'F')) AS result_rows,
          'tabular' AS layout, 'OrderDate: month' AS date_grouping, 'sum(Amount)' AS aggregations
        FROM salesn WHERE "Status" = 'F'""",
)
def pivot_statistics(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "OrderDate"], values=["Amount"], date_grouping={"OrderDate": "month"}, filters={"Status": "F"})
    return pivot(salesn(spark, sf_dir), spec).statistics


@query(
    "size_guard",
    f"""WITH {SALES_SQL}, n AS (SELECT count(DISTINCT "Nation") * count(DISTINCT "Status") AS cells FROM sales)
        SELECT cells AS max_cells, false AS refused FROM n UNION ALL SELECT cells - 1, true FROM n""",
)
def size_guard(spark, sf_dir):
    """A pivot of just as many cells as allowed is computed, one of one more is refused."""
    df, spec = sales(spark, sf_dir), PivotSpec(rows=["Nation"], columns=["Status"], values=["Amount"])
    cells = df.select("Nation").distinct().count() * df.select("Status").distinct().count()
    out = []
    for bound in (cells, cells - 1):
        try:
            pivot(df, spec, max_cells=bound)
            out.append((bound, False))
        except PivotError:
            out.append((bound, True))
    return spark.createDataFrame(out, "max_cells bigint, refused boolean")


@query(
    "default_order",
    f"""WITH {SALES_SQL}, g AS (SELECT "Region", "Status", count("OrderID") AS n FROM sales GROUP BY 1, 2)
        SELECT CAST(row_number() OVER (ORDER BY "Region", "Status") AS BIGINT) AS place, "Region", "Status", n FROM g""",
)
def default_order(spark, sf_dir):
    """Rows without a sort specification come in the order of their groups."""
    spec = PivotSpec(rows=["Region", "Status"], values=[{"field": "OrderID", "aggregation": "count", "label": "n"}])
    shown = pivot(sales(spark, sf_dir), spec).rows.withColumn("at", F.monotonically_increasing_id())
    return shown.select(F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"), "Region", "Status", "n")
