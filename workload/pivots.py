"""Filters, date buckets, pivots, totals and orderings over the sales sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from pivotlake import PivotSpec, Totals, pivot
from pivotlake.operators.filters import apply_filters, distinct_values
from pivotlake.operators.paging import page_index
from pivotlake.operators.view import capped, ordered, page
from pivotlake.plans.compile import pivot_cells
from pivotlake.session import new_folder
from workload.registry import query
from workload.tables import SALES_COLUMNS_SQL, SALES_SQL, SALESN_SQL, plain, sales, salesn, table

ALL_FIVE = tuple({"field": "Amount", "aggregation": a} for a in ("count", "sum", "average", "min", "max"))
NO_ROW_TOTAL = Totals(row=False)


# Filters ---------------------------------------------------------------------------


def _filter(name, source, filters, where):
    sql = f"WITH {SALES_SQL if source is sales else SALESN_SQL} SELECT {SALES_COLUMNS_SQL} FROM {source.__name__} WHERE {where}"

    @query(name, sql)
    def run(spark, sf_dir):
        return plain(apply_filters(source(spark, sf_dir), filters))


_filter("filter_eq", sales, {"Status": "O"}, "\"Status\" = 'O'")
_filter("filter_equals", sales, {"Status": {"equals": "O"}}, "\"Status\" = 'O'")
_filter("filter_in", sales, {"Region": ["ASIA", "EUROPE"]}, "\"Region\" IN ('ASIA', 'EUROPE')")
_filter("filter_struct_in", sales, {"Region": {"in": ["ASIA", "EUROPE"]}}, "\"Region\" IN ('ASIA', 'EUROPE')")
_filter("filter_null", salesn, {"Region": None}, '"Region" IS NULL')
_filter(
    "filter_not_in", salesn, {"Region": {"notIn": ["ASIA"]}}, "\"Region\" IS NULL OR \"Region\" NOT IN ('ASIA')"
)
_filter(
    "filter_range",
    sales,
    {"OrderDate": {"from": "1996-01-01", "to": "1996-12-31"}},
    "\"OrderDate\" >= TIMESTAMP '1996-01-01' AND \"OrderDate\" <= TIMESTAMP '1996-12-31'",
)
_filter(
    "filter_combined",
    salesn,
    {
        "OrderDate": {"from": "1996-01-01", "to": "1998-12-31"},
        "Region": {"notIn": ["ASIA"]},
        "Status": ["F", "P"],
        "Amount": {"from": 1000.5},
    },
    "\"OrderDate\" >= TIMESTAMP '1996-01-01' AND \"OrderDate\" <= TIMESTAMP '1998-12-31' "
    "AND (\"Region\" IS NULL OR \"Region\" NOT IN ('ASIA')) AND \"Status\" IN ('F', 'P') AND \"Amount\" >= 1000.5",
)


@query(
    "filter_contains",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, 'build|auto', 'i')",
)
def filter_contains(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return apply_filters(df, {"c_mktsegment": {"contains": "build|auto"}})


@query(
    "distinct_values",
    f"""WITH {SALESN_SQL} SELECT DISTINCT "Region" FROM salesn WHERE "Region" IS NOT NULL AND "Region" <> ''""",
)
def distinct_regions(spark, sf_dir):
    return distinct_values(salesn(spark, sf_dir), "Region")


# Date buckets ------------------------------------------------------------------------

_BUCKETS = {
    "year": "strftime(o_orderdate, '%Y')",
    "quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "week": "isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0')",
    "day": "strftime(o_orderdate, '%Y-%m-%d')",
}


def _date_query(grain, sql):
    @query(
        f"date_{grain}",
        f'SELECT {sql} AS "o_orderdate_{grain}", count(o_orderkey) AS n FROM orders GROUP BY 1',
    )
    def run(spark, sf_dir):
        spec = PivotSpec(
            rows=["o_orderdate"],
            values=[{"field": "o_orderkey", "aggregation": "count", "label": "n"}],
            date_grouping={"o_orderdate": grain},
        )
        return pivot(table(spark, sf_dir, "orders"), spec).rows


for _grain, _sql in _BUCKETS.items():
    _date_query(_grain, _sql)


# One aggregation by region -------------------------------------------------------------

_SUM = 'CAST(coalesce(sum("Amount"), 0) AS DOUBLE)'
_AVG = 'CAST(sum("Amount") AS DOUBLE) / nullif(count("Amount"), 0)'
_AGGREGATES = {
    "count": 'count("Amount")',
    "sum": _SUM,
    "average": _AVG,
    "min": 'CAST(min("Amount") AS DOUBLE)',
    "max": 'CAST(max("Amount") AS DOUBLE)',
}


def _one_aggregate(name, aggregation):
    @query(
        name,
        f"""WITH {SALESN_SQL} SELECT coalesce("Region", '(blank)') AS "Region",
            {_AGGREGATES[aggregation]} AS "{aggregation}_Amount" FROM salesn GROUP BY 1""",
    )
    def run(spark, sf_dir):
        spec = PivotSpec(rows=["Region"], values=[{"field": "Amount", "aggregation": aggregation}])
        return plain(pivot(salesn(spark, sf_dir), spec).rows)


for _name, _aggregation in (
    ("pivot_count", "count"),
    ("pivot_sum", "sum"),
    ("pivot_avg", "average"),
    ("pivot_min", "min"),
    ("pivot_max", "max"),
):
    _one_aggregate(_name, _aggregation)


@query(
    "pivot_avg_date",
    """SELECT o_orderpriority,
         strftime(make_timestamp(CAST(floor(sum(CAST(epoch_us(o_orderdate) AS HUGEINT)) / count(*)) AS BIGINT)),
                  '%Y-%m-%d %H:%M:%S') AS "average_o_orderdate"
       FROM orders GROUP BY 1""",
)
def pivot_avg_date(spark, sf_dir):
    spec = PivotSpec(rows=["o_orderpriority"], values=[{"field": "o_orderdate", "aggregation": "average"}])
    return plain(pivot(table(spark, sf_dir, "orders"), spec).rows)


@query(
    "pivot_global",
    f"""WITH {SALES_SQL} SELECT count("Amount") AS "count_Amount", {_SUM} AS "sum_Amount",
        {_AVG} AS "average_Amount", CAST(min("Amount") AS DOUBLE) AS "min_Amount",
        CAST(max("Amount") AS DOUBLE) AS "max_Amount" FROM sales""",
)
def pivot_global(spark, sf_dir):
    return plain(pivot(sales(spark, sf_dir), PivotSpec(values=ALL_FIVE)).rows)


# Rows and columns ----------------------------------------------------------------------


@query(
    "pivot_rows",
    f"""WITH {SALES_SQL} SELECT "Region", strftime("OrderDate", '%Y-%m') AS "OrderDate_month",
        {_SUM} AS "sum_Amount", count("OrderID") AS "count_OrderID" FROM sales GROUP BY 1, 2""",
)
def pivot_rows(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region", "OrderDate"],
        values=["Amount", {"field": "OrderID", "aggregation": "count"}],
        date_grouping={"OrderDate": "month"},
    )
    return plain(pivot(sales(spark, sf_dir), spec).rows)


_STATUSES = ("F", "O", "P")


def _cells(expression, statuses=_STATUSES, field="Amount", header="Amount"):
    """One zero-filled cell per status."""
    return ", ".join(
        f"""coalesce(CAST({expression} FILTER (WHERE "Status" = '{s}') AS DOUBLE), 0) AS "{header} | {s}" """
        for s in statuses
    )


@query(
    "pivot_rows_cols",
    f"""WITH {SALES_SQL} SELECT "Region", {_cells('sum("Amount")')}, CAST(sum("Amount") AS DOUBLE) AS row_total
        FROM sales GROUP BY 1""",
)
def pivot_rows_cols(spark, sf_dir):
    return plain(pivot(sales(spark, sf_dir), PivotSpec(rows=["Region"], columns=["Status"], values=["Amount"])).rows)


def flagship(df):
    """Region by month against status, summed."""
    spec = PivotSpec(
        rows=["Region", "OrderDate"],
        columns=["Status"],
        values=["Amount"],
        date_grouping={"OrderDate": "month"},
    )
    return plain(pivot(df, spec).rows)


@query(
    "pivot_flagship",
    f"""WITH {SALES_SQL} SELECT "Region", strftime("OrderDate", '%Y-%m') AS "OrderDate_month",
        {_cells('sum("Amount")')}, CAST(sum("Amount") AS DOUBLE) AS row_total
        FROM sales GROUP BY 1, 2""",
)
def pivot_flagship(spark, sf_dir):
    return flagship(sales(spark, sf_dir))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "pivot_two_cols",
    f"""WITH {SALES_SQL} SELECT "Region", {", ".join(
        f'''coalesce(CAST(sum("Amount") FILTER (WHERE "Status" = '{s}' AND "Priority" = '{p}') AS DOUBLE), 0)
            AS "Amount | {s} | {p}" ''' for s in _STATUSES for p in _PRIORITIES)},
        CAST(sum("Amount") AS DOUBLE) AS row_total FROM sales GROUP BY 1""",
)
def pivot_two_cols(spark, sf_dir):
    spec = PivotSpec(rows=["Region"], columns=["Status", "Priority"], values=["Amount"])
    return plain(pivot(sales(spark, sf_dir), spec).rows)


@query(
    "pivot_cols_only",
    f"""WITH {SALES_SQL}, m AS (
          SELECT "Status", 'sum_Amount' AS measure, CAST(sum("Amount") AS DOUBLE) AS v FROM sales GROUP BY 1
          UNION ALL SELECT "Status", 'count_OrderID', CAST(count("OrderID") AS DOUBLE) FROM sales GROUP BY 1)
        SELECT measure, {", ".join(f"max(v) FILTER (WHERE \"Status\" = '{s}') AS \"{s}\"" for s in _STATUSES)}
        FROM m GROUP BY 1""",
)
def pivot_cols_only(spark, sf_dir):
    spec = PivotSpec(columns=["Status"], values=["Amount", {"field": "OrderID", "aggregation": "count"}])
    return plain(pivot(sales(spark, sf_dir), spec).rows)


@query(
    "pivot_multi_measure",
    f"""WITH {SALES_SQL} SELECT "Region",
        {", ".join(f'''coalesce(CAST(sum("Amount") FILTER (WHERE "Status" = '{s}') AS DOUBLE)
            / count("Amount") FILTER (WHERE "Status" = '{s}'), 0) AS "average_Amount | {s}",
          coalesce(CAST(sum("Amount") FILTER (WHERE "Status" = '{s}') AS DOUBLE), 0) AS "sum_Amount | {s}",
          count("OrderID") FILTER (WHERE "Status" = '{s}') AS "orders | {s}" ''' for s in _STATUSES)}
        FROM sales GROUP BY 1""",
)
def pivot_multi_measure(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region"],
        columns=["Status"],
        values=[
            "Amount",
            {"field": "Amount", "aggregation": "average"},
            {"field": "OrderID", "aggregation": "count", "label": "orders"},
        ],
    )
    return plain(pivot(sales(spark, sf_dir), spec).rows)


@query("pivot_default_count", 'SELECT o_orderstatus, count(o_orderkey) AS "count" FROM orders GROUP BY 1')
def pivot_default_count(spark, sf_dir):
    return pivot(table(spark, sf_dir, "orders"), PivotSpec(rows=["o_orderstatus"])).rows


@query(
    "pivot_blank",
    f"""WITH {SALESN_SQL} SELECT coalesce("Region", '(blank)') AS "Region",
        strftime("OrderDate", '%Y-%m') AS "OrderDate_month", {_SUM} AS "sum_Amount" FROM salesn GROUP BY 1, 2""",
)
def pivot_blank(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "OrderDate"], values=["Amount"], date_grouping={"OrderDate": "month"})
    return plain(pivot(salesn(spark, sf_dir), spec).rows)


def _no_low(spark, sf_dir):
    return salesn(spark, sf_dir).withColumn("Amount", F.when(F.col("Priority") != "5-LOW", F.col("Amount")))


@query(
    "pivot_all_null",
    f"""WITH {SALESN_SQL}, x AS (
          SELECT "Priority", "Status", CAST(sum(a) AS DOUBLE) / nullif(count(a), 0) AS v
          FROM (SELECT "Priority", "Status", CASE WHEN "Priority" <> '5-LOW' THEN "Amount" END AS a FROM salesn)
          GROUP BY 1, 2)
        SELECT "Priority", {", ".join(
          f"coalesce(max(v) FILTER (WHERE \"Status\" = '{s}'), 0) AS \"Amount | {s}\"" for s in _STATUSES)}
        FROM x WHERE v IS NOT NULL GROUP BY 1""",
)
def pivot_all_null(spark, sf_dir):
    spec = PivotSpec(
        rows=["Priority"],
        columns=["Status"],
        values=[{"field": "Amount", "aggregation": "average"}],
        totals=NO_ROW_TOTAL,
    )
    return plain(pivot(_no_low(spark, sf_dir), spec).rows)


# Totals --------------------------------------------------------------------------------

_STATUS_AVERAGES = f"""x AS (SELECT "Region", {", ".join(
    f'''CAST(sum("Amount") FILTER (WHERE "Status" = '{s}') AS DOUBLE)
        / count("Amount") FILTER (WHERE "Status" = '{s}') AS "{s}" ''' for s in _STATUSES)}
    FROM sales GROUP BY 1)"""


@query(
    "row_total",
    f"""WITH {SALES_SQL}, {_STATUS_AVERAGES}
        SELECT "Region", "F" AS "Amount | F", "O" AS "Amount | O", "P" AS "Amount | P",
               "F" + "O" + "P" AS row_total FROM x""",
)
def row_total(spark, sf_dir):
    spec = PivotSpec(rows=["Region"], columns=["Status"], values=[{"field": "Amount", "aggregation": "average"}])
    return pivot(sales(spark, sf_dir), spec).rows


@query(
    "grand_total",
    f"""WITH {SALESN_SQL} SELECT {_AVG} AS "average_Amount", {_SUM} AS "sum_Amount",
        count("Region") AS "count_Region", strftime(max("OrderDate"), '%Y-%m-%d %H:%M:%S') AS "max_OrderDate"
        FROM salesn""",
)
def grand_total(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region"],
        columns=["Status"],
        values=[
            {"field": "Amount", "aggregation": "average"},
            "Amount",
            {"field": "Region", "aggregation": "count"},
            {"field": "OrderDate", "aggregation": "max"},
        ],
    )
    return plain(pivot(salesn(spark, sf_dir), spec).grand)


@query(
    "subtotals",
    f"""WITH {SALESN_SQL}, leaf AS (
          SELECT coalesce("Region", '(blank)') AS "Region", "Segment", "Status", sum("Amount") AS s,
                 count("OrderID") AS c FROM salesn GROUP BY 1, 2, 3)
        SELECT "Region", "Segment", "Status", CAST(coalesce(s, 0) AS DOUBLE) AS "sum_Amount",
               c AS "count_OrderID", 'leaf' AS row_kind FROM leaf
        UNION ALL
        SELECT "Region", "Segment", '', CAST(coalesce(sum(s), 0) AS DOUBLE), CAST(sum(c) AS BIGINT), 'subtotal'
        FROM leaf GROUP BY 1, 2""",
)
def subtotals(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region", "Segment", "Status"],
        values=["Amount", {"field": "OrderID", "aggregation": "count"}],
        totals=Totals(subtotals=True),
    )
    return plain(pivot(salesn(spark, sf_dir), spec).rows)


_LEAF_STATS = """leaf AS (
  SELECT "Region", "Segment", CAST(sum("Amount") AS DOUBLE) / count("Amount") AS a,
         CAST(min("Amount") AS DOUBLE) AS lo, CAST(max("Amount") AS DOUBLE) AS hi FROM sales GROUP BY 1, 2)"""
_STATS = (
    {"field": "Amount", "aggregation": "average"},
    {"field": "Amount", "aggregation": "min"},
    {"field": "Amount", "aggregation": "max"},
)


@query(
    "subtotals_avg",
    f"""WITH {SALES_SQL}, {_LEAF_STATS}
        SELECT "Region", "Segment", round(a, 4) AS "average_Amount", lo AS "min_Amount", hi AS "max_Amount",
               'leaf' AS row_kind FROM leaf
        UNION ALL SELECT "Region", '', round(avg(a), 4), min(lo), max(hi), 'subtotal' FROM leaf GROUP BY 1""",
)
def subtotals_avg(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "Segment"], values=_STATS, totals=Totals(subtotals=True))
    rows = plain(pivot(sales(spark, sf_dir), spec).rows)
    return rows.withColumn("average_Amount", F.round("average_Amount", 4))


@query(
    "column_totals",
    f"""WITH {SALES_SQL}, {_LEAF_STATS}
        SELECT "Region", "Segment", round(a, 4) AS "average_Amount", lo AS "min_Amount", hi AS "max_Amount",
               'leaf' AS row_kind FROM leaf
        UNION ALL SELECT "Region", '', round(avg(a), 4), min(lo), max(hi), 'subtotal' FROM leaf GROUP BY 1
        UNION ALL SELECT 'Column Total', '', round(avg(a), 4), min(lo), max(hi), 'column_total' FROM leaf""",
)
def column_totals(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "Segment"], values=_STATS, totals=Totals(subtotals=True, column=True))
    rows = plain(pivot(sales(spark, sf_dir), spec).rows)
    return rows.withColumn("average_Amount", F.round("average_Amount", 4))


@query(
    "column_totals_wide",
    f"""WITH {SALES_SQL}, leaf AS (SELECT "Region", {_cells('sum("Amount")')} FROM sales GROUP BY 1)
        SELECT *, "Amount | F" + "Amount | O" + "Amount | P" AS row_total, 'leaf' AS row_kind FROM (
          SELECT "Region", {", ".join(f'round("Amount | {s}", 2) AS "Amount | {s}"' for s in _STATUSES)} FROM leaf)
        UNION ALL
        SELECT *, "f" + "o" + "p", 'column_total' FROM (
          SELECT 'Column Total', {", ".join(
            f'CAST(sum(CAST("Amount | {s}" AS DECIMAL(18,2))) AS DOUBLE) AS "{s.lower()}"' for s in _STATUSES)}
          FROM leaf)""",
)
def column_totals_wide(spark, sf_dir):
    spec = PivotSpec(rows=["Region"], columns=["Status"], values=["Amount"], totals=Totals(column=True, row=False))
    rows = plain(pivot(sales(spark, sf_dir), spec).rows)
    total = F.col("`Amount | F`") + F.col("`Amount | O`") + F.col("`Amount | P`")
    return rows.withColumn("row_total", total)


@query(
    "repeat_labels",
    f"""WITH {SALESN_SQL}, leaf AS (
          SELECT CASE WHEN "Region" = 'ASIA' THEN '' ELSE coalesce("Region", '(blank)') END AS r, "Status",
                 count("OrderID") AS c FROM salesn GROUP BY 1, 2),
        tagged AS (SELECT r, "Status", c, 'leaf' AS row_kind FROM leaf
          UNION ALL SELECT r, '', CAST(sum(c) AS BIGINT), 'subtotal' FROM leaf GROUP BY 1)
        SELECT CASE WHEN r = '' THEN NULL ELSE r END AS "Region", "Status", c AS "count_OrderID", row_kind
        FROM tagged""",
)
def repeat_labels(spark, sf_dir):
    """Region is empty text for one region; that group sorts first, so it has nothing
    above to repeat, and every subtotal keeps its last field blank."""
    df = salesn(spark, sf_dir).withColumn(
        "Region", F.when(F.col("Region") == "ASIA", "").otherwise(F.col("Region"))
    )
    spec = PivotSpec(
        rows=["Region", "Status"],
        values=[{"field": "OrderID", "aggregation": "count"}],
        totals=Totals(subtotals=True, repeat_labels=True),
    )
    rows = pivot(df, spec).rows
    return rows.withColumn("Region", F.nullif("Region", F.lit("")))


@query(
    "repeat_labels_down",
    f"""WITH {SALES_SQL}, leaf AS (
          SELECT "Region", CASE WHEN "Status" = 'F' THEN '' ELSE "Status" END AS s, count("OrderID") AS c
          FROM sales GROUP BY 1, 2)
        SELECT "Region", coalesce(nullif(s, ''), nullif(lag(s) OVER (ORDER BY "Region", s), ''), '') AS "Status",
               c AS "count_OrderID" FROM leaf""",
)
def repeat_labels_down(spark, sf_dir):
    """An empty second label takes the value above it, across groups."""
    df = sales(spark, sf_dir).withColumn("Status", F.when(F.col("Status") == "F", "").otherwise(F.col("Status")))
    spec = PivotSpec(
        rows=["Region", "Status"],
        values=[{"field": "OrderID", "aggregation": "count"}],
        totals=Totals(repeat_labels=True),
    )
    return pivot(df, spec).rows


@query(
    "hierarchy",
    f"""WITH {SALESN_SQL} SELECT coalesce("Region", '(blank)') AS "Region", "Segment", "Status",
          count("OrderID") AS "count_OrderID", 'leaf' AS row_kind, 2 AS level,
          coalesce("Region", '(blank)') || '||' || "Segment" AS parent_key FROM salesn GROUP BY 1, 2, 3
        UNION ALL SELECT coalesce("Region", '(blank)'), "Segment", '', count("OrderID"), 'subtotal', 1,
          coalesce("Region", '(blank)') FROM salesn GROUP BY 1, 2""",
)
def hierarchy(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region", "Segment", "Status"],
        values=[{"field": "OrderID", "aggregation": "count"}],
        totals=Totals(subtotals=True),
    )
    return pivot(salesn(spark, sf_dir), spec, markers=True).rows


@query(
    "hierarchy_compact",
    f"""WITH {SALES_SQL} SELECT "Region" || ' / ' || "Status" AS "Rows", count("OrderID") AS "count_OrderID",
          'leaf' AS row_kind, 1 AS level, "Region" AS parent_key FROM sales GROUP BY "Region", "Status" """,
)
def hierarchy_compact(spark, sf_dir):
    spec = PivotSpec(
        rows=["Region", "Status"], values=[{"field": "OrderID", "aggregation": "count"}], layout="compact"
    )
    return pivot(sales(spark, sf_dir), spec, markers=True).rows


@query(
    "pivot_counts",
    f"""WITH {SALES_SQL} SELECT (SELECT count(*) FROM sales) AS source_rows,
          (SELECT count(*) FROM sales WHERE "Status" = 'O') AS filtered_rows,
          (SELECT count(*) FROM (SELECT DISTINCT "Nation", "Segment" FROM sales WHERE "Status" = 'O')) AS result_rows""",
)
def pivot_counts(spark, sf_dir):
    spec = PivotSpec(rows=["Nation", "Segment"], values=["Amount"], filters={"Status": "O"})
    return pivot(sales(spark, sf_dir), spec, reuse=True).counts


@query(
    "pivot_cells",
    f"""WITH {SALES_SQL}, n AS (SELECT
          (SELECT count(*) FROM (SELECT DISTINCT "Nation", "Segment" FROM sales)) AS row_groups,
          (SELECT count(*) FROM (SELECT DISTINCT "Status", "Priority" FROM sales)) AS column_groups,
          CAST(2 AS BIGINT) AS value_fields)
        SELECT *, row_groups * column_groups * value_fields AS cells FROM n""",
)
def cell_estimate(spark, sf_dir):
    spec = PivotSpec(
        rows=["Nation", "Segment"],
        columns=["Status", "Priority"],
        values=["Amount", {"field": "OrderID", "aggregation": "count"}],
    )
    return pivot_cells(pivot(sales(spark, sf_dir), spec))


# Order, cap, page, layout ------------------------------------------------------------------

_BY_NATION = f"""WITH {SALES_SQL}, n AS (SELECT "Nation", {_SUM} AS "sum_Amount" FROM sales GROUP BY 1)"""
_NATIONS = PivotSpec(rows=["Nation"], values=["Amount"], sorting={"sum_Amount": "desc"})


@query("sort_measure_topk", f'{_BY_NATION} SELECT * FROM n ORDER BY "sum_Amount" DESC, "Nation" LIMIT 10')
def sort_measure_topk(spark, sf_dir):
    return plain(pivot(sales(spark, sf_dir), _NATIONS).rows).limit(10)


@query(
    "result_cap",
    f"""WITH {SALES_SQL}, n AS (SELECT "Nation", "Segment", {_SUM} AS "sum_Amount" FROM sales GROUP BY 1, 2)
        SELECT *, (SELECT count(*) FROM n) AS total_rows, (SELECT count(*) FROM n) > 40 AS truncated
        FROM n ORDER BY "Nation", "Segment" LIMIT 40""",
)
def result_cap(spark, sf_dir):
    result = pivot(sales(spark, sf_dir), PivotSpec(rows=["Nation", "Segment"], values=["Amount"]), ordered=False, reuse=True)
    rows = plain(result.rows)
    return capped(rows, ordered(rows, {}, ["Nation", "Segment"]), 40)


@query(
    "page_deep",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem
       ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET (SELECT CAST(count(*) * 9 // 10 AS BIGINT) FROM lineitem)""",
)
def deep_page(spark, sf_dir):
    """Fifty lines from nine tenths of the sorted table on, by its page index."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    order = [F.desc("l_shipdate"), *(F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"))]
    index = page_index(lines, order, new_folder(spark, "pages"))
    return plain(index.slice(index.total * 9 // 10, 50))


@query(
    "page",
    f"""WITH {SALES_SQL}, n AS (SELECT "Nation", "Segment", {_SUM} AS "sum_Amount" FROM sales GROUP BY 1, 2)
        SELECT * FROM n ORDER BY "sum_Amount" DESC, "Nation", "Segment" LIMIT 20 OFFSET 40""",
)
def third_page(spark, sf_dir):
    result = pivot(sales(spark, sf_dir), PivotSpec(rows=["Nation", "Segment"], values=["Amount"]), ordered=False)
    order = ordered(result.rows, {"sum_Amount": "desc"}, ["Nation", "Segment"])
    return plain(page(result.rows, order, number=2, size=20))


@query(
    "layout_compact",
    f"""WITH {SALESN_SQL} SELECT concat_ws(' / ', coalesce("Region", '(blank)'), "Status", "Priority") AS "Rows",
        {_SUM} AS "sum_Amount" FROM salesn GROUP BY "Region", "Status", "Priority" """,
)
def layout_compact(spark, sf_dir):
    spec = PivotSpec(rows=["Region", "Status", "Priority"], values=["Amount"], layout="compact")
    return plain(pivot(salesn(spark, sf_dir), spec).rows)


@query(
    "pivot_skewed_lines",
    """SELECT l_returnflag, coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE), 0) AS "price | F",
              coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE), 0) AS "price | O"
       FROM lineitem GROUP BY 1""",
)
def pivot_skewed_lines(spark, sf_dir):
    """The largest table against two tiny keys: partial aggregation leaves a few rows
    per task to shuffle, however large one group is."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    spec = PivotSpec(rows=["l_returnflag"], columns=["l_linestatus"], values=["price"], totals=NO_ROW_TOTAL)
    return plain(pivot(lines, spec).rows)
