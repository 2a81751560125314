"""Stand-in sheets built from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pivotlake.operators.directory import LIST, USER
from pivotlake.sources.directory import normalised

MONEY = "decimal(18,2)"

# SQL of the same stand-ins, to be put in front of a query.
SALES_SQL = """
sales AS (
  SELECT o.o_orderkey AS "OrderID", r.r_name AS "Region", n.n_name AS "Nation",
         c.c_mktsegment AS "Segment", o.o_orderdate AS "OrderDate", o.o_orderstatus AS "Status",
         o.o_orderpriority AS "Priority", CAST(o.o_totalprice AS DECIMAL(18,2)) AS "Amount"
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)
"""
SALESN_SQL = SALES_SQL + """,
salesn AS (
  SELECT "OrderID", CASE WHEN "OrderID" % 17 = 0 THEN NULL ELSE "Region" END AS "Region",
         "Nation", "Segment", "OrderDate", "Status", "Priority",
         CASE WHEN "OrderID" % 13 = 0 THEN NULL ELSE "Amount" END AS "Amount"
  FROM sales)
"""


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the region, nation and segment of their customer.

    The dimension side is joined together first, so orders are joined once.
    """
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    buyers = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "r_name", "n_name", "c_mktsegment")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("OrderID"),
            F.col("r_name").alias("Region"),
            F.col("n_name").alias("Nation"),
            F.col("c_mktsegment").alias("Segment"),
            F.col("o_orderdate").alias("OrderDate"),
            F.col("o_orderstatus").alias("Status"),
            F.col("o_orderpriority").alias("Priority"),
            F.col("o_totalprice").cast(MONEY).alias("Amount"),
        )
    )


def salesn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with missing regions and amounts, spread by order key."""
    return sales(spark, sf_dir).withColumns(
        {
            "Region": F.when(F.col("OrderID") % 17 != 0, F.col("Region")),
            "Amount": F.when(F.col("OrderID") % 13 != 0, F.col("Amount")),
        }
    )


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as text, which both engines show the same."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(f.name))
    return df.select(*out)


# What plain() makes of the columns of sales.
SALES_COLUMNS_SQL = """
  "OrderID", "Region", "Nation", "Segment", strftime("OrderDate", '%Y-%m-%d %H:%M:%S') AS "OrderDate",
  "Status", "Priority", CAST("Amount" AS DOUBLE) AS "Amount"
"""


# Operational tables ------------------------------------------------------------------

LOGS_SQL = """
logs AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
         event_type AS category, event_type || ' ' || user_id AS message, props AS details
  FROM events)
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application log made of the events."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "error").when(kind == "signup", "warning").otherwise("info").alias("level"),
        kind.alias("category"),
        F.concat_ws(" ", kind, F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("details"),
    )


MAIL_SQL = """
mails AS (
  SELECT o_orderkey AS id, o_orderdate AS sent_at, 'Orders ' || o_orderpriority AS subject,
         '["c' || o_custkey || '@example.com"," C' || (o_custkey % 10) || '@Example.com "]' AS to_addresses_json,
         CASE o_orderstatus WHEN 'F' THEN '[]' WHEN 'O' THEN 'not json'
              ELSE '["boss@example.com",""]' END AS cc_addresses_json,
         o_orderstatus AS dataset_name,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'orders.parquet' ELSE 'gone.parquet' END AS attachment_path
  FROM orders)
"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail history made of the orders: one mail per order."""
    status, priority, cust = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("sent_at"),
        F.concat(F.lit("Orders "), priority).alias("subject"),
        F.concat(
            F.lit('["c'), cust.cast("string"), F.lit('@example.com"," C'), (cust % 10).cast("string"), F.lit('@Example.com "]')
        ).alias("to_addresses_json"),
        F.when(status == "F", "[]").when(status == "O", "not json").otherwise('["boss@example.com",""]').alias("cc_addresses_json"),
        F.lit(None).cast("string").alias("bcc_addresses_json"),
        F.lit(1).cast("bigint").alias("dataset_id"),
        status.alias("dataset_name"),
        F.lit("Sheet1").alias("sheet_name"),
        F.lit(1).alias("pivot_rows_count"),
        F.lit(None).cast("int").alias("attached_records_count"),
        F.when(priority == "2-HIGH", "failed").otherwise("success").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.when(priority == "1-URGENT", "orders.parquet").otherwise("gone.parquet").alias("attachment_path"),
        F.lit(None).cast("string").alias("attachment_filename"),
    )


DIRECTORY_SQL = """
exported AS (
  SELECT c_custkey AS line, 'user' AS kind, c_name AS name,
         lower(c_mktsegment) || c_nationkey || '.' || CAST(floor(abs(c_acctbal)) AS BIGINT) % 50
           || CASE WHEN c_acctbal < 0 THEN '' ELSE '@example.com' END AS email,
         lower(replace(c_name, '#', '.')) AS alias FROM customer
  UNION ALL
  SELECT s_suppkey, 'distribution_list',
         CASE WHEN s_acctbal < 1000 THEN 'team' || s_nationkey || '@example.com' ELSE s_name END,
         'team' || s_nationkey || '@example.com', lower(s_name) FROM supplier),
directory AS (
  SELECT email, name, alias, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, email ORDER BY line) AS n FROM exported WHERE contains(email, '@'))
  WHERE n = 1)
"""


def user_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a directory export, with repeated and invalid addresses."""
    address = F.concat(
        F.upper("c_mktsegment"),
        F.col("c_nationkey").cast("string"),
        F.lit("."),
        (F.floor(F.abs("c_acctbal")) % 50).cast("string"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("@Example.com"),
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("line"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("  ")).alias("DisplayName"),
        F.concat(F.lit(" "), address).alias("PrimarySmtpAddress"),
        F.upper(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))).alias("Alias"),
    )


def list_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an export of distribution lists, some without a name."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("line"),
        F.when(F.col("s_acctbal") < 1000, F.lit(None)).otherwise(F.col("s_name")).alias("DisplayName"),
        F.upper("s_name").alias("Alias"),
        F.concat(F.lit("Team"), F.col("s_nationkey").cast("string"), F.lit("@example.com")).alias("PrimarySmtpAddress"),
        F.lit("System.Collections.ArrayList").alias("ManagedBy"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised directory, without the detour over files."""
    return normalised(user_export(spark, sf_dir), USER, F.col("line")).unionByName(
        normalised(list_export(spark, sf_dir), LIST, F.col("line"))
    )
