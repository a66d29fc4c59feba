"""The price-list domain as views over the driver's star schema, for queries and their tests.

partners <- supplier and nation, services <- part, documents <- orders, items <- lineitem. Statuses, gaps and defects
that the star schema lacks follow from fixed remainders of its keys, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partners(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")  # 25 rows by the schema
    return read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner_name"), F.when(F.col("s_suppkey") % 19 != 0, F.col("n_name")).alias("city"),
        F.when(F.col("n_regionkey") == 0, "USD").when(F.col("n_regionkey") == 1, "RUB").otherwise("KZT").alias("currency"), (F.col("s_suppkey") % 13 != 0).alias("is_active"),
    )


def services(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("service_id"), F.col("p_name").alias("service_name"), F.array(F.array_join(F.reverse(words), " ")).alias("synonyms"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("category"), F.col("p_brand").alias("specialty"), (F.col("p_partkey") % 17 != 0).alias("is_active"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("needs_review")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "scan_pdf", "docx", "xlsx", "xls"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 50).alias("batch_id"), status.alias("parse_status"), kind.alias("file_format"),
        F.when(F.col("o_orderkey") % 23 != 0, F.to_date("o_orderdate")).alias("effective_date"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    """Raw priced rows, before conversion and validation."""
    return items_of(read(spark, d, "lineitem"))


def items_of(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    day = F.to_date("l_shipdate")
    matched = F.when(F.col("l_returnflag") == "N", "matched_auto").when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 3 == 0), "needs_review").when(F.col("l_returnflag") == "A", "matched_manual").when(F.col("l_partkey") % 2 == 0, "unmatched").otherwise("matched_auto")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", day.cast("string"), price.cast("string")).alias("item_id"),
        F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("partner_id"), F.concat(F.lit("Service "), F.col("l_partkey").cast("string")).alias("service_name_raw"),
        F.when(matched != "unmatched", F.col("l_partkey")).alias("service_id"), matched.alias("match_status"),
        F.when(F.col("l_orderkey") % 97 == 0, None).when(F.col("l_orderkey") % 101 == 0, -price).otherwise(price).alias("price"),
        F.round(price * (100 + F.round(100 * F.col("l_tax")) - F.round(100 * F.col("l_discount"))).cast("decimal(5,0)") / 100, 2).cast("decimal(14,2)").alias("price_nonresident"),
        F.when(F.col("l_orderkey") % 89 != 0, day).alias("effective_date"), (F.col("l_linestatus") == "F").alias("is_verified"),
    )


#: The same views in SQL, for comparison queries.
SQL = """
partners AS (
  SELECT s_suppkey AS partner_id, s_name AS partner_name, CASE WHEN s_suppkey % 19 <> 0 THEN n_name END AS city,
    CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'RUB' ELSE 'KZT' END AS currency, s_suppkey % 13 <> 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), services AS (
  SELECT p_partkey AS service_id, p_name AS service_name, [array_to_string(list_reverse(string_split(p_name, ' ')), ' ')] AS synonyms,
    CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS category, p_brand AS specialty, p_partkey % 17 <> 0 AS is_active
  FROM part
), docs AS (
  SELECT o_orderkey AS document_id, o_custkey % 50 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'needs_review' END AS parse_status,
    ['pdf', 'scan_pdf', 'docx', 'xlsx', 'xls'][o_orderkey % 5 + 1] AS file_format, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) END AS effective_date
  FROM orders
), items0 AS (
  SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS p, CAST(l_shipdate AS DATE) AS day,
    CASE WHEN l_returnflag = 'N' THEN 'matched_auto' WHEN l_returnflag = 'A' AND l_partkey % 3 = 0 THEN 'needs_review' WHEN l_returnflag = 'A' THEN 'matched_manual' WHEN l_partkey % 2 = 0 THEN 'unmatched' ELSE 'matched_auto' END AS match_status
  FROM lineitem
), items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(day AS VARCHAR), CAST(p AS VARCHAR)) AS item_id, l_orderkey AS document_id, l_suppkey AS partner_id,
    'Service ' || l_partkey AS service_name_raw, CASE WHEN match_status <> 'unmatched' THEN l_partkey END AS service_id, match_status,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN -p ELSE p END AS price,
    CAST(round(p * CAST(100 + round(100 * l_tax) - round(100 * l_discount) AS DECIMAL(5,0)) * 0.01, 2) AS DECIMAL(14,2)) AS price_nonresident,
    CASE WHEN l_orderkey % 89 <> 0 THEN day END AS effective_date, l_linestatus = 'F' AS is_verified
  FROM items0
)
"""
