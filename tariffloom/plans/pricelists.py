"""Queries over price lists that arrive one after another, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upserts, versioning
from ..session import workspace
from ..sources.keyed import KeyedTable
from ..streaming import ingest
from . import domain

LISTS = 8  # that arrive one after another
PART_ROWS = 500_000  # of a part of the keyed table, about


def price_lists(spark, d):
    return price_lists_of(domain.items(spark, d))


def price_lists_of(rows):
    """All items as rows of price lists: lines that come back in one list and in many, names with blanks around them, dates of
    quarters, so that lists repeat each other's."""
    blank = F.when(F.col("document_id") % 3 == 0, "  ").otherwise("")
    kind = F.regexp_extract("service_name_raw", r"\d+", 0).cast("long") % 25
    return rows.select(
        "item_id", "partner_id", F.concat(blank, F.lit("Service "), kind.cast("string"), blank).alias("service_name_raw"),
        F.trunc("effective_date", "quarter").alias("effective_date"), "price", (F.col("document_id") % LISTS).alias("document_no"),
    )


OUT = ("item_id", "version", "previous_item_id", "is_active", "is_anomaly")


def upsert_documents(spark, d):
    return upserts.upsert(None, price_lists(spark, d)).select(*OUT)


def versions_table(spark, path, rows, parts=32):
    line = "coalesce(trim(service_name_raw), '')"
    return KeyedTable(spark, path, upserts.schema_of(rows), ("partner_id", line), parts)


def stream_upsert(spark, d, arrivals=4):
    """The same lists, some at a time, through a stream into a keyed table. Lists arrive as they are delivered, in parts of
    which a task holds one."""
    at, lines = workspace(spark), domain.read(spark, d, "lineitem")
    table = versions_table(spark, f"{at}/table", price_lists(spark, d), max(32, -(-lines.count() // PART_ROWS)))
    number = F.col("l_orderkey") % LISTS * arrivals
    for k in range(arrivals):
        lines.where((number >= k * LISTS) & (number < (k + 1) * LISTS)).write.mode("append").option("compression", "zstd").parquet(f"{at}/lists")
        stream = spark.readStream.schema(lines.schema).parquet(f"{at}/lists")
        ingest.ingest(price_lists_of(domain.items_of(stream)), table, f"{at}/checkpoint", ingest.upserted)
    return table.read().select(*OUT)


def reconcile_created(spark, d):
    """Unmatched rows whose names differ in case, marks and ё; of equal dates and versions the one made last stays active."""
    n = F.regexp_extract("service_name_raw", r"\d+", 0).cast("long")
    name = F.element_at(F.array(F.lit("Ёлка-"), F.lit(" елка  "), F.lit("ЕЛКА, ")), (n % 3 + 1).cast("int"))
    rows = domain.items(spark, d).select("item_id", "partner_id", "service_id", F.concat(name, (n % 40).cast("string")).alias("service_name_raw"), F.trunc("effective_date", "year").alias("effective_date"), (n % 2 + 1).cast("int").alias("version"), F.lit(True).alias("is_active"), F.when(n % 5 != 0, F.col("document_id")).alias("created_at"))
    return versioning.reconcile(rows).select("item_id", "is_active")


QUERIES = {f.__name__: f for f in (upsert_documents, stream_upsert, reconcile_created)}


def lists_sql() -> str:
    """The state after each list from the one before it, a list at a time."""
    steps = ["""s0 AS (SELECT item_id, partner_id, name, date, price, 0 AS version, false AS is_active, item_id AS previous_item_id, false AS is_anomaly FROM lists WHERE false)"""]
    for k in range(LISTS):
        steps.append(f"""n{k} AS (SELECT * FROM lists WHERE document_no = {k}
), d{k} AS MATERIALIZED (
  SELECT n.*, o.item_id AS old_item_id, o.version AS old_version FROM n{k} n LEFT JOIN s{k} o ON o.is_active AND o.partner_id = n.partner_id AND o.name = n.name AND o.date IS NOT DISTINCT FROM n.date
  QUALIFY row_number() OVER (PARTITION BY n.item_id ORDER BY o.version DESC NULLS LAST, o.item_id) = 1
), p{k} AS MATERIALIZED (
  SELECT n.*, o.item_id AS prior_id, o.version AS prior_version, o.price AS prior_price, coalesce(o.is_active, false) AS prior_active FROM d{k} n
  LEFT JOIN s{k} o ON o.partner_id = n.partner_id AND o.name = n.name AND CASE WHEN n.date IS NULL THEN o.date IS NOT NULL ELSE o.date <> n.date END
  QUALIFY row_number() OVER (PARTITION BY n.item_id ORDER BY o.is_active DESC NULLS LAST, o.date DESC NULLS LAST, o.version DESC NULLS LAST, o.item_id) = 1
), g{k} AS (SELECT old_item_id AS item_id FROM p{k} WHERE old_item_id IS NOT NULL UNION SELECT prior_id FROM p{k} WHERE prior_active
), s{k + 1} AS MATERIALIZED (
  SELECT s.* REPLACE (s.is_active AND g.item_id IS NULL AS is_active) FROM s{k} s LEFT JOIN g{k} g ON g.item_id = s.item_id
  UNION ALL SELECT item_id, partner_id, name, date, price, coalesce(old_version, prior_version, 0) + 1, true, coalesce(old_item_id, prior_id),
    coalesce(prior_price <> 0 AND abs(price - prior_price) > 0.5 * abs(prior_price), false) FROM p{k})""")
    return f"""WITH {domain.SQL}, lists AS MATERIALIZED (
  SELECT item_id, partner_id, 'Service ' || CAST(regexp_extract(service_name_raw, '[0-9]+') AS BIGINT) % 25 AS name, CAST(date_trunc('quarter', effective_date) AS DATE) AS date, price, document_id % {LISTS} AS document_no
  FROM items
), {', '.join(steps)}
SELECT item_id, CAST(version AS INTEGER) AS version, previous_item_id, is_active, is_anomaly FROM s{LISTS}"""


SQL = {
    "upsert_documents": lists_sql(), "stream_upsert": lists_sql(),
    "reconcile_created": f"""WITH {domain.SQL}, r AS (SELECT *, CAST(regexp_extract(service_name_raw, '[0-9]+') AS BIGINT) AS n FROM items),
k AS (SELECT item_id, partner_id, coalesce(CAST(service_id AS VARCHAR), 'raw:елка ' || (n % 40)) AS k, date_trunc('year', effective_date) AS date, n % 2 AS version, CASE WHEN n % 5 <> 0 THEN document_id END AS created FROM r)
SELECT item_id, count(*) OVER (PARTITION BY partner_id, k) = 1 OR row_number() OVER (PARTITION BY partner_id, k ORDER BY date DESC NULLS LAST, version DESC, created DESC NULLS LAST, item_id) = 1 AS is_active FROM k""",
}
