"""Queries over sources, sections, requests and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices
from ..operators import assistant, tables, versioning
from ..session import workspace
from ..sources import files
from ..sources.keyed import KeyedTable
from ..streaming import ingest
from . import domain, lists, matching


def stream_ingest(spark, d):
    at = workspace(spark)
    rows = domain.items_of(ingest.parquet_stream(spark, f"{d}/lineitem.parquet"))
    schema = versioning.reconcile(domain.items(spark, d).withColumns({"is_active": F.lit(True), "version": F.lit(1)})).schema
    table = KeyedTable(spark, f"{at}/table", schema, ("partner_id",), parts=16)
    return ingest.ingest(rows, table, f"{at}/checkpoint").read().select("item_id", "is_active")


def detect_format(spark, d):
    pages = domain.read(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".xls", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("name"), "page_id", "html")
    heads = F.element_at(F.array(F.unhex(F.lit("255044462D312E34")), F.unhex(F.lit("504B030414000000")), F.unhex(F.lit("D0CF11E0A1B11AE1")), F.lit("plain").cast("binary")), (F.col("page_id") % 4 + 1).cast("int"))
    content = F.concat(heads, F.when(F.col("page_id") % 8 == 1, F.lit("word/document.xml").cast("binary")).when(F.col("page_id") % 8 == 5, F.lit("xl/workbook.xml").cast("binary")).otherwise(F.lit("").cast("binary")))
    return pages.select("page_id", files.detect_format(F.col("name"), content).alias("file_format"), files.fingerprint(F.col("html").cast("binary")).alias("sha256"))


def section_paths(spark, d):
    """Orders as tables of rows in which some rows are headings of three depths."""
    rows = domain.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.row_number().over(tables.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")).alias("row_idx"), "l_partkey")
    kind = F.col("l_partkey") % 16
    named = rows.withColumns({"label": F.when(kind == 0, F.concat(F.lit("A"), F.col("l_partkey").cast("string"))).when(kind == 1, F.concat(F.lit("B"), F.col("l_partkey").cast("string"))).when(kind == 2, F.concat(F.lit("C"), F.col("l_partkey").cast("string"))), "depth": F.when(kind <= 2, kind.cast("int"))})
    return tables.section_paths(named, 3).select("table_id", "row_idx", F.array_join("section_path", "/").alias("path"))


def assistant_parse(spark, d):
    turns = domain.read(spark, d, "conversations").where("role = 'user'")
    done = assistant.parse_all(turns)
    return done.select("conv_id", "turn", "preferences.intent", "preferences.city", "preferences.language", "preferences.max_price", F.size("preferences.terms").alias("n_terms"))


def assistant_answer(spark, d):
    return assistant.answer("show top 3 small gizmo under 50000000", domain.services(spark, d), domain.partners(spark, d), lists.active_items(spark, d)).select("service_id", "service_name", "n_offers", F.col("min_price").cast("double").alias("min_price"))


def item_headers(spark, d):
    name = F.element_at(F.array(F.lit("КАРДИОЛОГИЯ ВЗРОСЛАЯ"), F.lit("Раздел 5"), F.lit("Консультации:"), F.lit("ОАК"), F.col("p_name"), F.lit("2) Блок")), (F.col("p_partkey") % 6 + 1).cast("int"))
    from ..functions.text import normalise

    rows = domain.read(spark, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", prices.is_item_header(F.col("name"), normalise(F.col("name")), F.col("p_partkey") % 5 == 0, F.lit(False)).alias("is_header"))


QUERIES = {f.__name__: f for f in (stream_ingest, detect_format, section_paths, assistant_parse, assistant_answer, item_headers)}
D = f"WITH {domain.SQL}"
SQL = {
    "stream_ingest": D + """, k AS (SELECT *, coalesce(CAST(service_id AS VARCHAR), 'raw:' || lower(service_name_raw)) AS key FROM items)
SELECT item_id, row_number() OVER (PARTITION BY partner_id, key ORDER BY effective_date DESC NULLS LAST, item_id) = 1 AS is_active FROM k""",
    "detect_format": "SELECT page_id, CASE WHEN page_id % 8 = 5 THEN 'xlsx' ELSE ['pdf', 'docx', 'xls', 'unknown'][page_id % 4 + 1] END AS file_format, sha256(html) AS sha256 FROM pages",
    "section_paths": """WITH r AS (SELECT l_suppkey AS table_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS INTEGER) AS row_idx, l_partkey % 16 AS k, l_partkey FROM lineitem),
h AS (SELECT *, last_value(CASE WHEN k = 0 THEN row_idx END IGNORE NULLS) OVER w AS i0, last_value(CASE WHEN k = 1 THEN row_idx END IGNORE NULLS) OVER w AS i1, last_value(CASE WHEN k = 2 THEN row_idx END IGNORE NULLS) OVER w AS i2,
  last_value(CASE WHEN k = 0 THEN l_partkey END IGNORE NULLS) OVER w AS p0, last_value(CASE WHEN k = 1 THEN l_partkey END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN k = 2 THEN l_partkey END IGNORE NULLS) OVER w AS p2
  FROM r WINDOW w AS (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT table_id, row_idx, concat_ws('/', 'A' || p0, CASE WHEN i1 > coalesce(i0, -1) THEN 'B' || p1 END, CASE WHEN i2 > greatest(coalesce(i0, -1), coalesce(i1, -1)) THEN 'C' || p2 END) AS path FROM h""",
    "assistant_answer": lists.ACTIVE + f""", {matching.hits("SELECT 0 AS query_id, 'small gizmo' AS query", matching.SERVICE_TEXTS)}
SELECT owner AS service_id, any_value(owner_name) AS service_name, count(*) AS n_offers, CAST(min(price) AS DOUBLE) AS min_price FROM hits JOIN offers ON service_id = owner WHERE price <= 50000000 GROUP BY owner ORDER BY min(price), owner LIMIT 3""",
    "item_headers": "SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 6 IN (0, 1, 2, 5) AS is_header FROM part",
}
