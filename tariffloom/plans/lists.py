"""Queries over lists, offers, statistics and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import listing, offers, statistics, tree, versioning
from . import domain, pricing


def active_items(spark, d):
    """Validated rows with versions, and one active row of each line."""
    rows = pricing.validated(spark, d)
    return versioning.reconcile(versioning.chain(rows, price="resident_kzt"))


def service_partners(spark, d):
    rows = listing.partners_of_services(active_items(spark, d), domain.partners(spark, d))
    return rows.orderBy("service_id", F.col("resident_kzt").asc_nulls_last(), "item_id").select("service_id", "partner_id", "partner_name", "city", F.col("resident_kzt").cast("double").alias("price"))


def partner_services(spark, d):
    rows = listing.services_of_partner(active_items(spark, d), domain.services(spark, d))
    return rows.orderBy("partner_id", "order_category", "order_name", "item_id").select("partner_id", "item_id", "order_category", "order_name", "match_status")


def unmatched_queue(spark, d):
    return listing.unmatched_queue(domain.items(spark, d), domain.partners(spark, d)).select("item_id", "partner_name", "match_status", "queue")


def review_queue(spark, d):
    rows = listing.review_queue(active_items(spark, d), domain.partners(spark, d), domain.services(spark, d))
    return rows.select("item_id", "partner_name", "service_name", F.array_join("flags", ",").alias("flags"))


def list_services(spark, d):
    found = listing.list_services(domain.services(spark, d), category="standard", q="re")
    return listing.page(found, 50, 10).select("service_id", "service_name", "category")


def list_partners(spark, d):
    return listing.list_partners(domain.partners(spark, d), name="supplier").select("partner_id", "partner_name", "city")


def documents_page(spark, d):
    return listing.page(listing.list_documents(domain.documents(spark, d), "pending"), 200, 100).select("document_id", "batch_id", "file_format")


def city_facet(spark, d):
    return listing.facet(domain.partners(spark, d), "city")


def all_offers(spark, d):
    return offers.build(active_items(spark, d), domain.partners(spark, d))


def cheapest_offers(spark, d):
    best = offers.cheapest(all_offers(spark, d))
    return best.select("service_id", "partner_id", "partner_name", F.col("price").cast("double").alias("price"))


def offers_topk(spark, d):
    return offers.ranked(all_offers(spark, d), 3).select("service_id", "rank", "partner_id", F.col("price").cast("double").alias("price"))


def offers_summary(spark, d):
    found = offers.summary(offers.build(active_items(spark, d), domain.partners(spark, d), low=1000, high=5_000_000, nonresident=True))
    return found.select("service_id", "n_offers", F.col("min_price").cast("double").alias("min_price"), F.col("max_price").cast("double").alias("max_price"))


def dashboard(spark, d):
    return statistics.dashboard(domain.partners(spark, d), domain.services(spark, d), domain.documents(spark, d), active_items(spark, d))


def by_category_top10(spark, d):
    return statistics.by_category(active_items(spark, d), domain.services(spark, d))


def by_city(spark, d):
    return statistics.by_city(domain.partners(spark, d))


def format_quality(spark, d):
    return statistics.by_format(active_items(spark, d), domain.documents(spark, d))


def match_status_counts(spark, d):
    return statistics.by_status(domain.items(spark, d), "match_status")


def version_lines(spark, d):
    return statistics.chains(domain.items(spark, d))


def price_history(spark, d):
    rows = statistics.price_history(active_items(spark, d))
    return rows.select("service_id", "partner_id", F.coalesce(F.col("effective_date").cast("string"), F.lit("")).alias("day"), F.col("resident_median").cast("double").alias("resident_median"), F.col("nonresident_median").cast("double").alias("nonresident_median"), "is_anomaly", "version", "n_items")


def category_tree(spark, d):
    leaves = domain.services(spark, d).where("is_active").select(text.category_path(F.lit(None).cast("array<string>"), F.col("category"), F.col("specialty")).alias("path"))
    return tree.build(leaves)


def partner_tree(spark, d):
    return tree.build(partner_leaves(spark, d).where(F.col("path")[0].cast("long") < 40))


def partner_tree_all(spark, d):
    """The trees of all providers; partner_tree has those below 40, as its SQL does."""
    return tree.build(partner_leaves(spark, d))


def partner_leaves(spark, d):
    rows = listing.services_of_partner(active_items(spark, d), domain.services(spark, d))
    return rows.select(F.concat(F.array(F.col("partner_id").cast("string")), text.effective_path(F.lit(None).cast("array<string>"), F.col("category"))).alias("path"))


QUERIES = {f.__name__: f for f in (service_partners, partner_services, unmatched_queue, review_queue, list_services, list_partners, documents_page, city_facet, cheapest_offers, offers_topk, offers_summary, dashboard, by_category_top10, by_city, format_quality, match_status_counts, version_lines, price_history, category_tree, partner_tree, partner_tree_all)}

ACTIVE = pricing.PRICED + """, chained AS (
  SELECT *, kzt AS resident_kzt, non_kzt AS nonresident_kzt, CAST(row_number() OVER w AS INTEGER) AS version,
    coalesce(lag(kzt) OVER w <> 0 AND abs(kzt - lag(kzt) OVER w) > 0.5 * abs(lag(kzt) OVER w), false) AS is_anomaly, lead(item_id) OVER w IS NULL AS last_one,
    coalesce(CAST(service_id AS VARCHAR), 'raw:' || lower(service_name_raw)) AS k
  FROM reviewed WINDOW w AS (PARTITION BY partner_id, service_name_raw ORDER BY effective_date ASC NULLS FIRST, item_id)
), items_all AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY partner_id, k) > 1 THEN row_number() OVER (PARTITION BY partner_id, k ORDER BY effective_date DESC NULLS LAST, version DESC, item_id) = 1 ELSE last_one END AS is_active FROM chained
), act AS (SELECT * FROM items_all WHERE is_active),
offers AS (
  SELECT a.service_id, a.partner_id, p.partner_name, p.city, a.item_id, coalesce(resident_kzt, nonresident_kzt) AS price FROM act a JOIN partners p USING (partner_id) WHERE service_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a.service_id, a.partner_id ORDER BY coalesce(resident_kzt, nonresident_kzt) ASC NULLS LAST, a.item_id) = 1
)
"""
D = f"WITH {domain.SQL} "
TREE = """, n AS (SELECT p[1:i] AS prefix, CAST(i AS INTEGER) AS depth, i = len(p) AS direct FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM leaves WHERE len(p) > 0))
SELECT array_to_string(prefix, ' / ') AS node, prefix[-1] AS name, depth, array_to_string(prefix[1:depth - 1], ' / ') AS parent, count(*) AS n_leaves, count(*) FILTER (direct) AS n_direct FROM n GROUP BY prefix, depth"""
MATCHED = "match_status IN ('matched_auto', 'matched_manual')"

SQL = {
    "service_partners": ACTIVE + "SELECT a.service_id, a.partner_id, partner_name, city, CAST(resident_kzt AS DOUBLE) AS price FROM act a JOIN partners p USING (partner_id) WHERE service_id IS NOT NULL",
    "partner_services": ACTIVE + "SELECT a.partner_id, item_id, coalesce(lower(nullif(s.category, '')), chr(65535)) AS order_category, lower(coalesce(s.service_name, service_name_raw)) AS order_name, match_status FROM act a LEFT JOIN services s USING (service_id)",
    "unmatched_queue": D + "SELECT item_id, partner_name, match_status, CASE WHEN match_status = 'needs_review' THEN 0 ELSE 1 END AS queue FROM items LEFT JOIN partners USING (partner_id) WHERE match_status IN ('unmatched', 'needs_review')",
    "review_queue": ACTIVE + "SELECT item_id, partner_name, service_name, array_to_string(flags, ',') AS flags FROM items_all i LEFT JOIN partners USING (partner_id) LEFT JOIN services s USING (service_id) WHERE needs_review AND NOT is_verified",
    "list_services": D + "SELECT service_id, service_name, category FROM services WHERE is_active AND lower(category) = 'standard' AND (contains(lower(service_name), 're') OR len(list_filter(synonyms, lambda s: contains(lower(s), 're'))) > 0) ORDER BY service_name, service_id LIMIT 50 OFFSET 10",
    "list_partners": D + "SELECT partner_id, partner_name, city FROM partners WHERE is_active AND contains(lower(partner_name), 'supplier')",
    "documents_page": D + "SELECT document_id, batch_id, file_format FROM docs WHERE parse_status = 'pending' ORDER BY effective_date DESC NULLS LAST, document_id LIMIT 200 OFFSET 100",
    "city_facet": D + "SELECT DISTINCT city FROM partners WHERE city IS NOT NULL",
    "cheapest_offers": ACTIVE + "SELECT service_id, partner_id, partner_name, CAST(price AS DOUBLE) AS price FROM offers QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY price ASC NULLS LAST, partner_id) = 1",
    "offers_topk": ACTIVE + "SELECT service_id, CAST(row_number() OVER (PARTITION BY service_id ORDER BY price ASC NULLS LAST, partner_id) AS INTEGER) AS rank, partner_id, CAST(price AS DOUBLE) AS price FROM offers QUALIFY rank <= 3",
    "offers_summary": ACTIVE + """, o AS (SELECT service_id, partner_id, min(coalesce(nonresident_kzt, resident_kzt)) AS price FROM act JOIN partners USING (partner_id) WHERE service_id IS NOT NULL AND coalesce(nonresident_kzt, resident_kzt) BETWEEN 1000 AND 5000000 GROUP BY ALL)
SELECT service_id, count(*) AS n_offers, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price FROM o GROUP BY service_id""",
    "dashboard": ACTIVE + f""", a AS (SELECT count(*) AS items_active, count(*) FILTER ({MATCHED}) AS items_matched, count(*) FILTER (match_status = 'unmatched') AS items_unmatched, count(*) FILTER (needs_review) AS items_review, count(*) FILTER (is_verified) AS items_verified, count(*) FILTER (len(flags) > 0) AS items_flagged FROM act)
SELECT (SELECT count(*) FROM partners) AS partners_total, (SELECT count(*) FROM partners WHERE is_active) AS partners_active, (SELECT count(*) FROM services) AS services_total, (SELECT count(*) FROM docs) AS documents_total,
  (SELECT count(*) FROM docs WHERE parse_status = 'done') AS documents_done, (SELECT count(*) FROM docs WHERE parse_status = 'pending') AS documents_pending, (SELECT count(*) FROM docs WHERE parse_status = 'needs_review') AS documents_review,
  a.*, round(items_matched / items_active, 4) AS match_rate, round(items_review / items_active, 4) AS review_rate, round(items_flagged / items_active, 4) AS flag_rate FROM a""",
    "by_category_top10": ACTIVE + ", c AS (SELECT coalesce(nullif(category, ''), 'Без категории') AS category, count(*) AS n FROM act JOIN services USING (service_id) GROUP BY 1) SELECT category, n, round(n / max(n) OVER (), 4) AS share FROM c ORDER BY n DESC, category LIMIT 10",
    "by_city": D + "SELECT coalesce(nullif(city, ''), 'Неизвестно') AS city, count(*) AS n FROM partners GROUP BY 1",
    "format_quality": ACTIVE + f""", r AS (SELECT file_format, count(*) AS items, count(*) FILTER ({MATCHED}) AS matched FROM act JOIN docs USING (document_id) GROUP BY 1)
SELECT file_format, d.documents, coalesce(items, 0) AS items, coalesce(matched, 0) AS matched, coalesce(round(100.0 * CAST(matched AS DOUBLE) / items, 1), 0) AS percent FROM (SELECT file_format, count(*) AS documents FROM docs GROUP BY 1) d LEFT JOIN r USING (file_format)""",
    "match_status_counts": D + "SELECT match_status, count(*) AS n FROM items GROUP BY 1",
    "version_lines": D + "SELECT partner_id, service_name_raw, count(*) AS versions FROM items GROUP BY ALL HAVING count(*) > 1",
    "price_history": ACTIVE + "SELECT service_id, partner_id, coalesce(CAST(effective_date AS VARCHAR), '') AS day, round(median(CAST(resident_kzt AS DOUBLE)), 3) AS resident_median, round(median(CAST(nonresident_kzt AS DOUBLE)), 3) AS nonresident_median, bool_or(is_anomaly) AS is_anomaly, max(version) AS version, count(*) AS n_items FROM items_all WHERE service_id IS NOT NULL GROUP BY service_id, partner_id, effective_date",
    "category_tree": D + ", leaves AS (SELECT list_filter([category, specialty], lambda x: x IS NOT NULL AND x <> '') AS p FROM services WHERE is_active)" + TREE,
    "partner_tree": ACTIVE + ", leaves AS (SELECT [CAST(a.partner_id AS VARCHAR), coalesce(nullif(s.category, ''), 'Без категории')] AS p FROM act a LEFT JOIN services s USING (service_id) WHERE a.partner_id < 40)" + TREE,
}
SQL["partner_tree_all"] = SQL["partner_tree"].replace(" WHERE a.partner_id < 40", "")
