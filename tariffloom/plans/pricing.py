"""Queries over conversion, validation and versioning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fx, validate, versioning
from . import domain

RATES = [("USD", "1992-06-01", 150.0), ("USD", "1994-01-15", 210.5), ("USD", "1996-07-01", 330.25), ("USD", "1998-03-01", 462.0), ("RUB", "1993-01-01", 2.5), ("RUB", "1995-09-01", 4.75), ("RUB", "1997-11-15", 5.25), ("RUB", "bad", 1.0)]
AS_OF = "1998-06-30"


def priced(spark, d):
    currency = domain.partners(spark, d).select("partner_id", "currency")
    return domain.items(spark, d).join(currency, "partner_id")


def validated(spark, d):
    return validate.validate(priced(spark, d), fx.rates_table(spark, RATES), AS_OF)


def fx_asof_convert(spark, d):
    done = fx.with_rate(priced(spark, d), fx.rates_table(spark, RATES))
    return done.select("item_id", "currency", F.col("effective_date").cast("string").alias("effective_date"), F.round("fx_rate", 4).alias("fx_rate"), fx.to_kzt(F.col("price"), F.col("fx_rate")).cast("double").alias("kzt"))


def validate_rows(spark, d):
    return validated(spark, d).select("item_id", "currency", *(F.col(c).cast("double").alias(c) for c in ("resident_kzt", "nonresident_kzt", "price_original")), F.array_join("flags", ",").alias("flags"), "needs_review")


def flag_counts(spark, d):
    return validate.flag_counts(validated(spark, d))


def version_chain(spark, d):
    return versioning.chain(domain.items(spark, d)).select("item_id", "version", "previous_item_id", "is_active", "is_anomaly")


SNAPSHOT = "1996-01-01"


def stored(spark, d):
    rows = domain.items(spark, d).where((F.col("effective_date") < SNAPSHOT) | F.col("effective_date").isNull())
    return versioning.chain(rows).select("item_id", "partner_id", "service_name_raw", "effective_date", "price", "version", "is_active", "previous_item_id", "is_anomaly")


def incoming(spark, d, whole=False):
    """Rows of one price list: the next quarter's, and copies of stored rows of document_id divisible by 40 at a higher
    price. whole: all rows from SNAPSHOT on, and copies of all stored rows."""
    rows = domain.items(spark, d).select("item_id", "partner_id", "service_name_raw", "effective_date", "price", "document_id")
    fresh = rows.where((F.col("effective_date") >= SNAPSHOT) & (F.lit(whole) | (F.col("effective_date") < "1996-04-01")))
    again = rows.where(((F.col("effective_date") < SNAPSHOT) | F.col("effective_date").isNull()) & (F.lit(whole) | (F.col("document_id") % 40 == 0)))
    again = again.withColumns({"item_id": F.concat("item_id", F.lit("-again")), "price": (F.col("price") * 2).cast("decimal(14,2)")})
    return fresh.unionByName(again).drop("document_id")


def dedup_same_day(spark, d):
    return versioning.same_day(incoming(spark, d), stored(spark, d)).select("item_id", "old_item_id", F.coalesce("old_version", F.lit(0)).alias("old_version"))


def snapshot_merge(spark, d):
    return versioning.snapshot_merge(stored(spark, d), incoming(spark, d)).select("item_id", "version", "previous_item_id", "is_active", "is_anomaly")


def dedup_same_day_all(spark, d):
    return versioning.same_day(incoming(spark, d, whole=True), stored(spark, d)).select("item_id", "old_item_id", F.coalesce("old_version", F.lit(0)).alias("old_version"))


def snapshot_merge_all(spark, d):
    return versioning.snapshot_merge(stored(spark, d), incoming(spark, d, whole=True)).select("item_id", "version", "previous_item_id", "is_active", "is_anomaly")


def reconcile_active(spark, d):
    rows = versioning.reconcile(versioning.chain(domain.items(spark, d)))
    return rows.select("item_id", "is_active")


def doc_status(spark, d):
    return versioning.document_status(validated(spark, d), domain.documents(spark, d))


def batch_status(spark, d):
    found = versioning.document_status(validated(spark, d), domain.documents(spark, d)).join(domain.documents(spark, d).select("document_id", "batch_id", "parse_status"), "document_id")
    docs = found.withColumn("status", F.when((F.col("parse_status") == "pending") & (F.col("document_id") % 3 == 0) & (F.col("batch_id") < 25), "pending").when(F.col("document_id") % 7 == 0, "error").otherwise(F.col("status")))
    return versioning.batch_status(docs)


QUERIES = {f.__name__: f for f in (fx_asof_convert, validate_rows, flag_counts, version_chain, dedup_same_day, snapshot_merge, dedup_same_day_all, snapshot_merge_all, reconcile_active, doc_status, batch_status)}

PRICED = f"""
WITH {domain.SQL}, rates(currency, rate_date, rate) AS (
  VALUES {', '.join(f"('{c}', DATE '{x}', CAST({r} AS DOUBLE))" for c, x, r in RATES if x != 'bad')}
), priced AS (SELECT i.*, p.currency FROM items i JOIN partners p USING (partner_id)),
joined AS (
  SELECT q.*, r.rate AS dated FROM priced q ASOF LEFT JOIN rates r ON q.currency = r.currency AND q.effective_date >= r.rate_date
), firsts AS (SELECT currency, arg_min(rate, rate_date) AS rate FROM rates GROUP BY currency),
rated AS (
  SELECT a.*, CASE WHEN a.currency = 'KZT' THEN 1.0 WHEN a.effective_date IS NULL THEN CASE a.currency WHEN 'USD' THEN 500.0 ELSE 5.5 END
    ELSE coalesce(a.dated, f.rate) END::DOUBLE AS fx_rate
  FROM joined a LEFT JOIN firsts f ON a.currency = f.currency
), converted AS (
  SELECT *, CAST(round(price * CAST(fx_rate AS DECIMAL(12,4)), 2) AS DECIMAL(18,2)) AS kzt, CAST(round(price_nonresident * CAST(fx_rate AS DECIMAL(12,4)), 2) AS DECIMAL(18,2)) AS non_kzt FROM rated
), validated AS (
  SELECT *, list_filter([CASE WHEN kzt IS NULL OR kzt <= 0 THEN 'INVALID_PRICE' END, CASE WHEN non_kzt < kzt THEN 'NONRESIDENT_LT_RESIDENT' END, CASE WHEN effective_date > DATE '{AS_OF}' THEN 'FUTURE_DATE' END], lambda x: x IS NOT NULL) AS flags FROM converted
), reviewed AS (SELECT *, list_contains(flags, 'INVALID_PRICE') OR list_contains(flags, 'NONRESIDENT_LT_RESIDENT') AS needs_review FROM validated)
"""
LINE = "PARTITION BY partner_id, service_name_raw ORDER BY effective_date ASC NULLS FIRST, item_id"
CHAIN = f"""chained AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS version, lag(item_id) OVER w AS previous_item_id, lead(item_id) OVER w IS NULL AS is_active,
    coalesce(lag(price) OVER w <> 0 AND abs(price - lag(price) OVER w) > 0.5 * abs(lag(price) OVER w), false) AS is_anomaly
  FROM {{rows}} WINDOW w AS ({LINE})
)"""
MERGE = f"""
WITH {domain.SQL}, old_rows AS (SELECT * FROM items WHERE effective_date < DATE '{SNAPSHOT}' OR effective_date IS NULL),
{CHAIN.format(rows='old_rows')}, incoming AS (
  SELECT item_id, partner_id, service_name_raw, effective_date, price FROM items WHERE effective_date >= DATE '{SNAPSHOT}' AND effective_date < DATE '1996-04-01'
  UNION ALL SELECT item_id || '-again', partner_id, service_name_raw, effective_date, CAST(price * 2 AS DECIMAL(14,2)) FROM old_rows WHERE document_id % 40 = 0
), active AS (
  SELECT * FROM chained WHERE is_active QUALIFY row_number() OVER (PARTITION BY partner_id, service_name_raw, effective_date ORDER BY version DESC, item_id) = 1
), dup AS (
  SELECT n.*, a.item_id AS old_item_id, a.version AS old_version FROM incoming n LEFT JOIN active a
  ON n.partner_id = a.partner_id AND n.service_name_raw = a.service_name_raw AND n.effective_date IS NOT DISTINCT FROM a.effective_date
)"""

SQL = {
    "fx_asof_convert": PRICED + "SELECT item_id, currency, CAST(effective_date AS VARCHAR) AS effective_date, round(fx_rate, 4) AS fx_rate, CAST(kzt AS DOUBLE) AS kzt FROM converted",
    "validate_rows": PRICED + "SELECT item_id, currency, CAST(kzt AS DOUBLE) AS resident_kzt, CAST(non_kzt AS DOUBLE) AS nonresident_kzt, CAST(CASE WHEN currency <> 'KZT' THEN price END AS DOUBLE) AS price_original, array_to_string(flags, ',') AS flags, needs_review FROM reviewed",
    "flag_counts": PRICED + "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM validated) GROUP BY flag",
    "version_chain": f"WITH {domain.SQL}, {CHAIN.format(rows='items')} SELECT item_id, version, previous_item_id, is_active, is_anomaly FROM chained",
    "dedup_same_day": MERGE + "SELECT item_id, old_item_id, coalesce(old_version, 0) AS old_version FROM dup",
    "snapshot_merge": MERGE + """, met AS (
  SELECT d.*, c.item_id AS prior_id, c.version AS prior_version, c.price AS prior_price, c.is_active AS prior_active FROM dup d LEFT JOIN chained c
  ON d.partner_id = c.partner_id AND d.service_name_raw = c.service_name_raw AND CASE WHEN d.effective_date IS NULL THEN c.effective_date IS NOT NULL ELSE c.effective_date <> d.effective_date END
  QUALIFY row_number() OVER (PARTITION BY d.item_id ORDER BY c.is_active DESC NULLS LAST, c.effective_date DESC NULLS LAST, c.version DESC NULLS LAST, c.item_id) = 1
), gone AS (SELECT old_item_id AS item_id FROM met WHERE old_item_id IS NOT NULL UNION SELECT prior_id FROM met WHERE prior_active)
SELECT item_id, version, previous_item_id, is_active AND item_id NOT IN (SELECT item_id FROM gone) AS is_active, is_anomaly FROM chained
UNION ALL SELECT item_id, CAST(coalesce(old_version + 1, prior_version + 1, 1) AS INTEGER), coalesce(old_item_id, prior_id), true,
  coalesce(prior_price <> 0 AND abs(price - prior_price) > 0.5 * abs(prior_price), false) FROM met""",
    "reconcile_active": f"""WITH {domain.SQL}, {CHAIN.format(rows='items')}, keyed AS (SELECT *, coalesce(CAST(service_id AS VARCHAR), 'raw:' || lower(service_name_raw)) AS k FROM chained)
SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY partner_id, k) > 1 THEN row_number() OVER (PARTITION BY partner_id, k ORDER BY effective_date DESC NULLS LAST, version DESC, item_id) = 1 ELSE is_active END AS is_active FROM keyed""",
    "doc_status": PRICED + "SELECT d.document_id, count(r.item_id) AS n_items, CASE WHEN count(r.item_id) = 0 THEN 'error' WHEN bool_or(r.needs_review) THEN 'needs_review' ELSE 'done' END AS status FROM docs d LEFT JOIN reviewed r ON d.document_id = r.document_id GROUP BY d.document_id",
    "batch_status": PRICED + """, st AS (SELECT d.document_id, any_value(d.batch_id) AS batch_id, any_value(d.parse_status) AS parse_status, CASE WHEN count(r.item_id) = 0 THEN 'error' WHEN bool_or(r.needs_review) THEN 'needs_review' ELSE 'done' END AS status FROM docs d LEFT JOIN reviewed r ON d.document_id = r.document_id GROUP BY d.document_id),
f AS (SELECT batch_id, CASE WHEN parse_status = 'pending' AND document_id % 3 = 0 AND batch_id < 25 THEN 'pending' WHEN document_id % 7 = 0 THEN 'error' ELSE status END AS status FROM st),
c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('pending', 'processing')) AS pending, count(*) FILTER (status = 'error') AS errors FROM f GROUP BY batch_id)
SELECT batch_id, total, pending, errors, total - pending - errors AS processed, CASE WHEN pending > 0 THEN 'processing' WHEN errors = 0 THEN 'done' WHEN total - pending - errors > 0 THEN 'partial' ELSE 'error' END AS status FROM c""",
}
for _name in ("dedup_same_day", "snapshot_merge"):
    SQL[f"{_name}_all"] = SQL[_name].replace(" AND effective_date < DATE '1996-04-01'", "").replace(" WHERE document_id % 40 = 0", "")
