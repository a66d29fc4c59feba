"""Filtered, joined and paged lists of services, providers, documents and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = "￿"  # sorts after every category


def same(a: Column, text: str | None) -> Column:
    return F.lower(F.trim(a)) == (text or "").strip().lower()


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an ordered list; the limit is held between 1 and 10000."""
    return df.offset(max(0, offset)).limit(min(10_000, max(1, limit)))


def list_services(services: DataFrame, category: str | None = None, q: str | None = None, is_active: bool | None = True) -> DataFrame:
    """By exact category without case, and a substring of the name or of any synonym; ordered by name."""
    rows = services
    if is_active is not None:
        rows = rows.where(F.col("is_active") == is_active)
    if category:
        rows = rows.where(same(F.col("category"), category))
    if q and q.strip():
        part = F.lit(q.strip().lower())
        rows = rows.where(F.contains(F.lower("service_name"), part) | F.coalesce(F.exists("synonyms", lambda s: F.contains(F.lower(s), part)), F.lit(False)))
    return rows.orderBy("service_name", "service_id")


def list_partners(partners: DataFrame, city: str | None = None, name: str | None = None, is_active: bool | None = True) -> DataFrame:
    rows = partners if is_active is None else partners.where(F.col("is_active") == is_active)
    if city:
        rows = rows.where(same(F.col("city"), city))
    if name:
        rows = rows.where(F.contains(F.lower("partner_name"), F.lit(name.strip().lower())))
    return rows.orderBy("partner_name", "partner_id")


def list_documents(documents: DataFrame, status: str | None = None, batch_id=None) -> DataFrame:
    rows = documents if status is None else documents.where(F.col("parse_status") == status)
    rows = rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)
    return rows.orderBy(F.col("effective_date").desc_nulls_last(), "document_id")


def partners_of_services(items: DataFrame, partners: DataFrame) -> DataFrame:
    """Active priced items with their provider; for one service filter by service_id, then order by price, nulls last."""
    return items.where("is_active AND service_id IS NOT NULL").join(partners.select("partner_id", "partner_name", "city"), "partner_id")


def services_of_partner(items: DataFrame, services: DataFrame) -> DataFrame:
    """Active items with their service, if matched: category and shown name for the order (no or empty category last)."""
    rows = items.where("is_active").join(services.select("service_id", "service_name", "category"), "service_id", "left")
    return rows.withColumns({"order_category": F.coalesce(F.lower(F.nullif("category", F.lit(""))), F.lit(LAST)), "order_name": F.lower(F.coalesce("service_name", "service_name_raw"))})


def unmatched_queue(items: DataFrame, partners: DataFrame) -> DataFrame:
    """Unmatched items and such under review with their provider, the latter first."""
    rows = items.where(F.col("match_status").isin("unmatched", "needs_review")).join(partners.select("partner_id", "partner_name"), "partner_id", "left")
    return rows.withColumn("queue", F.when(F.col("match_status") == "needs_review", 0).otherwise(1)).orderBy("queue", "item_id")


def review_queue(items: DataFrame, partners: DataFrame, services: DataFrame) -> DataFrame:
    """Unverified items under review with provider and service, if any."""
    rows = items.where("needs_review AND NOT is_verified")
    return rows.join(partners.select("partner_id", "partner_name"), "partner_id", "left").join(services.select("service_id", "service_name"), "service_id", "left")


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not null, sorted."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def any_text_contains(rows: DataFrame, q: str, *columns: str) -> DataFrame:
    """Rows of which any of the columns holds the text, without case."""
    return rows.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(q.strip().lower())))
