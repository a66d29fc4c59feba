"""Dashboards, breakdowns and price history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_CATEGORY, NO_CITY, median, or_unknown


def dashboard(partners: DataFrame, services: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counts and rates, from one aggregate for each table; rates are 0 where there is nothing to divide."""
    active = F.col("is_active")
    matched = F.col("match_status").isin("matched_auto", "matched_manual")
    parts = [
        partners.agg(F.count("*").alias("partners_total"), F.count_if(active).alias("partners_active")),
        services.agg(F.count("*").alias("services_total")),
        documents.agg(F.count("*").alias("documents_total"), F.count_if(F.col("parse_status") == "done").alias("documents_done"), F.count_if(F.col("parse_status") == "pending").alias("documents_pending"), F.count_if(F.col("parse_status") == "needs_review").alias("documents_review")),
        items.where(active).agg(F.count("*").alias("items_active"), F.count_if(matched).alias("items_matched"), F.count_if(F.col("match_status") == "unmatched").alias("items_unmatched"), F.count_if("needs_review").alias("items_review"), F.count_if("is_verified").alias("items_verified"), F.count_if(F.size("flags") > 0).alias("items_flagged")),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # of single rows
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.col(c).cast("double"), F.col("items_active").cast("double")), 4), F.lit(0.0))
    return one.withColumns({"match_rate": rate("items_matched"), "review_rate": rate("items_review"), "flag_rate": rate("items_flagged")})


def by_category(items: DataFrame, services: DataFrame, top: int | None = 10) -> DataFrame:
    """Active items for each category of their service, the most first, with the share of the largest."""
    rows = items.where("is_active").join(services.select("service_id", or_unknown(F.col("category")).alias("category")), "service_id")
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 4))  # a row for each category
    ordered = shares.orderBy(F.col("n").desc(), "category")
    return ordered if top is None else ordered.limit(top)


def by_city(partners: DataFrame) -> DataFrame:
    return partners.groupBy(or_unknown(F.col("city"), NO_CITY).alias("city")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "city")


def by_format(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, active items, matched ones and their percentage for each file format."""
    docs = documents.groupBy("file_format").agg(F.count("*").alias("documents"))
    matched = F.col("match_status").isin("matched_auto", "matched_manual")
    rows = items.where("is_active").join(documents.select("document_id", "file_format"), "document_id").groupBy("file_format").agg(F.count("*").alias("items"), F.count_if(matched).alias("matched"))
    out = docs.join(rows, "file_format", "left").na.fill(0, ["items", "matched"])
    return out.withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * F.col("matched"), F.col("items").cast("double")), 1), F.lit(0.0)))


def by_status(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def chains(items: DataFrame, least: int = 2) -> DataFrame:
    """Lines (partner and raw name) with several versions."""
    return items.groupBy("partner_id", "service_name_raw").agg(F.count("*").alias("versions")).where(F.col("versions") >= least)


def price_history(items: DataFrame) -> DataFrame:
    """For each service, provider and date: median resident and nonresident prices, whether any is an anomaly, the highest version.

    Inactive rows count; a null date is a group of its own."""
    rows = items.where("service_id IS NOT NULL").groupBy("service_id", "partner_id", "effective_date").agg(
        median(F.collect_list("resident_kzt")).alias("resident_median"), median(F.collect_list("nonresident_kzt")).alias("nonresident_median"),
        F.bool_or("is_anomaly").alias("is_anomaly"), F.max("version").alias("version"), F.count("*").alias("n_items"),
    )
    return rows


def created_updated(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """How many incoming keys are new and how many exist."""
    keys = incoming.select(key).distinct()
    have = existing.select(key).distinct().withColumn("_have", F.lit(True))
    return keys.join(have, key, "left").agg(F.count_if(F.col("_have").isNull()).alias("created"), F.count_if("_have").alias("updated"))


def recent(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n newest rows by the first key, ties by the others."""
    return rows.orderBy(F.col(keys[0]).desc(), *keys[1:]).limit(n)


def grouped(rows: DataFrame, label: str) -> DataFrame:
    """label, n and place: groups in the Russian order of their labels, what has none last. There are as few rows as labels."""
    counts = rows.groupBy(F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(NO_CATEGORY)).alias(label)).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col(label) == NO_CATEGORY, F.collate(label, "ru"), label)))


def recognition_quality(words: DataFrame) -> DataFrame:
    """document_id, mean_confidence, priced_share of recognised words (document_id, confidence, priced)."""
    return words.groupBy("document_id").agg(F.avg("confidence").alias("mean_confidence"), F.avg(F.col("priced").cast("double")).alias("priced_share"))


def longest_times(documents: DataFrame) -> DataFrame:
    """text_seconds, scan_seconds: the longest parse of a text document and of a scan (file_format, seconds)."""
    scan = F.col("file_format") == "scan_pdf"
    return documents.agg(F.max(F.when(~scan, F.col("seconds"))).alias("text_seconds"), F.max(F.when(scan, F.col("seconds"))).alias("scan_seconds"))
