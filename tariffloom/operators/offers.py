"""Offers: the cheapest price of each service at each provider, filtered, ordered and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shown_price


def build(items: DataFrame, partners: DataFrame, city: str | None = None, low: float | None = None, high: float | None = None, nonresident: bool = False, services: DataFrame | None = None) -> DataFrame:
    """service_id, partner_id, partner_name, city, price, item_id: one offer for each service and provider, the cheapest
    (no price loses, then the smaller item_id). With a price bound, offers without a price go; bounds are inclusive."""
    rows = items.where("is_active AND service_id IS NOT NULL")
    rows = rows if services is None else rows.join(services.select("service_id"), "service_id", "left_semi")
    who = partners.select("partner_id", "partner_name", "city")
    who = who if city is None else who.where(F.lower(F.trim("city")) == city.strip().lower())
    rows = rows.withColumn("price", shown_price(F.col("resident_kzt"), F.col("nonresident_kzt"), nonresident))
    if low is not None or high is not None:
        rows = rows.where(F.col("price").isNotNull())
        rows = rows if low is None else rows.where(F.col("price") >= F.lit(low))
        rows = rows if high is None else rows.where(F.col("price") <= F.lit(high))
    first = Window.partitionBy("service_id", "partner_id").orderBy(F.col("price").asc_nulls_last(), "item_id")
    best = rows.select("service_id", "partner_id", "price", "item_id").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return best.join(who, "partner_id")


def ranked(offers: DataFrame, n: int | None = 6, descending: bool = False) -> DataFrame:
    """Each service's first n offers by price, those without one last either way, with their rank."""
    price = F.col("price").desc_nulls_last() if descending else F.col("price").asc_nulls_last()
    out = offers.withColumn("rank", F.row_number().over(Window.partitionBy("service_id").orderBy(price, "partner_id")))
    return out if n is None else out.where(F.col("rank") <= n)


def summary(offers: DataFrame) -> DataFrame:
    """Number of providers, lowest and highest price of each service."""
    return offers.groupBy("service_id").agg(F.count("*").alias("n_offers"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def cheapest(offers: DataFrame) -> DataFrame:
    return ranked(offers, 1).drop("rank")
