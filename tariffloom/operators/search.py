"""Search over the catalogue and providers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workspace
from .searchindex import search

LEAST, MOST, SURE = 60.0, 25, 90.0


def boost(query: str, text: Column) -> Column:
    """130 for an equal text, 115 for one that starts with the query, 100 for one that holds it; else null."""
    q, t = F.lit(query.lower().strip()), F.lower(text)
    return F.when(t == q, 130.0).when(F.startswith(t, q), 115.0).when(F.contains(t, q), 100.0)


def texts_of(*columns: Column, lists: tuple[Column, ...] = ()) -> Column:
    return F.filter(reduce(lambda a, b: F.concat(a, F.coalesce(b, F.array().cast("array<string>"))), lists, F.array(*columns)), lambda t: t.isNotNull() & (t != ""))


def gate(query: str, texts: Column) -> Column:
    """Whether any token of the query is part of any text."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    return F.exists(texts, lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(w)) for w in words], F.lit(False)))


def service_texts(catalogue: DataFrame) -> DataFrame:
    """owner, owner_name, text, is_name of active services: their names, categories and synonyms."""
    texts = F.concat(F.array(F.struct(F.col("service_name").alias("text"), F.lit(True).alias("is_name")), F.struct(F.col("category").alias("text"), F.lit(False).alias("is_name"))), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), F.lit(False).alias("is_name"))))
    return catalogue.where("is_active").select(F.col("service_id").alias("owner"), F.col("service_name").alias("owner_name"), F.explode(texts).alias("t")).select("owner", "owner_name", "t.*")


def services_of(queries: DataFrame, catalogue: DataFrame, items: DataFrame | None = None, limit: int = MOST) -> DataFrame:
    """query_id, rank, service_id, service_name, score of many queries (query_id, query), and of active items partner_count,
    min_price, max_price."""
    top = search(queries, service_texts(catalogue), limit).select("query_id", "rank", F.col("owner").alias("service_id"), F.col("owner_name").alias("service_name"), "score")
    if items is None:
        return top
    at = workspace(queries.sparkSession)  # hits are read twice from here on, and found once
    top.write.parquet(at)
    return priced(queries.sparkSession.read.schema(top.schema).parquet(at), items)


def few(rows: DataFrame) -> DataFrame:
    """The hits of one query, which its limit bounds, as a table of their own: whatever uses them doesn't search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def priced(top: DataFrame, items: DataFrame) -> DataFrame:
    """Hits with partner_count, min_price and max_price of their services' active items, each service's added up once."""
    hit = top.select("service_id").distinct()
    prices = items.where("is_active").join(hit, "service_id", "left_semi").groupBy("service_id").agg(F.countDistinct("partner_id").alias("partner_count"), F.min("resident_kzt").alias("min_price"), F.max("resident_kzt").alias("max_price"))
    return top.join(prices, "service_id", "left").withColumn("partner_count", F.coalesce("partner_count", F.lit(0)))


def services(query: str, catalogue: DataFrame, items: DataFrame | None = None, fuzzy: bool = True, limit: int = MOST) -> DataFrame:
    """service_id, service_name, category, score, and of active items partner_count, min_price, max_price; best first.

    Only rows that pass the token gate, or whose name alone scores SURE, count. Without fuzzy, boosts alone count. A blank
    query finds nothing."""
    if fuzzy:
        asked = catalogue.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
        hits = few(services_of(asked, catalogue, None, limit).drop("query_id", "rank"))  # first, so that not the catalogue is broadcast
        top = few(catalogue.select("service_id", "category").join(F.broadcast(hits), "service_id").select("service_id", "service_name", "score", "category"))
        found = top if items is None else priced(top, items)
        return found.orderBy(F.col("score").desc(), "service_name", "service_id")
    rows = catalogue.where("is_active").withColumn("_texts", texts_of(F.col("service_name"), F.col("category"), lists=(F.col("synonyms"),)))
    if not query.strip():
        rows = rows.limit(0)
    best = F.array_max(F.transform("_texts", lambda t: boost(query, t)))
    rows = rows.withColumns({"_boost": best, "_gate": gate(query, F.col("_texts"))})
    rows, score = rows.where("_gate"), F.coalesce("_boost", F.lit(0.0))
    top = rows.withColumn("score", F.round(score, 2)).where(F.col("score") >= LEAST).orderBy(F.col("score").desc(), "service_name", "service_id").limit(limit)
    top = top.select("service_id", "service_name", "category", "score")
    if items is None:
        return top
    return priced(top, items).orderBy(F.col("score").desc(), "service_name", "service_id")


def providers(query: str, partners: DataFrame, items: DataFrame, limit: int = MOST) -> DataFrame:
    """Active providers by name or city, with their number of active matched services; best first."""
    text = lambda c, own: F.struct(F.col(c).alias("text"), F.lit(own).alias("is_name"))
    texts = partners.where("is_active").select(F.col("partner_id").alias("owner"), F.col("partner_name").alias("owner_name"), F.explode(F.array(text("partner_name", True), text("city", False))).alias("t")).select("owner", "owner_name", "t.*")
    asked = partners.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    top = partners.select("partner_id", "partner_name", "city").join(F.broadcast(few(search(asked, texts, limit).select(F.col("owner").alias("partner_id"), "score"))), "partner_id").select("partner_id", "partner_name", "city", "score")
    counts = items.where("is_active AND service_id IS NOT NULL").groupBy("partner_id").agg(F.countDistinct("service_id").alias("service_count"))
    return top.join(counts, "partner_id", "left").withColumn("service_count", F.coalesce("service_count", F.lit(0))).orderBy(F.col("score").desc(), "partner_name", "partner_id")
