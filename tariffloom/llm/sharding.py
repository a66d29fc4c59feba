"""Sharding by weighted rendezvous hashing of record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = 10_000  # slots in one array
SLICES = 4096  # counted pieces of each shard, so that slots need no sort of a whole shard in one task


def hashed_unit(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, so that any engine can recompute it."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score -weight / ln(hash(key, shard)); one more shard can only take keys into itself.

    Ties go to the smaller shard; a null key hashes as the word null."""
    word = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [-F.lit(float(w)) / F.ln(hashed_unit(word, F.lit(str(n)))) for n, w in enumerate(weights)]
    return F.array_position(F.array(*scores), F.greatest(*scores) if len(scores) > 1 else scores[0]).cast("int") - 1


def shard(docs: DataFrame, shards: int = 8, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law "key": the key, the number of shards and their weights decide. size is the text's UTF-8 bytes (null: none) plus
    1. slot numbers the rows of a shard without gaps from 0, by slice, key, checksum and size; repeated rows get a slot
    each. Slots come from counts: a shard is cut into SLICES by hash (rows of one key are spread by their content), rows
    are ranked inside a slice only, and the counts of earlier slices are added. The texts are not shuffled. grown_shard
    is the shard with one more shard, of weight 1. Null keys and texts are kept; an empty table gives no rows; columns
    other than key and text don't matter.
    """
    weights = weights or [1.0] * shards
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    )
    spread = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.lit("slice")))
    rows = rows.withColumn("slice", F.conv(F.substring(spread, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))  # at most SLICES rows for each shard
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    equal = rows.groupBy("shard", "slice", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count("*").alias("copies"))  # repeated rows can't fill a slice
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("above", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    first = F.coalesce("before", F.lit(0)) + F.col("above")
    placed = ranked.join(F.broadcast(before.drop("n")), ["shard", "slice"]).withColumns({"first": first.cast("long"), "last": (first + F.col("copies") - 1).cast("long")})
    # slots of equal rows come in runs of at most RUN, so that no array is as long as a row is often
    placed = placed.withColumn("run", F.explode(F.sequence("first", "last", F.lit(RUN).cast("long"))))
    slot = F.explode(F.sequence("run", F.least("last", F.col("run") + RUN - 1))).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return shard(table(spark, sf_dir, "documents"), 8)
