"""Incremental ingestion: a stream of priced rows kept as a table in which one row of each line is active."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upserts, versioning
from ..sources.keyed import PART, Change, KeyedTable


#: Hashes of repeated item_ids that the driver may hold.
REPEATED = 10_000


def distinct(batch: DataFrame) -> DataFrame:
    """One row of each item_id. Rows are shuffled for it only if their item_id's hash is met again; of all others just the hash
    is. Where too many are met again, all rows are shuffled."""
    mark = F.xxhash64("item_id")
    again = batch.groupBy(mark.alias("_mark")).agg(F.count("*").alias("_n")).where("_n > 1").select("_mark").limit(REPEATED + 1).collect()
    if not again:
        return batch
    if len(again) > REPEATED:
        return batch.dropDuplicates(["item_id"])
    marks = F.broadcast(batch.sparkSession.createDataFrame(again, "_mark long"))
    once = batch.join(marks, mark == F.col("_mark"), "left_anti")
    return once.unionByName(batch.join(marks, mark == F.col("_mark"), "left_semi").dropDuplicates(["item_id"]))


def reconciled(stored: DataFrame | None, batch: DataFrame, part: Column, parts: int | None = None) -> DataFrame:
    """Rows of the parts that a batch touches: repeated item_ids are dropped, and these parts' lines are reconciled anew. Rows come
    with their part and sorted by it."""
    fresh = distinct(batch).withColumns({"is_active": F.lit(True), "version": F.lit(1)})
    if stored is not None:
        fresh = fresh.join(stored.select("item_id"), "item_id", "left_anti")
        fresh = stored.unionByName(fresh.select(stored.columns))
    return versioning.reconcile(fresh.withColumn(PART, part), within=(PART,))


def upserted(stored: DataFrame | None, batch: DataFrame, part: Column, parts: int) -> DataFrame:
    """Rows of the parts that a batch of whole documents touches, these upserted in order, a part by one task."""
    return upserts.upsert(stored, fresh(stored, batch), (part, parts))


def fresh(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """One row of each item_id, without those that their line has stored. Of all rows just their item_id's hash is shuffled;
    only those whose hash is met again, in the batch or in what is stored, are compared as a whole."""
    mark = F.xxhash64("item_id")
    marks = batch.select(mark.alias("_mark"), F.lit(True).alias("_new"))
    if stored is not None:
        marks = marks.unionByName(stored.select(mark.alias("_mark"), F.lit(False).alias("_new")))
    again = marks.groupBy("_mark").agg(F.count("*").alias("_n"), F.bool_or("_new").alias("_new")).where("_n > 1 AND _new").select("_mark").limit(REPEATED + 1).collect()
    if not again:
        return batch
    single = lambda rows, have: rows.dropDuplicates(["item_id"]) if have is None else upserts.unknown(have, rows.dropDuplicates(["item_id"]))
    if len(again) > REPEATED:
        return single(batch, stored)
    marked = F.broadcast(batch.sparkSession.createDataFrame(again, "_mark long"))
    met = lambda rows, how: rows.join(marked, mark == F.col("_mark"), how)
    return met(batch, "left_anti").unionByName(single(met(batch, "left_semi"), None if stored is None else met(stored, "left_semi")))


def ingest(stream: DataFrame, table: KeyedTable, checkpoint_dir: str, change: Change = reconciled) -> KeyedTable:
    """Runs the stream over all that is there now, each batch a commit of the table. A batch that is run again changes nothing.

    A table is fed by one checkpoint only, as its batches are numbered from there."""

    def step(batch: DataFrame, number: int) -> None:
        replace(table, spark=batch.sparkSession).merge(batch, number, change)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return table


def queue_counts(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of a stream by type and window, late ones counted up to the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def parquet_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A file stream with the schema of what is there, from a folder or a single file."""
    now = spark.read.parquet(path)
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.rsplit("/", 1)[-1] == name for f in now.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)
