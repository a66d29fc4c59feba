"""A table that batches change in part: rows dealt to parts by a hash of their key, a log of commits, whole versions for readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Change = Callable[[DataFrame | None, DataFrame, Column, int], DataFrame]
PART = "part"  # of data and log


@dataclass(frozen=True)
class KeyedTable:
    """path holds data/<commit>/part=<n>, written once and never changed, and log/<commit>, which tells the parts that a commit
    wrote. The log entry appears as one renamed file, after the data, so a reader sees all of a commit or nothing of it.

    key: columns that decide a row's part; an expression of SQL may stand for a column. parts: their number, fixed for a table."""

    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    parts: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*(F.expr(k) for k in self.key)), F.lit(self.parts)).cast("int")

    def log(self) -> DataFrame:
        """commit, part of all commits."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "commit long, part int")
        return self.spark.read.schema("commit long, part int").option("recursiveFileLookup", "true").parquet(f"{self.path}/log")

    def commits(self) -> list[int]:
        return [r["commit"] for r in self.log().select("commit").distinct().orderBy("commit").collect()]

    def current(self, at: int | None = None) -> dict[int, int]:
        """The commit that wrote each part last, up to commit `at`. Bounded by the number of parts."""
        log = self.log() if at is None else self.log().where(F.col("commit") <= at)
        return {r["part"]: r["commit"] for r in log.where("part IS NOT NULL").groupBy("part").agg(F.max("commit").alias("commit")).collect()}

    def of(self, places: dict[int, int]) -> DataFrame | None:
        """The rows of some parts; None if there are none."""
        if not places:
            return None
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{commit}/part={part}" for part, commit in sorted(places.items())))

    def read(self, at: int | None = None) -> DataFrame:
        """All rows as of the last commit, or of commit `at`; of a table without commits none."""
        found = self.of(self.current(at))
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def merge(self, batch: DataFrame, commit: int, change: Change) -> int:
        """Commits change(stored rows of the parts that the batch touches or None, batch, part, number of parts), which gives
        all rows of these parts, and returns how many parts were written. A commit that the log has is not done again; one that failed before
        that is done anew. Only one writer at a time. change may deal rows by the given expression, which saves a shuffle, and
        give rows that come sorted by a column `part` of it, which saves a sort. What an empty table's first batch touches is
        told by what was written. A batch is read anew by each step and not kept, in memory or on disks, so it has to give the
        same rows each time, as a stream's does."""
        if commit in self.commits():
            return 0
        now, at = self.current(), f"{self.path}/data/{commit}"
        touched = {r["part"] for r in batch.select(self.part().alias("part")).distinct().collect()} if now else None
        if touched or not now:
            rows = change(self.of({p: c for p, c in now.items() if p in touched}) if now else None, batch, self.part(), self.parts)
            dealt = PART in rows.columns and PART not in self.schema.names
            rows = rows if dealt else rows.withColumn(PART, self.part())
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy(PART).parquet(at)
        if touched is None:
            touched = self.written(at)
        entry = self.spark.createDataFrame([(commit, p) for p in sorted(touched)] or [(commit, None)], "commit long, part int")
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{commit}")
        return len(touched)

    def written(self, folder: str) -> set[int]:
        """Parts that have a folder there. Bounded by the number of parts."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)
        names = (f.getPath().getName() for f in found)
        return {int(n.removeprefix(f"{PART}=")) for n in names if n.startswith(f"{PART}=")}

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data that none of the last `keep` commits needs; returns how many parts went. Older commits can't be read then."""
        commits = self.commits()
        needed = {place for at in commits[-keep:] for place in self.current(at).items()}
        gone = {(r["part"], r["commit"]) for r in self.log().where("part IS NOT NULL").distinct().collect()} - needed
        places = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{commit}/part={part}") for part, commit in gone]
        return sum(where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True) for where in places)
