"""What a run leaves behind: originals under names of their own, reports, and vectors that are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def original_names(files: DataFrame, name: str = "safe_name", taken: DataFrame | None = None) -> DataFrame:
    """files with stored_name: of files of one name (regardless of the archive) the first keeps it, others get _1, _2, ...
    before the extension, in the order of their archives; names that are taken (name) count as used."""
    stem, ext = F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    order = Window.partitionBy(name).orderBy("archive", "name")
    rows = files.withColumn("_n", F.row_number().over(order) - 1)
    if taken is not None:
        base = F.regexp_replace("name", r"_\d+(\.[^.]*)?$", "$1")
        used = taken.groupBy(base.alias("_base")).agg(F.count("*").alias("_used"))
        rows = rows.join(used, F.col(name) == F.col("_base"), "left").withColumn("_n", F.col("_n") + F.coalesce("_used", F.lit(0))).drop("_base", "_used")
    return rows.withColumn("stored_name", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def vector_key(texts: DataFrame, model: str, prefix: str, text: str = "text") -> str:
    """What a set of texts' vectors are kept under: the first 16 digits of a digest of the model, the prefix and all texts in
    order. Each text is digested where it is; only digests of blocks meet."""
    rows = texts.select(F.xxhash64(text).alias("_h"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("_d"))
    blocks = rows.groupBy(F.pmod("_h", F.lit(1024)).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256).alias("_d"))
    whole = blocks.agg(F.array_join(F.array_sort(F.collect_list("_d")), "").alias("_d"))  # at most 1024 digests
    return whole.select(F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.lit(prefix), "_d"), 256), 1, 16)).first()[0]


def cached_vectors(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table kept under the key, made and written first if there is none."""
    path = f"{folder.rstrip('/')}/{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(rows: DataFrame, columns: list[str], *order) -> DataFrame:
    """One row, report: a table of some aggregated rows in Markdown, in the given order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), F.lit(" |"))
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), cells.alias("line"))  # a report's rows are few
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return numbered.agg(F.concat(F.lit(head), body).alias("report"))


def as_json(rows: DataFrame, columns: list[str], *order) -> DataFrame:
    """One row, report: the same as a JSON array."""
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.struct(*columns).alias("r"))
    return numbered.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"])).alias("report"))
