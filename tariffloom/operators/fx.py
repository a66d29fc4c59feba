"""Currency conversion with dated rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The default rates to KZT, used where no dated rate of the currency is known.
DEFAULTS = {"USD": 500.0, "RUB": 5.5}


def rates_table(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    """currency, rate_date, rate from literals; rows with a bad date or no positive rate are skipped."""
    if not rows:
        return spark.createDataFrame([], "currency string, rate_date date, rate double")
    rates = spark.createDataFrame(rows, "currency string, day string, rate double")
    return rates.select("currency", F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("rate_date"), "rate").where("rate_date IS NOT NULL AND rate > 0")


def read_rates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dated rates and default rates of a JSON file {currency: {date: rate}, "default": {currency: rate}}; bad keys are skipped."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("currency", "by_day"))
    flat = parsed.select("currency", F.explode("by_day").alias("day", "rate"))
    dated = flat.where("currency <> 'default'").select(F.upper("currency").alias("currency"), F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("rate_date"), "rate")
    return dated.where("rate_date IS NOT NULL AND rate > 0"), flat.where("currency = 'default'").select(F.upper("day").alias("currency"), "rate")


def default_rate(currency: Column, defaults: dict[str, float]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else None
    return F.coalesce(known[currency], F.lit(1.0)) if known is not None else F.lit(1.0)


def with_rate(rows: DataFrame, rates: DataFrame, day: str = "effective_date", currency: str = "currency", defaults: dict[str, float] | None = None) -> DataFrame:
    """rows with fx_rate: the rate of the greatest rate date not after the row's; for earlier days the first one; for a null
    day, or a currency without dated rates, the default; else 1. KZT is always 1.

    Rates become half-open intervals, the first one open to the past, so the as-of join is an equi-join on the currency
    with a range condition. A row meets one interval at most, so rows neither multiply nor get lost.
    """
    order = Window.partitionBy("currency").orderBy("rate_date")
    spans = rates.groupBy("currency", "rate_date").agg(F.max("rate").alias("rate")).select(
        F.col("currency").alias("_cur"), F.col("rate").alias("_rate"),
        F.when(F.row_number().over(order) > 1, F.col("rate_date")).otherwise(F.lit("0001-01-01").cast("date")).alias("_from"),
        F.coalesce(F.lead("rate_date").over(order), F.lit("9999-12-31").cast("date")).alias("_until"),
    )
    on = (F.col(currency) == F.col("_cur")) & (F.col(day) >= F.col("_from")) & (F.col(day) < F.col("_until"))
    rate = F.when(F.col(currency) == "KZT", F.lit(1.0)).otherwise(F.coalesce("_rate", default_rate(F.col(currency), DEFAULTS if defaults is None else defaults)))
    return rows.join(spans, on, "left").withColumn("fx_rate", rate).drop("_cur", "_rate", "_from", "_until")


def to_kzt(amount: Column, rate: Column) -> Column:
    """Half-up to two places; null stays null."""
    return F.round(amount.cast("decimal(14,2)") * rate.cast("decimal(12,4)"), 2).cast("decimal(18,2)")
