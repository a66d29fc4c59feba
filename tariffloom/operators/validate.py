"""Row validation: currency, conversion, price and date rules, ordered flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fx import to_kzt, with_rate

CURRENCIES = ("KZT", "USD", "RUB")


def flags(resident: Column, nonresident: Column, day: Column, as_of: Column) -> Column:
    """INVALID_PRICE, NONRESIDENT_LT_RESIDENT, FUTURE_DATE, in this order and each at most once."""
    return F.array_compact(F.array(
        F.when(resident.isNull() | (resident <= 0), F.lit("INVALID_PRICE")),
        F.when(nonresident < resident, F.lit("NONRESIDENT_LT_RESIDENT")),
        F.when(day > as_of, F.lit("FUTURE_DATE")),
    ))


def validate(rows: DataFrame, rates: DataFrame, as_of: str, price: str = "price", nonresident: str = "price_nonresident", original: str | None = None) -> DataFrame:
    """rows with currency, fx_rate, price_original, resident_kzt, nonresident_kzt, flags, needs_review; blank names go.

    An unknown currency is KZT. KZT rows are not converted and have no original price. A bad price or a nonresident
    price below the resident one asks for review; a date after as_of is flagged only.
    """
    named = rows.where(F.length(F.trim(F.coalesce("service_name_raw", F.lit("")))) > 0)
    known = named.withColumn("currency", F.when(F.upper("currency").isin(*CURRENCIES), F.upper("currency")).otherwise("KZT"))
    rated = with_rate(known, rates)
    foreign = F.col("currency") != "KZT"
    amount = lambda c: F.expr(f"try_cast(`{c}` AS decimal(14,2))")
    first = F.coalesce(amount(original), amount(price)) if original else amount(price)
    done = rated.withColumns({
        "resident_kzt": F.when(foreign, to_kzt(amount(price), F.col("fx_rate"))).otherwise(amount(price).cast("decimal(18,2)")),
        "nonresident_kzt": F.when(foreign, to_kzt(amount(nonresident), F.col("fx_rate"))).otherwise(amount(nonresident).cast("decimal(18,2)")),
        "price_original": F.when(foreign, first),
    })
    done = done.withColumn("flags", flags(F.col("resident_kzt"), F.col("nonresident_kzt"), F.col("effective_date"), F.lit(as_of).cast("date")))
    return done.withColumn("needs_review", F.arrays_overlap("flags", F.array(F.lit("INVALID_PRICE"), F.lit("NONRESIDENT_LT_RESIDENT"))))


def flag_counts(rows: DataFrame, only_active: bool = True) -> DataFrame:
    """How many rows carry each flag, the most common first."""
    active = rows.where("is_active") if only_active and "is_active" in rows.columns else rows
    return active.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "flag")
