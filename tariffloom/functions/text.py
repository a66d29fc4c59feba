"""Text and list expressions, all as columns that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import compatible
from .prices import let

#: Shown for what has no category or city.
NO_CATEGORY, NO_CITY = "Без категории", "Неизвестно"
KAZAKH_LETTERS = "әғқңөұүһі"


def normalise(text: Column) -> Column:
    """Compatibility forms folded, lower case, ё as е, tokens of Latin letters, digits and Cyrillic letters joined by one space;
    null is empty."""
    folded = F.translate(F.lower(compatible(F.coalesce(text, F.lit("")))), "ё", "е")
    return F.array_join(F.regexp_extract_all(folded, F.lit("[a-z0-9\\u0400-\\u04FF]+"), F.lit(0)), " ")


def tokens(text: Column) -> Column:
    """The tokens of normalise(); an empty array without any."""
    folded = F.translate(F.lower(compatible(F.coalesce(text, F.lit("")))), "ё", "е")
    return F.regexp_extract_all(folded, F.lit("[a-z0-9\\u0400-\\u04FF]+"), F.lit(0))


def split_synonyms(text: Column) -> Column:
    """Parts between ; and , trimmed, without blanks; of those equal but for case the first, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, 1, i), lambda y: F.lower(y) == F.lower(x)))


def split_path(text: Column) -> Column:
    """Levels of a category path written with > / » or ›."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[>/»›]"), lambda x: F.trim(x)), lambda x: x != "")


def category_path(explicit: Column, *levels: Column) -> Column:
    """An explicit path without blanks, else the non-blank levels; null if there are none."""
    own = F.filter(F.coalesce(explicit, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    built = F.filter(F.array(*(F.trim(x) for x in levels)), lambda x: x.isNotNull() & (x != "")) if levels else F.array().cast("array<string>")
    return F.when(F.size(own) > 0, own).when(F.size(built) > 0, built)


def effective_path(path: Column, fallback: Column) -> Column:
    """The path, else the fallback alone, else the catch-all."""
    own = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.when(F.size(own) > 0, own).when(F.trim(fallback) != "", F.array(fallback)).otherwise(F.array(F.lit(NO_CATEGORY)))


def catalogue_path(path: Column, category: Column, specialties: Column) -> Column:
    """Where a catalogue entry stands: its path or category, else the first of its specialties without case, else the catch-all."""
    named = F.filter(F.transform(F.coalesce(specialties, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    first = F.array_min(F.transform(named, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))["x"]
    own = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.when((F.size(own) > 0) | F.coalesce(F.trim(category) != "", F.lit(False)), effective_path(path, category)).otherwise(F.array(F.coalesce(first, F.lit(NO_CATEGORY))))


def or_unknown(value: Column, shown: str = NO_CATEGORY) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(shown))


def language(text: Column) -> Column:
    """kk for any Kazakh letter; ru if Cyrillic letters are as many as Latin ones or more; else en; null without letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda t, kind: F.length(F.regexp_replace(t, f"[^{kind}]+", ""))
    told = lambda n: F.when((n["cyrillic"] == 0) & (n["latin"] == 0), None).when(n["cyrillic"] >= n["latin"], "ru").otherwise("en")
    counted = lambda t: let(F.struct(count(t, "а-яё").alias("cyrillic"), count(t, "a-z").alias("latin")), told)
    return let(low, lambda t: F.when(t.rlike(f"[{KAZAKH_LETTERS}]"), "kk").otherwise(counted(t)))


def business_id(text: Column) -> Column:
    """The digits, if there are 12; else null."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == 12, digits)


def shown_price(resident: Column, nonresident: Column, for_nonresident: bool = False) -> Column:
    return F.coalesce(nonresident, resident) if for_nonresident else F.coalesce(resident, nonresident)


def format_kzt(amount: Column) -> Column:
    """Whole units, cut off, with spaces between thousands and the currency sign."""
    return F.concat(F.replace(F.format_number(F.floor(amount), 0), F.lit(","), F.lit(" ")), F.lit(" ₸"))


def price_range(low: Column, high: Column) -> Column:
    """One price if both round to the same whole number, else both with a dash."""
    a, b = format_kzt(F.round(low, 0)), format_kzt(F.round(high, 0))
    return F.when(F.round(low, 0) == F.round(high, 0), a).otherwise(F.concat_ws(" – ", a, b))


def safe_filename(name: Column) -> Column:
    """The last path part with other characters than word characters, dots and dashes as _, at most 200 long."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[\\/]", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")
    stem, ext = F.regexp_replace(clean, r"\.[^.]*$", ""), F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    return F.when(clean == "", F.lit("file")).otherwise(F.substring(F.concat(F.substring(stem, 1, 180), ext), 1, 200))


def median(values: Column) -> Column:
    """Exact median of an array of decimals without its nulls: the middle one, or the mean of the two; null if empty."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    upper = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    lower = F.element_at(s, F.greatest(F.lit(1), F.floor((n + 1) / 2)).cast("int"))
    return F.when(n > 0, ((lower + upper) / 2).cast("decimal(18,3)"))
