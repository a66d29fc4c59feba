"""Keeping the catalogue: the coded source, links to specialties, categories, and bulk verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import first_of

#: Categories by words of a service's name, the first that fits; and the form of an allergen's code.
KEYWORDS = (
    ("Стоматология", ("зуб", "стоматолог", "пломб", "кариес", "пульпит", "коронк", "имплант", "цемент")),
    ("Гинекология и акушерство", ("беремен", "роды", "родов", "гинеколог", "плод", "кольпоскоп", "влагалищ", "шейки матки", "пессари")),
    ("Лучевая диагностика", ("узи", "кт ", "мрт", "рентген", "ренген", "маммограф", "денситометр", "флюорограф", "томограф", "сцинтиграф")),
    ("Функциональная диагностика", ("экг", "ээг", "эхокг", "спиромет", "холтер", "аудиомет", "узд", "доплер", "допплер")),
    ("Хирургия", ("резекц", "эктоми", "ампутац", "иссечение", "удаление", "пластика", "вправлен", "устранение", "лапароскоп", "лапаро", "операц", "шунтирован", "анастомоз", "стом", "дренирован", "биопси", "пункц")),
    ("Процедуры и манипуляции", ("инъекц", "вливание", "введение", "прижигание", "тампон", "перевязк", "катетер", "блокада", "капельниц", "зонд", "промывание", "ванночк")),
    ("Физиотерапия и реабилитация", ("массаж", "реабилитац", "физиотерап", "лфк", "тейпирован", "плазмолифт", "терапия")),
    ("Педиатрия", ("ребенок", "ребёнок", "детск", "педиатр")),
    ("Лабораторная диагностика", ("аллерген", "антите", "иммуноглоб", "ige", "igg", "igm", "кров", "моча", "мочи", "сыворотк", "аминотрансфераза", "глюкоз", "гормон", "анализ", "панель", "посев", "пцр", "маркер", "антиген", "цитолог", "гистолог", "соскоб", "мазок")),
)
ALLERGEN, LABORATORY, OTHER = "\\b[a-z]{1,4}\\s?\\d{1,3}\\b", "Лабораторная диагностика", "Прочие медицинские услуги"
NUMBERING = "^\\s*(?:раздел|блок|глава|пункт|часть)?\\s*№?\\s*\\d+(?:[.\\-/]\\d+)*\\.?\\s*"
BLANKS = "^[ .:\\-—]+|[ .:\\-—]+$"


def keyword_category(name: Column) -> Column:
    """The first category with a word in the name, laboratory for an allergen's code, else the catch-all."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F
    for category, words in KEYWORDS:
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(category))
    return out.when(low.rlike(ALLERGEN), F.lit(LABORATORY)).otherwise(F.lit(OTHER))


def is_junk_label(label: Column) -> Column:
    """More closing than opening brackets, or under three letters."""
    count = lambda what: F.length(F.regexp_replace(label, what, ""))
    return (count("[^)]") > count("[^(]")) | (count("[^А-Яа-яA-Za-z]") < 3)


def clean_category(label: Column, name: Column) -> Column:
    """A label without leading numbering and with single spaces; junk gives the name's keyword category; blank stays."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(label), "(?iu)" + NUMBERING, ""), BLANKS, ""))
    return F.when(F.trim(F.coalesce(label, F.lit(""))) == "", label).when((bare == "") | is_junk_label(bare), keyword_category(name)).otherwise(F.regexp_replace(bare, "\\s{2,}", " "))


def to_decimal(text: Column, kind: str = "decimal(18,2)") -> Column:
    """A best-effort number: of what is no number, null; truth values are none."""
    return F.trim(text.cast("string")).try_cast(kind)


def to_int(text: Column) -> Column:
    """A whole number, cut off after the point; null for blanks, marks of errors and all else."""
    return F.trim(text).try_cast("double").try_cast("long")


def coded_source(rows: DataFrame) -> DataFrame:
    """Rows of a coded catalogue (row, code, name, specialty, specialty_id, icd as text) with whole-number codes; without a
    name or a specialty a row is dropped."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    typed = rows.select("row", to_int(F.col("code")).alias("code"), clean("name").alias("service_name"), clean("specialty").alias("specialty"), to_int(F.col("specialty_id")).alias("specialty_id"), clean("icd").alias("icd_code"))
    return typed.where("service_name IS NOT NULL AND specialty IS NOT NULL")


def service_key(code: Column, name: Column) -> Column:
    """What makes a row a service: its code, or its name in lower case among those without one."""
    return F.when(code.isNotNull(), F.concat(F.lit("code:"), code.cast("string"))).otherwise(F.concat(F.lit("name:"), F.lower(F.trim(name))))


def upsert_coded(existing: DataFrame, source: DataFrame) -> DataFrame:
    """service_key, code, service_name, synonyms, icd_code, is_active, created: the services (code, service_name, icd_code,
    synonyms, is_active) after a coded source. The last row of a key names it, the last ICD code that is not blank stays,
    its only synonym is its name, and it is active; others stay as they are."""
    rows = source.withColumn("service_key", service_key(F.col("code"), F.col("service_name")))
    last = rows.groupBy("service_key").agg(F.max("code").alias("s_code"), F.max_by("service_name", "row").alias("s_name"), F.max_by("icd_code", F.when(F.col("icd_code").isNotNull(), F.col("row"))).alias("s_icd"))
    have = existing.withColumn("service_key", service_key(F.col("code"), F.col("service_name")))
    both = have.join(last, "service_key", "full_outer")
    new = F.col("s_name").isNotNull()
    return both.select(
        "service_key", F.coalesce("code", "s_code").alias("code"), F.coalesce("s_name", "service_name").alias("service_name"), F.when(new, F.array("s_name")).otherwise(F.col("synonyms")).alias("synonyms"),
        F.coalesce("s_icd", "icd_code").alias("icd_code"), (new | F.coalesce("is_active", F.lit(False))).alias("is_active"), (new & F.col("service_name").isNull()).alias("created"),
    )


def new_links(existing: DataFrame, source: DataFrame) -> DataFrame:
    """service_key, specialty, specialty_id: pairs of the source that are not linked yet, each once, with its first id."""
    rows = source.withColumn("service_key", service_key(F.col("code"), F.col("service_name")))
    pairs = rows.groupBy("service_key", "specialty").agg(F.min_by("specialty_id", "row").alias("specialty_id"))
    return pairs.join(existing.select("service_key", "specialty").distinct(), ["service_key", "specialty"], "left_anti")


def catalogue_counts(services: DataFrame, links: DataFrame) -> DataFrame:
    """One row: services_total, services_coded, services_uncoded, links_total, specialties."""
    counts = services.agg(F.count("*").alias("services_total"), F.count("code").alias("services_coded"))
    linked = links.agg(F.count("*").alias("links_total"), F.countDistinct("specialty").alias("specialties"))
    return counts.crossJoin(linked).select("services_total", "services_coded", (F.col("services_total") - F.col("services_coded")).alias("services_uncoded"), "links_total", "specialties")  # one row each


def fill_categories(services: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """services with category and filled_by where it was blank: the section that most of its items have, else the specialty
    that most of its links have (ties to the smaller label), else by keyword."""

    def modal(rows: DataFrame, column: str, name: str) -> DataFrame:
        counts = rows.where(F.trim(column) != "").groupBy("service_id", F.trim(column).alias(name)).agg(F.count("*").alias("_n"))
        return first_of(counts, ["service_id"], F.col("_n").desc(), name).select("service_id", name)

    blank = F.trim(F.coalesce("category", F.lit(""))) == ""
    rows = services.join(modal(items, "section", "_section"), "service_id", "left").join(modal(links, "specialty", "_specialty"), "service_id", "left")
    word = keyword_category(F.col("service_name"))
    by = F.when(~blank, None).when(F.col("_section").isNotNull(), "section").when(F.col("_specialty").isNotNull(), "specialty").when(word == OTHER, "fallback").otherwise("keyword")
    return rows.withColumns({"filled_by": by, "category": F.when(blank, F.coalesce("_section", "_specialty", word)).otherwise(F.col("category"))}).drop("_section", "_specialty")


def verify_matched(items: DataFrame, by: str = "catalog-import") -> DataFrame:
    """items after a bulk check: no active row needs review, and active rows matched by rule or hand are verified."""
    matched = F.col("match_status").isin("matched_auto", "matched_manual")
    newly = F.col("is_active") & matched & ~F.col("is_verified")
    return items.withColumns({"needs_review": F.col("needs_review") & ~F.col("is_active"), "verified_by": F.when(newly, F.lit(by)).otherwise(F.col("verified_by")), "is_verified": F.col("is_verified") | newly})
