"""Queries that keep the catalogue and its prices: coded source, categories, bulk checks, lookups, small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices, text
from ..operators import assistant, catalogue, match, statistics, versioning
from ..sources import sinks
from . import domain, lists


def coded_rows(spark, d):
    """A coded catalogue's sheet: codes that repeat, are missing or are marks of errors; blank names and ICD codes."""
    key = F.col("p_partkey")
    return domain.read(spark, d, "part").select(
        key.alias("row"), F.when(key % 5 == 0, "#REF!").when(key % 5 == 1, " ").otherwise((key % 200).cast("string")).alias("code"), F.when(key % 13 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "))).alias("name"),
        F.col("p_brand").alias("specialty"), F.when(key % 6 == 0, "x").otherwise(F.concat(key.cast("string"), F.lit(".0"))).alias("specialty_id"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("I"), F.col("p_size").cast("string"))).alias("icd"),
    )


def stored_services(spark, d):
    """Services that the catalogue already has: every third code, and some without a code."""
    key = F.col("p_partkey")
    rows = domain.read(spark, d, "part").where("p_partkey % 3 = 0")  # the store's own rows, not a subset of a table
    code = F.when(key <= 199, key)
    return rows.select(code.alias("code"), F.when(code.isNull(), F.concat(F.lit("Stored "), key.cast("string"))).otherwise(F.col("p_name")).alias("service_name"), F.array("p_name").alias("synonyms"), F.lit("OLD").alias("icd_code"), (key % 2 == 0).alias("is_active"))


def catalog_coded(spark, d):
    done = catalogue.upsert_coded(stored_services(spark, d), catalogue.coded_source(coded_rows(spark, d)))
    return done.select("service_key", "service_name", F.array_join("synonyms", ";").alias("synonyms"), "icd_code", "is_active", "created")


def stored_links(spark, d):
    source = catalogue.coded_source(coded_rows(spark, d))
    return source.where("row % 7 = 0").select(catalogue.service_key(F.col("code"), F.col("service_name")).alias("service_key"), "specialty")


def catalog_links(spark, d):
    found = catalogue.new_links(stored_links(spark, d), catalogue.coded_source(coded_rows(spark, d)))
    return found.withColumn("specialty_id", F.coalesce("specialty_id", F.lit(-1)))


def catalog_counts(spark, d):
    source = catalogue.coded_source(coded_rows(spark, d))
    services = catalogue.upsert_coded(stored_services(spark, d), source)
    links = stored_links(spark, d).distinct().unionByName(catalogue.new_links(stored_links(spark, d), source).select("service_key", "specialty"))
    return catalogue.catalogue_counts(services, links)


LABELS = ("Раздел 1.2 Общие услуги", "12) обрывок", "№ 7. Анализы   крови", "аб", "Хирургия", "", "3.1", "Блок 4: УЗИ")
NAMES = ("Удаление зуба", "УЗИ почек", "Массаж спины", "Аллерген f37", "Прочее")


def categorize_services(spark, d):
    """Services of which some have no category, priced items with sections, and links to specialties."""
    key = F.col("service_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (key % 5 + 1).cast("int"))
    services = domain.services(spark, d).select("service_id", F.when(key % 2 == 0, F.col("category")).otherwise(" ").alias("category"), name.alias("service_name"))
    items = domain.items(spark, d).where("service_id % 3 = 0").select("service_id", F.concat(F.lit("Section "), (F.col("document_id") % 7).cast("string")).alias("section"))
    links = domain.services(spark, d).where("service_id % 5 = 0").select("service_id", "specialty")
    return catalogue.fill_categories(services, items, links).select("service_id", "category", "filled_by")


def clean_categories(spark, d):
    key = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    rows = domain.read(spark, d, "part").select("p_partkey", pick(LABELS, key).alias("label"), pick(NAMES, F.floor(key / 8)).alias("name"))
    return rows.select("p_partkey", catalogue.clean_category(F.col("label"), F.col("name")).alias("category"))


def verify_matched(spark, d):
    rows = domain.items(spark, d).withColumns({"is_active": F.col("document_id") % 3 != 0, "needs_review": F.col("match_status") == "needs_review", "verified_by": F.when(F.col("is_verified"), "operator")})
    return catalogue.verify_matched(rows).select("item_id", "needs_review", "is_verified", "verified_by")


def best_decimals(spark, d):
    """Numbers as text, with blanks, words and truth values among them."""
    key = F.col("l_partkey")
    p = F.col("l_extendedprice").cast("decimal(14,2)").cast("string")
    value = F.when(key % 5 == 0, F.concat(F.lit(" "), p)).when(key % 5 == 1, "нет").when(key % 5 == 2, "").when(key % 5 == 3, "true").otherwise(p)
    return domain.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", catalogue.to_decimal(value).cast("double").alias("value"))


def recent_batches(spark, d):
    days = domain.read(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("batch_id")).agg(F.max(F.to_date("o_orderdate")).alias("created_at"), F.count("*").alias("n_documents"))
    return statistics.recent(days, 5, "created_at", "batch_id").select("batch_id", F.col("created_at").cast("string").alias("created_at"), "n_documents")


def grouped_services(spark, d):
    return statistics.grouped(domain.services(spark, d).where("is_active"), "category").select("category", "n", "place")


RUSSIAN = ("Ёлка", "еж", "Жук", "ель", "Абв", "абв", "ёж", "Яма", "zeta", "Alpha", " ")


def grouped_russian(spark, d):
    """Services by labels of mixed case and letters."""
    label = F.concat(F.element_at(F.array(*map(F.lit, RUSSIAN)), (F.col("p_partkey") % 11 + 1).cast("int")), F.when(F.col("p_partkey") % 11 == 10, "").otherwise((F.col("p_size") % 4).cast("string")))
    found = statistics.grouped(domain.read(spark, d, "part").select(label.alias("category")), "category")
    return found.select("category", "n", "place")


def ocr_quality(spark, d):
    """Words of scanned documents with a confidence; which cells hold prices follows from the key."""
    rows = domain.read(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("document_id"), (F.col("l_discount") * 100).cast("double").alias("confidence"), (F.col("l_partkey") % 3 == 0).alias("priced"))
    found = statistics.recognition_quality(rows)
    return found.select("document_id", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("priced_share", 6).alias("priced_share"))


def parse_times(spark, d):
    rows = domain.documents(spark, d).withColumn("seconds", (F.col("document_id") % 1000).cast("double") / 100)
    return statistics.longest_times(rows).select("text_seconds", "scan_seconds")


def point_lookup(spark, d):
    """A service by its key, with its path in the tree of categories."""
    rows = domain.services(spark, d).where(F.col("service_id") == 42)
    path = text.effective_path(text.split_path(F.replace("category", F.lit(" "), F.lit(">"))), F.col("category"))
    return rows.select("service_id", "service_name", F.array_join(path, "/").alias("path"))


def enriched_hits(spark, d):
    """Search hits with the path of their category."""
    hits = lists.active_items(spark, d).where("service_id IS NOT NULL").select("service_id").distinct()
    paths = domain.services(spark, d).select("service_id", text.split_path(F.replace("category", F.lit(" "), F.lit(">"))).alias("category_path"))
    return match.enriched(hits, paths).select("service_id", F.array_join("category_path", "/").alias("path"))


def specialty_prior(spark, d):
    """Sections of which some name a specialty; the set of services that each item may be matched to."""
    key = F.col("p_partkey")
    services = domain.services(spark, d)
    links = services.where("service_id % 2 = 0").select("service_id", "specialty")
    inner = F.when(key % 3 == 0, F.lit("zzz qqq")).otherwise(F.col("p_brand"))
    path = F.when(key % 4 == 0, F.array(F.lit("Brand#11"), inner)).when(key % 4 == 1, F.array(inner)).when(key % 4 == 2, F.array(F.lit("wwww"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    rows = domain.read(spark, d, "part").select(key.alias("item_id"), path.alias("section_path"), F.when(key % 5 == 0, F.lit("Brand#12")).alias("section"))
    return match.specialty_prior(rows, "item_id", links).select("item_id", "specialty", F.coalesce("n_allowed", F.lit(-1)).alias("n_allowed"))


def header_specialties(spark, d):
    """Rows without price and code whose name is a specialty are no items."""
    key = F.col("p_partkey")
    rows = domain.read(spark, d, "part").select(key.alias("item_id"), F.when(key % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_name")).alias("name"), (key % 2 == 0).alias("has_price"), (key % 7 == 0).alias("has_code"))
    return match.without_specialty_rows(rows, domain.services(spark, d).select("specialty"), "name").select("item_id")


REQUESTS = ("найди {} в Алматы до 5000 тг", "show top 3 {} under 50k", "{} от 2000 до 8000 в астане", "сравни {} не дороже 10 000", "клиники в Шымкенте", "привет", "cheapest {} in Karaganda for foreigners", "{} не дешевле 1500 для граждан")


def assistant_requests(spark, d):
    """Requests in eight forms about parts of names, read back."""
    topic = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2))
    form = F.element_at(F.array(*map(F.lit, REQUESTS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = domain.read(spark, d, "part").select("p_partkey", F.replace(form, F.lit("{}"), topic).alias("text"))
    p = F.col("preferences")
    return assistant.parse_all(rows).select("p_partkey", p["intent"].alias("intent"), p["topic"].alias("topic"), p["city"].alias("city"), p["min_price"].alias("min_price"), p["max_price"].alias("max_price"), p["resident"].alias("resident"), p["sort"].alias("sort"), p["limit"].alias("limit_"), p["language"].alias("language"))


def city_providers(spark, d):
    """The reply to a request for providers in a city that only part of a provider's city names."""
    partners = domain.partners(spark, d).withColumn("city", F.when(F.col("city") == "KENYA", "Астана (центр)").otherwise(F.col("city")))
    return assistant.reply("клиники в Астане топ 4", domain.services(spark, d), partners, lists.active_items(spark, d))


def price_glyphs(spark, d):
    """Prices in which letters stand for digits, with separators of several kinds and spaces that are none of ASCII's."""
    key = F.col("l_partkey")
    n = F.floor("l_extendedprice").cast("string")
    forms = [
        F.translate(n, "013", "OlЗ"), F.concat(F.lit(" "), n, F.lit(" ₸")), F.concat(n, F.lit(".00")), F.concat(n, F.lit(",5")), F.concat(F.lit("1.234.567,"), F.lpad((key % 100).cast("string"), 2, "0")),
        F.concat(F.lit("1,234,"), F.lpad((key % 1000).cast("string"), 3, "0")), F.concat(n, F.lit(" Б")), F.lit("12 OOO"), F.concat(F.lit("от "), n), F.lit("по запросу"),
    ]
    cell = F.element_at(F.array(*forms), (key % 10 + 1).cast("int"))
    return domain.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", prices.price(cell).alias("value"))


def text_functions(spark, d):
    """Lists, paths, amounts and file names that star-schema columns are put into."""
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(14,2)")
    rows = domain.read(spark, d, "part")
    name = F.concat(F.lit("a/б\\"), F.when(key % 3 == 0, "..").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("  !")), F.lit(".pdf"))
    return rows.select(
        "p_partkey", F.array_join(text.split_synonyms(F.concat_ws(";", "p_name", F.upper("p_name"), F.lit(" "), "p_brand")), "|").alias("synonyms"),
        F.array_join(text.split_path(F.replace("p_type", F.lit(" "), F.lit(" > "))), "|").alias("path"), text.format_kzt(price * 100).alias("amount"), text.price_range(price, price + F.lit(0.2).cast("decimal(14,2)") * (key % 2)).alias("range"),
        F.array_join(text.category_path(F.when(key % 3 == 0, F.array("p_type")), F.when(key % 3 == 1, F.col("p_name")), F.when(key % 2 == 0, F.col("p_brand"))), "|").alias("category"), text.safe_filename(name).alias("file"),
    )


def decisions(spark, d):
    """Operators' decisions on every fifth order's items, some of them repeated later with another service."""
    rows = domain.items(spark, d).join(domain.read(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("document_id")), "document_id", "left_semi")
    kind = F.col("partner_id") % 3
    first = rows.select("item_id", F.when(kind == 0, "approve").when(kind == 1, "reject").otherwise("match").alias("action"), F.when(kind == 2, F.lit(7).cast("long")).alias("service_id"), F.lit("ann").alias("operator"), F.lit(1).alias("decided_at"))
    later = rows.where("partner_id % 2 = 0").select("item_id", F.lit("match").alias("action"), F.lit(9).cast("long").alias("service_id"), F.lit(None).cast("string").alias("operator"), F.lit(2).alias("decided_at"))
    return first.unionByName(later)


def match_events(spark, d):
    found = versioning.match_events(domain.items(spark, d).select("item_id", F.col("service_id").cast("long")), decisions(spark, d))
    return found.select("item_id", F.coalesce("old_service_id", F.lit(-1)).alias("old_service_id"), F.coalesce("new_service_id", F.lit(-1)).alias("new_service_id"), "action", "operator", "decided_at")


def partner_backfill(spark, d):
    """Providers with some fields empty, and hints of the documents that were resolved to them."""
    key = F.col("s_suppkey")
    have = domain.read(spark, d, "supplier").select(key.alias("partner_id"), F.when(key % 2 == 0, "own city").alias("city"), F.when(key % 3 == 0, " ").when(key % 3 == 1, "own@x.kz").alias("email"), F.lit(None).cast("string").alias("bin"))
    doc = F.col("o_orderkey")
    hints = domain.read(spark, d, "orders").select((F.col("o_custkey") % 10 + 1).alias("partner_id"), doc.alias("document_id"), F.when(doc % 3 != 0, F.concat(F.lit("city "), doc.cast("string"))).alias("city"), F.when(doc % 5 == 0, F.concat(doc.cast("string"), F.lit("@y.kz"))).otherwise("").alias("email"), F.when(doc % 7 == 0, F.lpad(doc.cast("string"), 12, "4")).otherwise("12").alias("bin"))
    return match.backfill_partners(have, hints)


def format_report(spark, d):
    rows = domain.documents(spark, d).groupBy("file_format").agg(F.count("*").alias("documents"), F.count_if(F.col("parse_status") == "done").alias("done"))
    return sinks.markdown(rows, ["file_format", "documents", "done"], "file_format")


def original_names(spark, d):
    files = domain.read(spark, d, "part").select((F.col("p_partkey") % 9).cast("string").alias("archive"), F.col("p_partkey").cast("string").alias("name"), F.concat(F.col("p_brand"), F.lit(".pdf")).alias("safe_name"))
    return sinks.original_names(files).select("archive", "name", "stored_name")


QUERIES = {f.__name__: f for f in (
    match_events, partner_backfill, format_report, original_names,
    catalog_coded, catalog_links, catalog_counts, categorize_services, clean_categories, verify_matched, best_decimals, recent_batches, grouped_services, grouped_russian, ocr_quality, parse_times, point_lookup, enriched_hits,
    specialty_prior, header_specialties, assistant_requests, city_providers, price_glyphs, text_functions,
)}
D = f"WITH {domain.SQL}"
SOURCE = """src0 AS (
  SELECT p_partkey AS row, CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 200 END AS code, CASE WHEN p_partkey % 13 <> 0 THEN trim(p_name) END AS name, p_brand AS specialty,
    CASE WHEN p_partkey % 6 <> 0 THEN p_partkey END AS specialty_id, CASE WHEN p_partkey % 4 <> 0 THEN 'I' || p_size END AS icd
  FROM part
), src AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'code:' || code ELSE 'name:' || lower(name) END AS k FROM src0 WHERE name IS NOT NULL
), have AS (
  SELECT *, CASE WHEN code IS NOT NULL THEN 'code:' || code ELSE 'name:' || lower(service_name) END AS k FROM (
    SELECT CASE WHEN p_partkey <= 199 THEN p_partkey END AS code, CASE WHEN p_partkey > 199 THEN 'Stored ' || p_partkey ELSE p_name END AS service_name, p_name AS synonyms, 'OLD' AS icd_code, p_partkey % 2 = 0 AS is_active
    FROM part WHERE p_partkey % 3 = 0)
), last AS (SELECT k, max(code) AS code, arg_max(name, row) AS name, arg_max(icd, row) FILTER (icd IS NOT NULL) AS icd FROM src GROUP BY k
), done AS (
  SELECT coalesce(h.k, l.k) AS service_key, coalesce(h.code, l.code) AS code, coalesce(l.name, service_name) AS service_name, CASE WHEN l.name IS NOT NULL THEN l.name ELSE synonyms END AS synonyms,
    coalesce(l.icd, icd_code) AS icd_code, l.name IS NOT NULL OR coalesce(is_active, false) AS is_active, l.name IS NOT NULL AND h.service_name IS NULL AS created
  FROM have h FULL JOIN last l ON h.k = l.k
), old AS (SELECT DISTINCT k, specialty FROM src WHERE row % 7 = 0
), new AS (SELECT k AS service_key, specialty, arg_min_null(specialty_id, row) AS specialty_id FROM (SELECT * FROM src) s WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k = s.k AND old.specialty = s.specialty) GROUP BY k, specialty
)"""
WORD = """CASE {0} WHEN 0 THEN 'Стоматология' WHEN 1 THEN 'Лучевая диагностика' WHEN 2 THEN 'Физиотерапия и реабилитация' WHEN 3 THEN 'Лабораторная диагностика' ELSE 'Прочие медицинские услуги' END"""
SQL = {
    "match_events": D + """, r AS (SELECT * FROM items WHERE document_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)),
a AS (SELECT item_id, service_id AS now, partner_id % 3 AS k, partner_id FROM r)
SELECT item_id, coalesce(now, -1) AS old_service_id, coalesce(CASE WHEN k = 2 THEN 7 END, now, -1) AS new_service_id, ['approve', 'reject', 'match'][k + 1] AS action, 'ann' AS operator, 1 AS decided_at FROM a
UNION ALL SELECT item_id, coalesce(CASE WHEN k = 2 THEN 7 END, now, -1), 9, 'match', 'operator', 2 FROM a WHERE partner_id % 2 = 0""",
    "partner_backfill": """WITH h AS (SELECT o_custkey % 10 + 1 AS partner_id, o_orderkey AS k FROM orders),
f AS (SELECT partner_id, min(k) FILTER (k % 3 <> 0) AS c, min(k) FILTER (k % 5 = 0) AS e, min(k) FILTER (k % 7 = 0) AS b FROM h GROUP BY 1)
SELECT s_suppkey AS partner_id, CASE WHEN s_suppkey % 2 = 0 THEN 'own city' ELSE 'city ' || c END AS city, CASE WHEN s_suppkey % 3 = 1 THEN 'own@x.kz' ELSE e || '@y.kz' END AS email, lpad(CAST(b AS VARCHAR), 12, '4') AS bin FROM supplier LEFT JOIN f ON s_suppkey = partner_id""",
    "format_report": D + """, c AS (SELECT file_format, count(*) AS n, count(*) FILTER (parse_status = 'done') AS d FROM docs GROUP BY 1)
SELECT '| file_format | documents | done |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || file_format || ' | ' || n || ' | ' || d || ' |', chr(10) ORDER BY file_format) AS report FROM c""",
    "original_names": """WITH f AS (SELECT CAST(p_partkey % 9 AS VARCHAR) AS archive, CAST(p_partkey AS VARCHAR) AS name, p_brand FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY archive, name) - 1 AS n FROM f)
SELECT archive, name, CASE WHEN n = 0 THEN p_brand || '.pdf' ELSE p_brand || '_' || n || '.pdf' END AS stored_name FROM n""",
    "catalog_coded": f"WITH {SOURCE} SELECT service_key, service_name, synonyms, icd_code, is_active, created FROM done",
    "catalog_links": f"WITH {SOURCE} SELECT service_key, specialty, coalesce(specialty_id, -1) AS specialty_id FROM new",
    "catalog_counts": f"""WITH {SOURCE}, l AS (SELECT k, specialty FROM old UNION ALL SELECT service_key, specialty FROM new)
SELECT * FROM (SELECT count(*) AS services_total, count(code) AS services_coded, count(*) - count(code) AS services_uncoded FROM done), (SELECT count(*) AS links_total, count(DISTINCT specialty) AS specialties FROM l)""",
    "categorize_services": D + f""", s AS (SELECT service_id, CASE WHEN service_id % 2 = 0 THEN category ELSE ' ' END AS category, specialty FROM services),
a AS (SELECT service_id, 'Section ' || (document_id % 7) AS section, count(*) AS n FROM items WHERE service_id % 3 = 0 GROUP BY service_id, 'Section ' || (document_id % 7) QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY count(*) DESC, 'Section ' || (document_id % 7)) = 1)
SELECT s.service_id, CASE WHEN trim(coalesce(category, '')) <> '' THEN category WHEN section IS NOT NULL THEN section WHEN s.service_id % 5 = 0 THEN specialty ELSE {WORD.format('s.service_id % 5')} END AS category,
  CASE WHEN trim(coalesce(category, '')) <> '' THEN NULL WHEN section IS NOT NULL THEN 'section' WHEN s.service_id % 5 = 0 THEN 'specialty' WHEN s.service_id % 5 = 4 THEN 'fallback' ELSE 'keyword' END AS filled_by
FROM s LEFT JOIN a USING (service_id)""",
    "clean_categories": f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Общие услуги' WHEN 2 THEN 'Анализы крови' WHEN 4 THEN 'Хирургия' WHEN 5 THEN '' WHEN 7 THEN 'УЗИ' ELSE {WORD.format('(p_partkey // 8) % 5')} END AS category FROM part""",
    "verify_matched": D + """, r AS (SELECT *, document_id % 3 <> 0 AS act FROM items)
SELECT item_id, match_status = 'needs_review' AND NOT act AS needs_review, is_verified OR (act AND match_status IN ('matched_auto', 'matched_manual')) AS is_verified,
  CASE WHEN is_verified THEN 'operator' WHEN act AND match_status IN ('matched_auto', 'matched_manual') THEN 'catalog-import' END AS verified_by FROM r""",
    "best_decimals": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 IN (0, 4) THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE) END AS value FROM lineitem",
    "recent_batches": "SELECT o_custkey % 50 AS batch_id, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS created_at, count(*) AS n_documents FROM orders GROUP BY 1 ORDER BY max(CAST(o_orderdate AS DATE)) DESC, 1 LIMIT 5",
    "grouped_services": D + """, g AS (SELECT coalesce(nullif(trim(category), ''), 'Без категории') AS category, count(*) AS n FROM services WHERE is_active GROUP BY 1)
SELECT category, n, CAST(row_number() OVER (ORDER BY category = 'Без категории', category COLLATE ru, category) AS INTEGER) AS place FROM g""",
    "grouped_russian": f"""WITH g AS (SELECT coalesce(nullif(trim({list(RUSSIAN)}[p_partkey % 11 + 1] || CASE WHEN p_partkey % 11 = 10 THEN '' ELSE CAST(p_size % 4 AS VARCHAR) END), ''), 'Без категории') AS category, count(*) AS n FROM part GROUP BY 1)
SELECT category, n, CAST(row_number() OVER (ORDER BY category = 'Без категории', category COLLATE ru, category) AS INTEGER) AS place FROM g""",
    "ocr_quality": "SELECT l_orderkey % 40 AS document_id, round(avg(CAST(l_discount AS DOUBLE) * 100), 6) AS mean_confidence, round(avg(CASE WHEN l_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS priced_share FROM lineitem GROUP BY 1",
    "parse_times": D + " SELECT max(CASE WHEN file_format <> 'scan_pdf' THEN (document_id % 1000) / 100.0 END)::DOUBLE AS text_seconds, max(CASE WHEN file_format = 'scan_pdf' THEN (document_id % 1000) / 100.0 END)::DOUBLE AS scan_seconds FROM docs",
    "point_lookup": D + " SELECT service_id, service_name, replace(coalesce(category, 'Без категории'), ' ', '/') AS path FROM services WHERE service_id = 42",
    "enriched_hits": lists.ACTIVE + ", h AS (SELECT DISTINCT service_id FROM act WHERE service_id IS NOT NULL) SELECT service_id, replace(coalesce(category, ''), ' ', '/') AS path FROM h LEFT JOIN services USING (service_id)",
    "specialty_prior": D + """, l AS (SELECT specialty, count(DISTINCT service_id) AS n FROM services WHERE service_id % 2 = 0 GROUP BY specialty),
r AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS inner_, p_partkey % 4 AS k, p_partkey % 5 = 0 AS own FROM part),
s AS (SELECT item_id, [CASE WHEN k IN (0, 1) THEN inner_ END, CASE WHEN k = 0 THEN 'Brand#11' END, CASE WHEN own THEN 'Brand#12' END] AS levels FROM r),
e AS (SELECT item_id, unnest(levels) AS specialty, generate_subscripts(levels, 1) AS i FROM s),
f AS (SELECT item_id, arg_min(e.specialty, i) AS specialty, arg_min(n, i) AS n FROM e JOIN l USING (specialty) GROUP BY item_id)
SELECT item_id, f.specialty, coalesce(n, -1) AS n_allowed FROM r LEFT JOIN f USING (item_id)""",
    "header_specialties": "SELECT p_partkey AS item_id FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AND p_partkey % 7 <> 0)",
    "assistant_requests": """WITH r AS (SELECT p_partkey, p_partkey % 8 AS k, lower(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)) AS t FROM part)
SELECT p_partkey, CASE k WHEN 3 THEN 'compare' WHEN 4 THEN 'find_partner' WHEN 5 THEN 'unknown' ELSE 'find_service' END AS intent, CASE k WHEN 4 THEN 'Шымкент' WHEN 5 THEN '' ELSE t END AS topic,
  CASE k WHEN 0 THEN 'Алматы' WHEN 2 THEN 'Астана' WHEN 4 THEN 'Шымкент' WHEN 6 THEN 'Караганда' END AS city, CASE k WHEN 2 THEN 2000.0 WHEN 7 THEN 1500.0 END::DOUBLE AS min_price,
  CASE k WHEN 0 THEN 5000.0 WHEN 1 THEN 50000.0 WHEN 2 THEN 8000.0 WHEN 3 THEN 10000.0 END::DOUBLE AS max_price, CASE k WHEN 6 THEN 'nonresident' WHEN 7 THEN 'resident' END AS resident,
  CASE k WHEN 0 THEN 'cheapest' WHEN 1 THEN 'cheapest' WHEN 2 THEN 'cheapest' WHEN 3 THEN 'cheapest' WHEN 6 THEN 'cheapest' WHEN 7 THEN 'cheapest' ELSE 'relevance' END AS sort, CAST(CASE k WHEN 1 THEN 3 ELSE 5 END AS INTEGER) AS limit_,
  CASE WHEN k IN (1, 6) THEN 'en' WHEN k IN (4, 5) THEN 'ru' WHEN length(regexp_replace(lower(CASE k WHEN 0 THEN 'найди в Алматы до тг' WHEN 2 THEN 'от до в астане' WHEN 3 THEN 'сравни не дороже' ELSE 'не дешевле для граждан' END), '[^а-яё]', '', 'g')) >= length(regexp_replace(t, '[^a-z]', '', 'g')) THEN 'ru' ELSE 'en' END AS language FROM r""",
    "city_providers": lists.ACTIVE + """, c AS (SELECT p.partner_id, p.partner_name, count(DISTINCT service_id) AS n FROM partners p LEFT JOIN act a ON a.partner_id = p.partner_id AND service_id IS NOT NULL WHERE city = 'KENYA' GROUP BY ALL ORDER BY n DESC, 1 LIMIT 4)
SELECT CASE WHEN count(*) = 0 THEN 'Клиник по запросу, в Астана не нашлось.' ELSE 'Нашёл ' || count(*) || ' клиник, в Астана: ' || array_to_string(list(partner_name ORDER BY n DESC, partner_id)[1:3], ', ') || '.' END AS reply FROM c""",
    "price_glyphs": """WITH r AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS n, l_partkey % 10 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 3 THEN n + 0.5 WHEN 4 THEN 1234567 + (l_partkey % 100) / 100.0 WHEN 5 THEN 1234000 + l_partkey % 1000 WHEN 7 THEN 12 WHEN 9 THEN NULL
  WHEN 0 THEN CASE WHEN regexp_matches(CAST(n AS VARCHAR), '[2456789]') THEN CASE WHEN regexp_matches(translate(CAST(n AS VARCHAR), '013', 'OlЗ'), '^[A-Za-zА-Яа-яЁё]{1,4}\\d') THEN NULL ELSE n END END ELSE n END::DOUBLE AS value FROM r""",
    "text_functions": f"""WITH r AS (SELECT *, CAST(p_retailprice AS DECIMAL(14,2)) AS p FROM part), m AS (SELECT *, CAST(round(p) AS BIGINT) AS a, CAST(round(p + CASE WHEN p_partkey % 2 = 1 THEN 0.2 ELSE 0 END) AS BIGINT) AS b FROM r)
SELECT p_partkey, p_name || '|' || p_brand AS synonyms, replace(p_type, ' ', '|') AS path, replace(format('{{:,}}', CAST(floor(p * 100) AS BIGINT)), ',', ' ') || ' ₸' AS amount,
  CASE WHEN a = b THEN replace(format('{{:,}}', a), ',', ' ') || ' ₸' ELSE replace(format('{{:,}}', a), ',', ' ') || ' ₸ – ' || replace(format('{{:,}}', b), ',', ' ') || ' ₸' END AS "range",
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE nullif(concat_ws('|', CASE WHEN p_partkey % 3 = 1 THEN p_name END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END), '') END AS category, replace(p_name, ' ', '_') || '.pdf' AS file FROM m""",
}
