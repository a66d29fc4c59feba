"""Queries over text, parsing, matching and search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices, text
from ..session import workspace
from ..operators import fuzzyjoin, match, providers, search
from . import domain, lists, scores


def normalize_text(spark, d):
    rows = domain.read(spark, d, "documents")
    norm = text.normalise(F.col("text"))
    return rows.select("doc_id", F.md5(norm).alias("norm_md5"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def language_detect(spark, d):
    docs = domain.read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = domain.read(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(turns).select("id", text.language(F.col("text")).alias("language"))


def parse_price_cells(spark, d):
    """Prices written in eight ways, read back."""
    p = F.col("l_extendedprice").cast("decimal(14,2)")
    whole = F.floor(p).cast("string")
    grouped = F.regexp_replace(whole, "(\\d)(?=(\\d{3})+$)", "$1 ")
    forms = [F.concat(grouped, F.lit(" ₸")), F.concat(F.lit("$"), whole), F.replace(p.cast("string"), F.lit("."), F.lit(",")), F.concat(grouped, F.lit(" руб")), F.lit("договорная"), F.concat(F.lit("A02."), whole), F.concat(F.replace(grouped, F.lit(" "), F.lit(",")), F.lit(".50")), F.concat(whole, F.lit(" тг"))]
    rows = domain.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p"), F.element_at(F.array(*forms), (F.col("l_partkey") % 8 + 1).cast("int")).alias("cell"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", prices.price(F.col("cell")).alias("value"), prices.currency(F.col("cell")).alias("currency"))


def header_hints(spark, d):
    """File names built from documents' keys and dates, read back."""
    rows = domain.documents(spark, d)
    day = F.coalesce("effective_date", F.lit("2024-02-01").cast("date"))
    shifted = F.concat(F.lit("20"), F.date_format(day, "yy"))
    names = [F.concat(F.lit("Клиника_"), F.col("batch_id"), F.lit("_прайс_"), shifted, F.date_format(day, "-MM-dd"), F.lit(".pdf")), F.concat(F.lit("price Alpha "), F.date_format(day, "dd.MM."), shifted, F.lit(".xlsx")), F.concat(F.lit("Beta "), F.col("batch_id"), F.lit(" "), shifted, F.lit(" год.docx")), F.lit("скан 12345.pdf")]
    named = rows.select("document_id", F.element_at(F.array(*names), (F.col("document_id") % 4 + 1).cast("int")).alias("file_name"))
    return named.select("document_id", prices.filename_partner(F.col("file_name")).alias("partner"), prices.filename_date(F.col("file_name")).cast("string").alias("day"))


def raw_names(spark, d):
    """Catalogue names as price lists write them: as they are, in capitals with marks, reversed, or misspelt."""
    s = domain.services(spark, d)
    name = F.col("service_name")
    raw = F.when(F.col("service_id") % 4 == 0, name).when(F.col("service_id") % 4 == 1, F.concat(F.lit("  "), F.upper(name), F.lit("!! "))).when(F.col("service_id") % 4 == 2, F.element_at("synonyms", 1)).otherwise(F.concat(F.substring(name, 1, 3), F.lit("x"), F.expr("substring(service_name, 5)")))
    return s.select(F.col("service_id").alias("name_id"), raw.alias("raw"))


def match_exact_synonym(spark, d):
    found = match.exact_or_synonym(raw_names(spark, d), domain.services(spark, d))
    return found.select("name_id", "norm", F.coalesce("service_id", F.lit(-1)).alias("service_id"), "method")


def match_cascade(spark, d):
    found = match.cascade(raw_names(spark, d), domain.services(spark, d))
    return found.select("raw", "norm", F.coalesce("service_id", F.lit(-1)).alias("service_id"), "method", "confidence", "status", F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"))


def rematch_queue(spark, d):
    """Names that miss the catalogue, with lists kept from before an upload that added and dropped services."""
    services = domain.services(spark, d)
    given = lambda some: match.catalogue_texts(services.where(some)).select("text", F.col("service_id").alias("owner"), F.col("service_name").alias("owner_name"))
    names = raw_names(spark, d).where("name_id % 4 = 3").select(text.normalise(F.col("raw")).alias("norm"))
    old, new = given("service_id % 3 <> 0"), given("service_id % 7 <> 0")
    at = workspace(spark)
    fuzzyjoin.best_entries(names.where("norm NOT LIKE 'c%'"), old, 5).write.parquet(at)  # before, fewer names were asked
    found = fuzzyjoin.rematched(spark.read.parquet(at), names, old, new, 5)
    return found.select("norm", F.col("owner").alias("service_id"), "score")


def promote_unmatched(spark, d):
    rows = domain.items(spark, d).withColumn("section", F.concat(F.lit("Section "), (F.col("document_id") % 7).cast("string")))
    found = match.promote(rows, domain.services(spark, d))
    return found.select("norm", "service_name", "category", "n_items")


def catalog_upsert(spark, d):
    base = match.first_of(domain.services(spark, d), ["service_name"], "service_id").select("service_name", "category", "is_active")
    new = domain.services(spark, d).where("service_id % 3 = 0").select(F.when(F.col("service_id") % 2 == 0, F.concat("service_name", F.lit(" new"))).otherwise(F.col("service_name")).alias("service_name"), F.upper("category").alias("category"), F.col("service_id").alias("row"))
    return match.upsert_catalogue(base.where("is_active"), new).select("service_name", "category", "is_active", "change")


def partner_resolve(spark, d):
    known = domain.read(spark, d, "supplier").select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner_name"), F.lpad(F.col("s_suppkey").cast("string"), 12, "7").alias("bin"))
    docs = domain.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" supplier#"), F.lpad((F.col("o_custkey") % 120).cast("string"), 9, "0"))).alias("name"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("BIN "), F.lpad((F.col("o_custkey") % 130).cast("string"), 12, "7"))).when(F.col("o_orderkey") % 4 == 1, "123").alias("bin"))
    return match.resolve_partners(docs, known).select("document_id", F.coalesce("partner_id", F.lit(-1)).alias("partner_id"), "by", "partner_confidence")


def price_list_heads(spark, d):
    """Documents with the names and numbers of known providers, of new ones, of both at odds, or without either."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(key % 7 == 0, F.lit("  ")).when(key % 11 == 0, "!!").when(key % 3 != 0, F.concat(F.lit(" supplier#"), F.lpad((cust % 40 + 80).cast("string"), 9, "0"), F.when(key % 5 == 0, "!").otherwise("")))
    number = F.when(key % 4 == 0, F.concat(F.lit("BIN "), F.lpad((cust % 30 + 85).cast("string"), 12, "7"))).when(key % 4 == 1, F.when(key % 8 == 1, "123").otherwise(F.lpad((cust % 20).cast("string"), 12, "3")))
    return domain.read(spark, d, "orders").select(key.alias("document_id"), name.alias("name"), number.alias("bin"))


def known_providers(spark, d):
    number = F.when(F.col("s_suppkey") % 3 != 0, F.lpad(F.col("s_suppkey").cast("string"), 12, "7"))
    return domain.read(spark, d, "supplier").select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner_name"), number.alias("bin"))


def partner_create(spark, d):
    done, _ = providers.resolve_or_create(price_list_heads(spark, d), known_providers(spark, d))
    return done.select("document_id", "partner_id", "by", "partner_confidence")


def search_ranked(spark, d):
    found = search.services("ring", domain.services(spark, d), lists.active_items(spark, d), fuzzy=False)
    return found.select("service_id", "service_name", "score", "partner_count", F.col("min_price").cast("double").alias("min_price"), F.col("max_price").cast("double").alias("max_price"))


def search_fuzzy(spark, d):
    return search.services("smal gizmo", domain.services(spark, d), lists.active_items(spark, d)).select("service_id", "service_name", "score", "partner_count")


def misspelt(spark, d):
    """Queries as people type them: the catalogue's names with a letter of the first word left out."""
    name = F.col("p_name")
    rows = domain.read(spark, d, "part").select("p_partkey", F.concat(F.substring(name, 1, 1), F.expr("substring(p_name, 3)")).alias("query"))
    return rows.groupBy("query").agg(F.min("p_partkey").alias("query_id"))


def search_many(spark, d):
    found = search.services_of(misspelt(spark, d), domain.services(spark, d), lists.active_items(spark, d))
    return found.select("query_id", "rank", "service_id", "score", "partner_count", F.col("min_price").cast("double").alias("min_price"), F.col("max_price").cast("double").alias("max_price"))


def search_providers(spark, d):
    return search.providers("supplier#000000001", domain.partners(spark, d), lists.active_items(spark, d)).select("partner_id", "partner_name", "score", "service_count")


def embedding_topk(spark, d):
    return neighbours(spark, d, "vec_id < 20")


def embedding_topk_all(spark, d):
    """Asks with every row; embedding_topk asks with 20, as its SQL does."""
    return neighbours(spark, d)


def neighbours(spark, d, asked=None):
    rows = domain.read(spark, d, "embeddings")
    found = match.cosine_top_k(rows if asked is None else rows.where(asked), rows)
    return found.select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (normalize_text, language_detect, parse_price_cells, header_hints, match_exact_synonym, match_cascade, rematch_queue, promote_unmatched, catalog_upsert, partner_resolve, partner_create, search_ranked, search_fuzzy, search_many, search_providers, embedding_topk, embedding_topk_all)}

D = f"WITH {domain.SQL}"
NORM = "array_to_string(regexp_extract_all(translate(lower({}), 'ё', 'е'), '[a-z0-9\\x{{0400}}-\\x{{04FF}}]+'), ' ')"
RAW = "SELECT service_id AS name_id, CASE service_id % 4 WHEN 0 THEN service_name WHEN 1 THEN '  ' || upper(service_name) || '!! ' WHEN 2 THEN synonyms[1] ELSE substr(service_name, 1, 3) || 'x' || substr(service_name, 5) END AS raw FROM services"
SERVICE_TEXTS = "SELECT service_id AS owner, service_name AS owner_name, unnest([service_name, category] || synonyms) AS text, unnest([true, false] || list_transform(synonyms, lambda x: false)) AS is_name FROM services WHERE is_active"
PARTNER_TEXTS = "SELECT partner_id AS owner, partner_name AS owner_name, unnest([partner_name, city]) AS text, unnest([true, false]) AS is_name FROM partners WHERE is_active"


def hits(queries: str, texts: str) -> str:
    """CTEs that give hits (query_id, rank, owner, owner_name, score) of all queries over all texts, every pair scored."""
    return f"""q AS (SELECT query_id, lower(trim(query)) AS q, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM ({queries})
), x AS (SELECT owner, owner_name, lower(text) AS text, is_name FROM ({texts}) WHERE text <> ''
), pairs AS (SELECT q AS a, text AS b FROM (SELECT DISTINCT q FROM q), (SELECT DISTINCT text FROM x)
), {scores.ctes("pairs", always_parts=True)}, base AS (
  SELECT a, b, greatest(token_set, part) AS s, CASE WHEN b = a THEN 130 WHEN starts_with(b, a) THEN 115 WHEN contains(b, a) THEN 100 ELSE 0 END AS boost FROM scored
), owners AS (
  SELECT query_id, owner, owner_name, round(max(greatest(s, boost)), 2)::DOUBLE AS score, bool_or(len(list_filter(tokens, lambda w: contains(text, w))) > 0) AS gate, max(CASE WHEN is_name THEN s END) AS own
  FROM q JOIN base ON a = q JOIN x ON text = b GROUP BY query_id, owner, owner_name
), hits AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner_name, owner) AS INTEGER) AS rank, owner, owner_name, score FROM owners WHERE (gate OR own >= 90) AND score >= 60 QUALIFY rank <= 25
)"""


COUNT = "length(regexp_replace(lower(coalesce(text, '')), '[^{}]', '', 'g'))"
WHOLE = "CAST(CAST(floor(p) AS BIGINT) AS VARCHAR)"

SQL = {
    "normalize_text": f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5, CAST(len(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[a-z0-9\\x{{0400}}-\\x{{04FF}}]+')) AS BIGINT) AS n_tokens FROM documents",
    "language_detect": f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), text FROM conversations),
c AS (SELECT id, {COUNT.format('әғқңөұүһі')} AS kk, {COUNT.format('а-яё')} AS cyr, {COUNT.format('a-z')} AS lat FROM t)
SELECT id, CASE WHEN kk > 0 THEN 'kk' WHEN cyr = 0 AND lat = 0 THEN NULL WHEN cyr >= lat THEN 'ru' ELSE 'en' END AS language FROM c""",
    "parse_price_cells": """WITH r AS (SELECT *, CAST(l_extendedprice AS DECIMAL(14,2)) AS p, l_partkey % 8 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k IN (0, 1, 3, 7) THEN CAST(floor(p) AS DOUBLE) WHEN k = 2 THEN CAST(p AS DOUBLE) WHEN k = 6 THEN CAST(floor(p) AS DOUBLE) + 0.5 END AS value, CASE k WHEN 1 THEN 'USD' WHEN 3 THEN 'RUB' ELSE 'KZT' END AS currency FROM r""",
    "header_hints": D + """, r AS (SELECT document_id, batch_id, document_id % 4 AS k, coalesce(effective_date, DATE '2024-02-01') AS day FROM docs), y AS (SELECT *, '20' || strftime(day, '%y') AS year FROM r)
SELECT document_id, CASE k WHEN 0 THEN 'Клиника ' || batch_id WHEN 1 THEN 'Alpha' WHEN 2 THEN 'Beta ' || batch_id END AS partner,
  CASE WHEN k IN (0, 1) THEN CAST(TRY_CAST(year || strftime(day, '-%m-%d') AS DATE) AS VARCHAR) WHEN k = 2 THEN year || '-01-01' END AS day FROM y""",
    "match_exact_synonym": D + f""", raw AS ({RAW}), a AS (SELECT * FROM services WHERE is_active),
texts AS (SELECT {NORM.format('service_name')} AS text, 0 AS kind, service_id, service_name FROM a UNION ALL SELECT {NORM.format('s')}, 1, service_id, service_name FROM (SELECT unnest(synonyms) AS s, service_id, service_name FROM a)),
best AS (SELECT * FROM texts WHERE length(text) >= 2 QUALIFY row_number() OVER (PARTITION BY text ORDER BY kind, service_name, service_id) = 1), n AS (SELECT name_id, {NORM.format('raw')} AS norm FROM raw)
SELECT name_id, norm, coalesce(b.service_id, -1) AS service_id, CASE b.kind WHEN 0 THEN 'exact' WHEN 1 THEN 'synonym' ELSE 'none' END AS method FROM n LEFT JOIN best b ON n.norm = b.text""",
    "match_cascade": D + f""", raw AS ({RAW}), a AS (SELECT * FROM services WHERE is_active),
texts AS (SELECT * FROM (SELECT {NORM.format('service_name')} AS text, 0 AS kind, service_id, service_name FROM a UNION ALL SELECT {NORM.format('s')}, 1, service_id, service_name FROM (SELECT unnest(synonyms) AS s, service_id, service_name FROM a)) WHERE length(text) >= 2),
best AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY text ORDER BY kind, service_name, service_id) = 1), n AS (SELECT DISTINCT raw, {NORM.format('raw')} AS norm FROM raw),
quick AS (SELECT n.*, b.service_id AS own, b.kind FROM n LEFT JOIN best b ON n.norm = b.text),
pairs AS (SELECT norm AS a, text AS b FROM (SELECT DISTINCT norm FROM quick WHERE own IS NULL AND length(norm) >= 2), (SELECT DISTINCT text FROM texts)), {scores.ctes("pairs")},
each AS (SELECT a AS norm, service_id, service_name, max(round(greatest(token_set, weighted) / 100, 4)) AS score FROM scored JOIN texts ON b = text GROUP BY a, service_id, service_name),
top AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, service_name, service_id) AS rank FROM each QUALIFY rank <= 5),
lists AS (SELECT norm, min(service_id) FILTER (rank = 1) AS first, max(score) AS score, CAST(count(*) AS INTEGER) AS n FROM top GROUP BY norm),
told AS (SELECT q.*, l.first, l.n, CASE WHEN own IS NOT NULL THEN 1.0 ELSE l.score END::DOUBLE AS confidence FROM quick q LEFT JOIN lists l ON l.norm = q.norm AND own IS NULL)
SELECT raw, norm, CASE WHEN own IS NOT NULL THEN own WHEN confidence >= 0.6 THEN first ELSE -1 END AS service_id, CASE WHEN kind = 0 THEN 'exact' WHEN kind = 1 THEN 'synonym' WHEN first IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method,
  confidence, CASE WHEN confidence >= 0.85 THEN 'matched_auto' WHEN confidence >= 0.6 THEN 'needs_review' ELSE 'unmatched' END AS status, coalesce(n, 0) AS n_candidates FROM told""",
    "search_fuzzy": lists.ACTIVE + f""", {hits("SELECT 0 AS query_id, 'smal gizmo' AS query", SERVICE_TEXTS)}
SELECT h.owner AS service_id, any_value(owner_name) AS service_name, any_value(score) AS score, count(DISTINCT act.partner_id) AS partner_count FROM hits h LEFT JOIN act ON act.service_id = h.owner GROUP BY h.owner""",
    "search_many": lists.ACTIVE + f""", {hits("SELECT min(p_partkey) AS query_id, substr(p_name, 1, 1) || substr(p_name, 3) AS query FROM part GROUP BY 2", SERVICE_TEXTS)}
, sums AS (SELECT service_id, count(DISTINCT partner_id) AS n, min(resident_kzt) AS low, max(resident_kzt) AS high FROM act GROUP BY service_id)
SELECT query_id, rank, owner AS service_id, score, coalesce(n, 0) AS partner_count, CAST(low AS DOUBLE) AS min_price, CAST(high AS DOUBLE) AS max_price FROM hits LEFT JOIN sums ON service_id = owner""",
    "search_providers": lists.ACTIVE + f""", {hits("SELECT 0 AS query_id, 'supplier#000000001' AS query", PARTNER_TEXTS)}
, sums AS (SELECT partner_id, count(DISTINCT service_id) AS n FROM act WHERE service_id IS NOT NULL GROUP BY partner_id)
SELECT owner AS partner_id, owner_name AS partner_name, score, coalesce(n, 0) AS service_count FROM hits LEFT JOIN sums ON partner_id = owner""",
    "rematch_queue": D + f""", raw AS ({RAW}), a AS (SELECT * FROM services WHERE is_active AND service_id % 7 <> 0),
texts AS (SELECT * FROM (SELECT {NORM.format('service_name')} AS text, service_id, service_name FROM a UNION ALL SELECT {NORM.format('s')}, service_id, service_name FROM (SELECT unnest(synonyms) AS s, service_id, service_name FROM a)) WHERE length(text) >= 2),
pairs AS (SELECT norm AS a, text AS b FROM (SELECT DISTINCT {NORM.format('raw')} AS norm FROM raw WHERE name_id % 4 = 3), (SELECT DISTINCT text FROM texts)), {scores.ctes("pairs")},
each AS (SELECT a AS norm, service_id, service_name, max(round(greatest(token_set, weighted) / 100, 4)) AS score FROM scored JOIN texts ON b = text GROUP BY a, service_id, service_name)
SELECT norm, service_id, CAST(score AS DOUBLE) AS score FROM each QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, service_name, service_id) <= 5""",
    "promote_unmatched": D + f""", r AS (SELECT *, {NORM.format('service_name_raw')} AS norm, 'Section ' || (document_id % 7) AS section FROM items WHERE match_status IN ('unmatched', 'needs_review')),
s AS (SELECT norm, section, count(*) AS n, min(item_id) AS f FROM r GROUP BY norm, section QUALIFY row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, min(item_id)) = 1),
m AS (SELECT norm, service_name_raw, count(*) AS n, min(item_id) AS f FROM r GROUP BY norm, service_name_raw QUALIFY row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, min(item_id)) = 1)
SELECT r.norm, any_value(m.service_name_raw) AS service_name, any_value(s.section) AS category, count(*) AS n_items FROM r JOIN m USING (norm) JOIN s USING (norm) GROUP BY r.norm""",
    "catalog_upsert": D + """, base AS (SELECT * FROM (SELECT service_name, category, is_active FROM services QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY service_id) = 1) WHERE is_active),
new AS (SELECT CASE WHEN service_id % 2 = 0 THEN service_name || ' new' ELSE service_name END AS name, upper(category) AS category, service_id FROM services WHERE service_id % 3 = 0), last AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY name ORDER BY service_id DESC) = 1)
SELECT coalesce(service_name, name) AS service_name, CASE WHEN name IS NOT NULL THEN l.category ELSE b.category END AS category, name IS NOT NULL OR is_active AS is_active, CASE WHEN service_name IS NULL THEN 'created' WHEN name IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM base b FULL JOIN last l ON service_name = name""",
    "partner_resolve": """WITH k AS (SELECT s_suppkey, lower(s_name) AS name, lpad(CAST(s_suppkey AS VARCHAR), 12, '7') AS bin FROM supplier),
d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'supplier#' || lpad(CAST(o_custkey % 120 AS VARCHAR), 9, '0') END AS name, CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_custkey % 130 AS VARCHAR), 12, '7') END AS bin FROM orders)
SELECT document_id, coalesce(b.s_suppkey, n.s_suppkey, -1) AS partner_id, CASE WHEN b.s_suppkey IS NOT NULL THEN 'bin' WHEN n.s_suppkey IS NOT NULL THEN 'name' ELSE 'new' END AS by, CASE WHEN d.bin IS NOT NULL THEN 0.9 WHEN d.name IS NOT NULL THEN 0.6 ELSE 0.3 END::DOUBLE AS partner_confidence
FROM d LEFT JOIN (SELECT bin, min(s_suppkey) AS s_suppkey FROM k GROUP BY bin) b ON d.bin = b.bin LEFT JOIN k n ON d.name = n.name""",
    "partner_create": f"""WITH RECURSIVE known AS (SELECT s_suppkey AS partner, {NORM.format('s_name')} AS n, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 12, '7') END AS b FROM supplier),
raw AS (SELECT o_orderkey AS document, CASE WHEN o_orderkey % 7 = 0 THEN '  ' WHEN o_orderkey % 11 = 0 THEN '!!' WHEN o_orderkey % 3 <> 0 THEN 'supplier#' || lpad(CAST(o_custkey % 40 + 80 AS VARCHAR), 9, '0') END AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_custkey % 30 + 85 AS VARCHAR), 12, '7') WHEN o_orderkey % 4 = 1 AND o_orderkey % 8 <> 1 THEN lpad(CAST(o_custkey % 20 AS VARCHAR), 12, '3') END AS b FROM orders),
docs AS (SELECT *, {NORM.format("coalesce(nullif(trim(name), ''), 'неизвестный партнер')")} AS n FROM raw), base AS (SELECT max(s_suppkey) AS base FROM supplier),
ev AS (SELECT *, row_number() OVER (ORDER BY document NULLS FIRST, partner) AS i FROM (SELECT partner, NULL AS document, b, n FROM known UNION ALL SELECT NULL, min(document), b, n FROM docs WHERE b IS NOT NULL OR n <> '' GROUP BY b, n)),
r AS (
  SELECT 0::BIGINT AS i, MAP {{'': 0::BIGINT}} AS bins, MAP {{'': 0::BIGINT}} AS since, MAP {{'': 0::BIGINT}} AS names, []::BIGINT[] AS numbered
  UNION ALL
  SELECT i, CASE WHEN gives AND bins[b] IS NULL THEN map_concat(bins, MAP {{b: found}}) ELSE bins END, CASE WHEN gives AND bins[b] IS NULL THEN map_concat(since, MAP {{b: coalesce(document, -1)}}) ELSE since END,
    CASE WHEN (partner IS NOT NULL OR made) AND n <> '' AND names[n] IS NULL THEN map_concat(names, MAP {{n: found}}) ELSE names END, CASE WHEN gives THEN list_append(numbered, found) ELSE numbered END
  FROM (SELECT *, b IS NOT NULL AND NOT list_contains(numbered, found) AS gives FROM (
    SELECT ev.*, bins, since, names, numbered, coalesce(partner, bins[b], CASE WHEN n <> '' THEN names[n] END, base + 1 + document) AS found, bins[b] IS NULL AND (n = '' OR names[n] IS NULL) AS made
    FROM r JOIN ev ON ev.i = r.i + 1, base))
), last AS (SELECT * FROM r ORDER BY i DESC LIMIT 1),
told AS (SELECT d.*, bins[b] AS owner, since[b] AS since, CASE WHEN n <> '' THEN names[n] END AS called, base + 1 + document AS own FROM docs d, last, base),
done AS (SELECT *, owner IS NOT NULL AND since <= document AS had FROM told)
SELECT document AS document_id, CASE WHEN had THEN owner ELSE coalesce(called, own) END AS partner_id, CASE WHEN CASE WHEN had THEN owner ELSE coalesce(called, own) END = own THEN 'new' WHEN had AND since < document THEN 'bin' ELSE 'name' END AS by,
  CASE WHEN b IS NOT NULL THEN 0.9 WHEN trim(coalesce(name, '')) <> '' THEN 0.6 ELSE 0.3 END::DOUBLE AS partner_confidence FROM done""",
    "search_ranked": lists.ACTIVE + """, t AS (SELECT service_id, service_name, list_filter([service_name, category, synonyms[1]], lambda x: x IS NOT NULL AND x <> '') AS texts FROM services WHERE is_active),
s AS (SELECT service_id, service_name, list_max(list_transform(texts, lambda x: CASE WHEN lower(x) = 'ring' THEN 130.0 WHEN starts_with(lower(x), 'ring') THEN 115.0 WHEN contains(lower(x), 'ring') THEN 100.0 ELSE 0.0 END))::DOUBLE AS score FROM t),
top AS (SELECT * FROM s WHERE score >= 60 ORDER BY score DESC, service_name, service_id LIMIT 25)
SELECT t.service_id, service_name, score, count(DISTINCT partner_id) AS partner_count, CAST(min(resident_kzt) AS DOUBLE) AS min_price, CAST(max(resident_kzt) AS DOUBLE) AS max_price FROM top t LEFT JOIN act USING (service_id) GROUP BY ALL""",
    "embedding_topk": "SELECT a.vec_id AS query, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < 20 AND a.vec_id <> b.vec_id QUALIFY rank <= 5",
}
SQL["embedding_topk_all"] = SQL["embedding_topk"].replace("a.vec_id < 20 AND ", "")
