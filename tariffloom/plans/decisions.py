"""Queries that go all the way: the cascade with headers, prior and vectors; decisions on items; searches in trees and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import listing, match, statistics, tree, versioning
from ..sources import sinks
from . import domain, matching, scores


def raw_items(spark, d):
    """Items as read from price lists: misspelt names with a section and a price, and headings without."""
    key, heading = F.col("service_id"), F.col("service_id") % 9 == 0
    s = domain.services(spark, d)
    name = F.concat(F.substring("service_name", 1, 3), F.lit("x"), F.expr("substring(service_name, 5)"))
    return s.select(
        key.alias("item_id"), F.when(heading, F.concat(F.lit("РАЗДЕЛ "), key.cast("string"))).otherwise(name).alias("service_name_raw"), F.when(heading, None).otherwise(key * 10).cast("double").alias("price"),
        F.col("specialty").alias("section"), F.lit(None).cast("string").alias("code"),
    )


def full_cascade(spark, d):
    """Headings go, sections tell specialties whose services alone may match, vectors override lower scores."""
    items = match.drop_headers(raw_items(spark, d), ["price"], "code")
    asked = items.withColumn("norm", text.normalise(F.col("service_name_raw"))).groupBy("norm").agg(F.min("section").alias("section"), F.min("item_id").alias("first"))
    services = domain.services(spark, d)
    links = services.where("service_id % 4 <> 0").select("service_id", "specialty")
    rows = asked.select("norm", F.when(F.col("first") % 3 != 0, F.col("section")).alias("section"), F.lit(None).cast("array<string>").alias("section_path"))
    allowed = match.allowed_services(rows, "norm", links)
    hits = asked.where("first % 5 = 0").select("norm", F.col("first").alias("service_id"), F.when(F.col("first") % 2 == 0, 0.97).otherwise(0.3).alias("score"))
    found = match.cascade(items.select(F.col("service_name_raw").alias("raw")), services, allowed=allowed, vector_hits=hits)
    top = F.try_element_at("candidates", F.lit(1))
    return found.select("norm", F.coalesce("service_id", F.lit(-1)).alias("service_id"), "method", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "status", F.coalesce(top["service_id"], F.lit(-1)).alias("first_candidate"))


def decided_items(spark, d):
    items = domain.items(spark, d).select("item_id", "partner_id", "document_id", "service_id", "match_status", F.lit(0.5).alias("match_confidence"), "is_verified", F.lit(True).alias("needs_review"))
    action = F.element_at(F.array(*map(F.lit, ("approve", "reject", "match"))), (F.col("partner_id") % 3 + 1).cast("int"))
    first = items.where("document_id % 5 = 0").select("item_id", action.alias("action"), F.when(F.col("partner_id") % 3 == 2, 7).cast("long").alias("service_id"), F.lit("ann").alias("operator"), F.lit(1).alias("decided_at"))
    later = items.where("document_id % 5 = 0 AND partner_id % 2 = 0").select("item_id", F.lit("match").alias("action"), F.lit(9).cast("long").alias("service_id"), F.lit("bob").alias("operator"), F.lit(2).alias("decided_at"))
    done = versioning.decide(items, first.unionByName(later))
    return done.select("item_id", F.coalesce("service_id", F.lit(-1)).alias("service_id"), "match_status", "match_confidence", "is_verified", "needs_review", F.coalesce("verified_by", F.lit("-")).alias("verified_by"))


def created_matches(spark, d):
    """Decisions that name services, some of which the catalogue has, others that several decisions name."""
    items = domain.items(spark, d).select("item_id", "partner_id", "document_id", "service_id", "match_status", F.lit(0.5).alias("match_confidence"), "is_verified", F.lit(True).alias("needs_review"))
    services = domain.services(spark, d).select("service_id", "service_name", "is_active")
    named = F.when(F.col("partner_id") % 3 == 0, F.concat(F.lit(" New "), (F.col("partner_id") % 10).cast("string"))).when(F.col("partner_id") % 3 == 1, "hot ring")
    told = items.where("document_id % 7 = 0").select("item_id", F.lit("match").alias("action"), F.when(named.isNull(), 5).cast("long").alias("service_id"), named.alias("new_service"), F.lit("ann").alias("operator"), F.lit(1).alias("decided_at"))
    decided, known = versioning.create_services(told, services)
    done = versioning.decide(items, decided.drop("new_service")).where("document_id % 7 = 0")
    called = done.join(known.select("service_id", "service_name"), "service_id", "left")
    return called.select("item_id", F.coalesce("service_id", F.lit(-1)).alias("service_id"), F.coalesce("service_name", F.lit("-")).alias("service_name"), "match_status", "needs_review")


def catalogue_paths(spark, d):
    key = F.col("service_id")
    s = domain.services(spark, d)
    path = F.when(key % 5 == 0, F.array(F.lit(" "), F.col("service_name"))).when(key % 5 == 1, F.array().cast("array<string>"))
    specialties = F.when(key % 3 == 0, F.array(F.lit("b"), F.concat(F.lit(" A"), F.col("specialty")), F.lit("a"))).when(key % 3 == 1, F.array(F.lit(" ")))
    return s.select("service_id", F.array_join(text.catalogue_path(path, F.when(key % 2 == 0, F.col("category")).otherwise(" "), specialties), "/").alias("path"))


def pruned_tree(spark, d):
    leaves = domain.services(spark, d).select(F.split(F.coalesce("category", F.lit("")), " ").alias("path"), "service_name").where("category IS NOT NULL")
    return tree.pruned(leaves, F.contains("service_name", F.lit("ring"))).select("node", "depth", "n_leaves", "n_direct")


def text_filter(spark, d):
    rows = listing.any_text_contains(domain.partners(spark, d), " A1 ", "partner_name", "city")
    other = listing.any_text_contains(domain.partners(spark, d), " 7", "partner_name", "city")
    return rows.unionByName(other).distinct().select("partner_id", "partner_name")


def catalogue_changes(spark, d):
    s = domain.services(spark, d)
    return statistics.created_updated(s.select(F.lower("service_name").alias("k")), s.where("service_id % 3 = 0").select(F.lower("service_name").alias("k")), "k")


def json_report(spark, d):
    counts = domain.documents(spark, d).groupBy("file_format").agg(F.count("*").alias("documents"))
    return sinks.as_json(counts, ["file_format", "documents"], F.col("file_format").desc())


QUERIES = {f.__name__: f for f in (full_cascade, decided_items, created_matches, catalogue_paths, pruned_tree, text_filter, catalogue_changes, json_report)}
D = f"WITH {domain.SQL}"
NORM = matching.NORM
SQL = {
    "full_cascade": D + f""", a AS (SELECT * FROM services WHERE is_active),
i AS (SELECT service_id AS item_id, substr(service_name, 1, 3) || 'x' || substr(service_name, 5) AS raw, specialty FROM services WHERE service_id % 9 <> 0),
n AS (SELECT {NORM.format('raw')} AS norm, min(specialty) AS section, min(item_id) AS first FROM i GROUP BY 1),
texts AS (SELECT * FROM (SELECT {NORM.format('service_name')} AS text, 0 AS kind, service_id, service_name FROM a UNION ALL SELECT {NORM.format('s')}, 1, service_id, service_name FROM (SELECT unnest(synonyms) AS s, service_id, service_name FROM a)) WHERE length(text) >= 2),
quick AS (SELECT text, arg_min({{'k': kind, 's': service_id}}, {{'k': kind, 'n': service_name, 's': service_id}}) AS q FROM texts GROUP BY text),
links AS (SELECT service_id, specialty FROM services WHERE service_id % 4 <> 0),
bound AS (SELECT n.*, EXISTS (SELECT 1 FROM links WHERE links.specialty = n.section) AND first % 3 <> 0 AS bound FROM n),
pairs AS (SELECT norm AS a, text AS b FROM n, (SELECT DISTINCT text FROM texts)), {scores.ctes("pairs")},
each AS (SELECT b.norm, t.service_id, t.service_name, max(round(greatest(token_set, weighted) / 100, 4)) AS score FROM bound b JOIN scored s ON s.a = b.norm JOIN texts t ON s.b = t.text
  WHERE NOT bound OR EXISTS (SELECT 1 FROM links l WHERE l.specialty = b.section AND l.service_id = t.service_id) GROUP BY ALL),
hit AS (SELECT norm, first AS service_id, CASE WHEN first % 2 = 0 THEN 0.97 ELSE 0.3 END AS v FROM n WHERE first % 5 = 0),
best AS (SELECT norm, service_id, service_name, greatest(score, coalesce(v, 0)) AS score, CASE WHEN v > score THEN 'embedding' ELSE 'fuzzy' END AS method FROM each LEFT JOIN hit USING (norm, service_id)
  QUALIFY row_number() OVER (PARTITION BY norm ORDER BY greatest(score, coalesce(v, 0)) DESC, service_name, service_id) = 1),
told AS (SELECT n.norm, q.q.s AS own, q.q.k AS kind, b.service_id AS top, b.method, CASE WHEN q.q.s IS NOT NULL THEN 1.0 ELSE coalesce(b.score, 0) END::DOUBLE AS c FROM n LEFT JOIN quick q ON q.text = n.norm LEFT JOIN best b ON b.norm = n.norm AND q.q IS NULL)
SELECT norm, coalesce(own, CASE WHEN c >= 0.6 THEN top END, -1) AS service_id, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN 'synonym' ELSE coalesce(method, 'none') END AS method, c AS confidence,
  CASE WHEN c >= 0.85 THEN 'matched_auto' WHEN c >= 0.6 THEN 'needs_review' ELSE 'unmatched' END AS status, coalesce(top, -1) AS first_candidate FROM told""",
    "decided_items": D + """, r AS (SELECT *, document_id % 5 = 0 AS told, partner_id % 3 AS k, partner_id % 2 = 0 AS again FROM items)
SELECT item_id, coalesce(CASE WHEN told AND again THEN 9 WHEN told AND k = 2 THEN 7 END, service_id, -1) AS service_id, CASE WHEN told AND (again OR k = 2) THEN 'matched_manual' ELSE match_status END AS match_status,
  CASE WHEN told AND (again OR k = 2) THEN 1.0 ELSE 0.5 END::DOUBLE AS match_confidence, is_verified OR (told AND (again OR k <> 1)) AS is_verified, NOT (told AND (again OR k <> 1)) AS needs_review,
  CASE WHEN told AND again THEN 'bob' WHEN told AND k <> 1 THEN 'ann' ELSE '-' END AS verified_by FROM r""",
    "created_matches": D + """, r AS (SELECT *, CASE partner_id % 3 WHEN 0 THEN 'New ' || partner_id % 10 WHEN 1 THEN 'hot ring' END AS named FROM items WHERE document_id % 7 = 0),
fresh AS (SELECT DISTINCT named FROM r WHERE named IS NOT NULL AND named NOT IN (SELECT service_name FROM services)),
known AS (SELECT min(service_id) AS id, service_name AS name FROM services GROUP BY 2 UNION ALL SELECT row_number() OVER (ORDER BY named) + (SELECT max(service_id) FROM services), named FROM fresh)
SELECT item_id, coalesce(k.id, 5) AS service_id, coalesce(k.name, s.service_name, '-') AS service_name, 'matched_manual' AS match_status, false AS needs_review FROM r LEFT JOIN known k ON k.name = r.named LEFT JOIN services s ON s.service_id = 5 AND r.named IS NULL""",
    "catalogue_paths": D + """ SELECT service_id, CASE WHEN service_id % 5 = 0 THEN service_name WHEN service_id % 2 = 0 AND category IS NOT NULL THEN category
  WHEN service_id % 3 = 0 THEN CASE WHEN lower('A' || specialty) < 'a' THEN 'A' || specialty ELSE 'a' END ELSE 'Без категории' END AS path FROM services""",
    "pruned_tree": D + """, l AS (SELECT string_split(category, ' ') AS p FROM services WHERE category IS NOT NULL AND contains(service_name, 'ring')),
n AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM l)
SELECT array_to_string(p[1:depth], ' / ') AS node, CAST(depth AS INTEGER) AS depth, count(*) AS n_leaves, count(*) FILTER (depth = len(p)) AS n_direct FROM n GROUP BY 1, 2""",
    "text_filter": D + " SELECT partner_id, partner_name FROM partners WHERE contains(lower(partner_name || chr(10) || coalesce(city, '')), 'a1') OR contains(lower(partner_name || chr(10) || coalesce(city, '')), '7')",
    "catalogue_changes": D + ", k AS (SELECT lower(service_name) AS k, bool_or(service_id % 3 = 0) AS have FROM services GROUP BY 1) SELECT count(*) FILTER (NOT have) AS created, count(*) FILTER (have) AS updated FROM k",
    "json_report": D + """, c AS (SELECT file_format, count(*) AS n FROM docs GROUP BY 1)
SELECT '[' || string_agg('{"file_format":"' || file_format || '","documents":' || n || '}', ',' ORDER BY file_format DESC) || ']' AS report FROM c""",
}
