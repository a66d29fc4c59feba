"""Matching raw names to the catalogue: exact, synonym, fuzzy, vector; specialty prior; promotion; upserts; providers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prices
from ..functions.prices import is_item_header
from ..functions.similarity import fuzzy_rounded
from ..functions.text import business_id, normalise
from .fuzzyjoin import best_entries

AUTO, REVIEW, SPECIALTY, LEAST = 0.85, 0.60, 0.62, 2
SMALL, LEAST_PART, CELLS = 65_536, 2_048, 4_000_000  # vectors of a tile or block at most and at least, about; scores that are held at a time
GROUPS, GROUP, PAIRS = 8, 32, 32_768  # tiles and blocks that meet for each core; rows of a group; pairs computed exactly at a time


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def catalogue_texts(services: DataFrame) -> DataFrame:
    """text, kind (exact or synonym), service_id, service_name of active services, normalised and long enough."""
    active = services.where("is_active")
    names = active.select(normalise(F.col("service_name")).alias("text"), F.lit("exact").alias("kind"), "service_id", "service_name")
    other = active.select(F.explode("synonyms").alias("s"), "service_id", "service_name").select(normalise(F.col("s")).alias("text"), F.lit("synonym").alias("kind"), "service_id", "service_name")
    return names.unionByName(other).where(F.length("text") >= LEAST)


def exact_or_synonym(names: DataFrame, services: DataFrame, raw: str = "raw") -> DataFrame:
    """names with norm, service_id, method (exact, synonym or none) and confidence. Of equal texts the catalogue's first
    row (by name, then id) wins; exact ones come before synonyms; too short names match nothing."""
    texts = catalogue_texts(services)
    best = first_of(texts, ["text"], F.when(F.col("kind") == "exact", 0).otherwise(1), "service_name", "service_id").select("text", F.col("kind").alias("_kind"), "service_id")
    done = names.withColumn("norm", normalise(F.col(raw))).join(best, F.col("norm") == F.col("text"), "left").drop("text")
    return done.withColumn("method", F.coalesce("_kind", F.lit("none"))).withColumn("confidence", F.when(F.col("_kind").isNotNull(), 1.0)).drop("_kind")


def infer_specialty(sections: DataFrame, specialties: DataFrame, column: str = "section", least: float = SPECIALTY) -> DataFrame:
    """sections with specialty: the best-scoring one of at least that score (ties by name), or null.

    Distinct texts are compared with the distinct specialties, most of them by bounds alone (fuzzyjoin)."""
    known = specialties.select("specialty").where("specialty <> ''").distinct()
    texts = known.select(normalise(F.col("specialty")).alias("text"), F.col("specialty").alias("owner"), F.col("specialty").alias("owner_name"))
    distinct = sections.select(F.col(column).alias("_s"), normalise(F.col(column)).alias("_norm")).where("_norm <> ''").distinct()
    told = best_entries(distinct, texts, 1, "_norm").where(F.col("score") >= least).select("_norm", F.col("owner").alias("specialty"))
    best = distinct.join(told, "_norm").select("_s", "specialty")
    return sections.join(best, sections[column] == best["_s"], "left").drop("_s")


def specialty_prior(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """key, specialty, n_allowed: the specialty whose services (links: service_id, specialty) an item may be matched to.

    Levels of section_path count from the innermost to the outermost, then section; the first that names a specialty with
    services decides. Without any, all services are allowed, and both columns are null."""
    levels = F.array_distinct(F.filter(F.transform(F.concat(F.reverse(F.coalesce("section_path", F.array().cast("array<string>"))), F.array("section")), lambda x: F.trim(x)), lambda x: x != ""))
    walked = rows.select(key, F.posexplode(levels).alias("_level", "section"))
    sizes = links.groupBy("specialty").agg(F.countDistinct("service_id").alias("n_allowed"))
    told = infer_specialty(walked, links).join(sizes, "specialty")
    first = told.groupBy(key).agg(F.min(F.struct("_level", "specialty", "n_allowed")).alias("_f")).select(key, "_f.specialty", "_f.n_allowed")
    return rows.select(key).join(first, key, "left")


def allowed_services(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """key, service_id: the services that specialty_prior() allows, for cascade(); nothing for items that it doesn't bind."""
    return specialty_prior(rows, key, links).where("specialty IS NOT NULL").join(links.select("specialty", "service_id").distinct(), "specialty").select(key, "service_id")


SPECIALTY_NAME = 0.90


def without_specialty_rows(rows: DataFrame, specialties: DataFrame, column: str) -> DataFrame:
    """rows without those that have no price and no code (has_price, has_code) and are named like a specialty."""
    bare = rows.where(~F.col("has_price") & ~F.col("has_code")).select(F.col(column).alias("_n")).distinct()
    named = infer_specialty(bare, specialties, "_n", SPECIALTY_NAME).where("specialty IS NOT NULL").select("_n")
    return rows.join(named, (F.col(column) == F.col("_n")) & ~F.col("has_price") & ~F.col("has_code"), "left_anti")


def enriched(hits: DataFrame, paths: DataFrame) -> DataFrame:
    """hits with category_path, an empty one for services without."""
    return hits.join(paths.select("service_id", "category_path"), "service_id", "left").withColumn("category_path", F.coalesce("category_path", F.array().cast("array<string>")))


def cascade(names: DataFrame, services: DataFrame, raw: str = "raw", allowed: DataFrame | None = None, vector_hits: DataFrame | None = None, top: int = 5) -> DataFrame:
    """norm, service_id, method, confidence, status, candidates of each distinct name.

    Exact and synonym matches are hash joins; only distinct names that miss both are compared with all texts of the
    catalogue (best_entries scores few of these pairs), or with those of the services that ``allowed`` (norm, service_id)
    gives. A score is a service's best text's; vector_hits (norm, service_id, score) override a lower one. Scores are
    rounded before the status is told; an unmatched name keeps its candidates and has no service."""
    quick = exact_or_synonym(names.select(raw).distinct(), services, raw)
    texts = catalogue_texts(services)
    open_ = quick.where((F.col("method") == "none") & (F.length("norm") >= LEAST)).select("norm").distinct()
    if allowed is not None:
        pairs = open_.join(allowed, "norm", "left").withColumnRenamed("service_id", "_only")
        free = pairs.where("_only IS NULL").select("norm")
        bound = pairs.where("_only IS NOT NULL").join(texts, F.col("_only") == F.col("service_id")).select("norm", "text", "service_id", "service_name")
    else:
        free, bound = open_, None
    given = texts.select("text", F.col("service_id").alias("owner"), F.col("service_name").alias("owner_name"))
    scored = best_entries(free, given, top).select("norm", F.col("owner").alias("service_id"), F.col("owner_name").alias("service_name"), "score")
    if bound is not None:
        scored = scored.unionByName(bound.withColumn("score", fuzzy_rounded("norm", "text")).groupBy("norm", "service_id", "service_name").agg(F.max("score").alias("score")))
    scored = scored.withColumn("method", F.lit("fuzzy"))
    if vector_hits is not None:
        # a hit on a service outside a name's list counts only if it beats the list, so its lower fuzzy score isn't needed
        open_hits = vector_hits.join(open_, "norm", "left_semi").groupBy("norm", "service_id").agg(F.max("score").alias("v"))
        if allowed is not None:
            only = allowed.select("norm", "service_id").distinct()
            open_hits = open_hits.join(free, "norm", "left_semi").unionByName(open_hits.join(only, ["norm", "service_id"], "left_semi"))
        called = texts.select("service_id", "service_name").distinct()
        both = scored.join(open_hits, ["norm", "service_id"], "full").drop("service_name").join(called, "service_id")
        better = F.col("v") > F.coalesce("score", F.lit(-1.0))
        scored = both.select("norm", "service_id", "service_name", F.when(better, F.col("v")).otherwise(F.col("score")).alias("score"), F.when(better, "embedding").otherwise("fuzzy").alias("method"))
    order = Window.partitionBy("norm").orderBy(F.col("score").desc(), "service_name", "service_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    listed = ranked.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("rank", "service_id", "score", "method"))).alias("candidates"))
    out = quick.withColumnRenamed("service_id", "_quick").join(listed, "norm", "left")
    best = F.try_element_at("candidates", F.lit(1))
    score = F.coalesce("confidence", best["score"])
    status = F.when(score >= AUTO, "matched_auto").when(score >= REVIEW, "needs_review").otherwise("unmatched")
    return out.select(
        raw, "norm", F.when(F.col("_quick").isNotNull(), F.col("_quick")).when(score >= REVIEW, best["service_id"]).alias("service_id"),
        F.when(F.col("method") != "none", F.col("method")).when(best.isNotNull(), best["method"]).otherwise("none").alias("method"), score.alias("confidence"), status.alias("status"), "candidates",
    )


def drop_headers(items: DataFrame, prices: list[str], code: str | None = None) -> DataFrame:
    """Items that are no headings; a price of 0 counts only in the last of the price columns."""
    zero = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    has_price = F.greatest(*(zero(c) for c in prices[:-1]), F.col(prices[-1]).isNotNull()) if len(prices) > 1 else F.col(prices[0]).isNotNull()
    has_code = F.coalesce(F.col(code) != "", F.lit(False)) if code else F.lit(False)
    return items.where(~is_item_header(F.col("service_name_raw"), normalise(F.col("service_name_raw")), has_price, has_code))


def promote(items: DataFrame, services: DataFrame, raw: str = "service_name_raw", section: str = "section", tie: str = "item_id") -> DataFrame:
    """norm, service_name, category, n_items, existing_id: what unmatched names and such under review would become.

    The most frequent spelling names the service and the most frequent section is its category; ties go to what comes
    first by the tie column. A service with that normalised name is reused."""
    rows = items.where(F.col("match_status").isin("unmatched", "needs_review")).withColumn("norm", normalise(F.col(raw))).where("norm <> ''")

    def modal(column: str, name: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull()).groupBy("norm", column).agg(F.count("*").alias("n"), F.min(tie).alias("first"))
        return first_of(counts, ["norm"], F.col("n").desc(), "first").select("norm", F.col(column).alias(name))

    have = services.select(normalise(F.col("service_name")).alias("norm"), "service_id").groupBy("norm").agg(F.min("service_id").alias("existing_id"))
    counts = rows.groupBy("norm").agg(F.count("*").alias("n_items"))
    return counts.join(modal(raw, "service_name"), "norm").join(modal(section, "category"), "norm", "left").join(have, "norm", "left")


def upsert_catalogue(existing: DataFrame, incoming: DataFrame, key: str = "service_name", order: str = "row") -> DataFrame:
    """The catalogue after an upload, with change (created, updated or kept): the last incoming row of a key wins and
    reactivates it, all its attributes are refreshed."""
    columns = [c for c in existing.columns if c not in (key, "is_active")]
    last = first_of(incoming, [key], F.col(order).desc())
    new = last.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns if c in incoming.columns), F.lit(True).alias("_in"))
    both = existing.join(new, F.col(key) == F.col("_key"), "full_outer")
    fresh = lambda c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) if f"_{c}" in new.columns else F.col(c)
    return both.select(
        F.coalesce(key, "_key").alias(key), *(fresh(c).alias(c) for c in columns), F.coalesce("_in", "is_active").alias("is_active"),
        F.when(F.col(key).isNull(), "created").when(F.col("_in"), "updated").otherwise("kept").alias("change"),
    )


def resolve_partners(documents: DataFrame, partners: DataFrame) -> DataFrame:
    """documents (document_id, name, bin) with partner_id, partner_confidence, by: a valid business number first (0.9), else
    the normalised name (0.6), else none (0.3); of several the smallest partner_id."""
    bins = partners.select(business_id(F.col("bin")).alias("_bin"), "partner_id").where("_bin IS NOT NULL").groupBy("_bin").agg(F.min("partner_id").alias("_by_bin"))
    names = partners.select(normalise(F.col("partner_name")).alias("_name"), "partner_id").where("_name <> ''").groupBy("_name").agg(F.min("partner_id").alias("_by_name"))
    rows = documents.withColumns({"_b": business_id(F.col("bin")), "_n": normalise(F.col("name"))})
    done = rows.join(bins, F.col("_b") == F.col("_bin"), "left").join(names, F.col("_n") == F.col("_name"), "left")
    by = F.when(F.col("_by_bin").isNotNull(), "bin").when(F.col("_by_name").isNotNull(), "name").otherwise("new")
    confidence = F.when(F.col("_b").isNotNull(), 0.9).when(F.col("_n") != "", 0.6).otherwise(0.3)
    return done.select(*documents.columns, F.coalesce("_by_bin", "_by_name").alias("partner_id"), by.alias("by"), confidence.alias("partner_confidence"))


BACKFILLED = ("city", "address", "email", "phone", "bin")


def backfill_partners(partners: DataFrame, resolved: DataFrame) -> DataFrame:
    """partners with their empty fields filled from the hints of documents that were resolved to them: of each field the
    first hint that is not empty, by document_id. What a partner has stays."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = [c for c in BACKFILLED if c in partners.columns and c in resolved.columns]
    hint = {c: business_id(F.col(c)) if c == "bin" else clean(F.col(c)) for c in fields}
    first = resolved.where("partner_id IS NOT NULL").groupBy("partner_id").agg(*(F.min_by(hint[c], F.when(hint[c].isNotNull(), F.col("document_id"))).alias(f"_{c}") for c in fields))
    filled = partners.join(first, "partner_id", "left").withColumns({c: F.coalesce(clean(F.col(c)), f"_{c}") for c in fields})
    return filled.select(partners.columns)


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score: the k most similar rows by cosine, whose score is held to [0, 1]; ties to the smaller key.

    Cosines are compared as the SQL computes them: sums in the order of components, by the root of the product of both norms. A
    zero vector has no direction, so its cosine with any is 0, as with one of another length or with a null component; one that
    isn't a number comes first, as 1. Blocks of queries meet tiles of rows, every pair of them is one group of bounded size,
    and a group gives each query's best k of its tile. Sizes fall with the tables, so that there are groups for all cores."""
    n, m = queries.count(), rows.count()
    size = min(SMALL, max(LEAST_PART, int((n * m / (GROUPS * queries.sparkSession.sparkContext.defaultParallelism)) ** 0.5)))
    blocks, tiles = (max(1, -(-count // size)) for count in (n, m))
    kind = T.ArrayType(T.FloatType() if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else T.DoubleType())
    whole = F.when(F.forall(vector, lambda x: x.isNotNull()), F.col(vector).cast(kind))
    part = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    given = lambda some: some.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), whole.alias("v"))
    # keys of both sides have one type: a long's hash isn't an int's, and groups would not meet
    asked = given(queries).select("id", "v", part(blocks).alias("block"), every(tiles).alias("tile"))
    held = given(rows).select("id", "v", every(blocks).alias("block"), part(tiles).alias("tile"))
    schema = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = asked.groupBy("block", "tile").cogroup(held.groupBy("block", "tile")).applyInArrow(lambda q, r: best_of_tile(q, r, k, key), schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    held_to = F.when(F.isnan("score"), 1.0).otherwise(F.greatest(F.lit(0.0), "score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", key, held_to.alias("score"), "rank")


def vectors_of(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The length of each vector that has a direction, 0 for others, and of each length its rows and their matrix. Vectors are
    scaled by powers of two, which changes no cosine, so that squares neither overflow nor vanish."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    starts, sizes = column.offsets.to_numpy()[:-1], np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths, found = np.where(np.asarray(column.is_null()), 0, sizes), {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        whole = flat[starts[at][:, None] + np.arange(n)].astype(np.float64)
        top = np.abs(whole).max(axis=1)
        lengths[at[top == 0]] = 0
        at, whole, top = at[top != 0], whole[top != 0], top[top != 0]
        if len(at):
            found[n] = at, np.ldexp(whole, -np.frexp(np.where(np.isfinite(top), top, 1.0))[1][:, None])
    return lengths, found


def in_order(products: np.ndarray) -> np.ndarray:
    """The sums of rows, added from the first component to the last."""
    total, columns = np.zeros(len(products)), np.ascontiguousarray(products.T)
    for column in columns:
        total += column
    return total


def first_others(ids: np.ndarray, among: np.ndarray, query, k: int) -> np.ndarray:
    """The first k of sorted places among whose id is another than the query's."""
    head = among[: k + 1]
    return (head if not (ids[head] == query).any() else among[ids[among] != query])[:k]


def near_pairs(asked: np.ndarray, held: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of asked, rows of held) among which are each query's k most similar by the exact cosine, some at a time.

    Unit vectors are multiplied in single precision. The k-th greatest of the maxima of groups of rows is no more than the k-th
    greatest product, and a product differs from the cosine by less than a bound, so no other pair can be among the best k.
    own: where the rows of a query's id begin and end."""
    groups = max(1, len(held) // GROUP) if len(held) >= GROUP * 4 * k else len(held)
    each = -(-len(held) // groups)
    tile = np.zeros((groups * each, held.shape[1]), np.float32)
    tile[: len(held)] = held
    slack = 2 * (held.shape[1] + 8) * 2.0**-24
    step = max(1, CELLS // len(tile))
    for at in range(0, len(asked), step):
        score = asked[at : at + step].astype(np.float32) @ tile.T
        score[:, len(held) :] = -np.inf
        begin, end = (x[at : at + step] for x in own)
        for d in range(int((end - begin).max(initial=0))):
            hit = np.flatnonzero(begin + d < end)
            score[hit, begin[hit] + d] = -np.inf
        parts = score.reshape(len(score), each, groups)
        most = parts.max(axis=1)
        least = np.partition(most, groups - k, axis=1)[:, groups - k] - slack if groups > k else np.full(len(score), -np.inf)
        q, g = np.nonzero((most >= least[:, None]) & (most > -np.inf))
        for some in range(0, len(q), PAIRS // each + 1):
            rows, group = q[some : some + PAIRS // each + 1], g[some : some + PAIRS // each + 1]
            near = parts[rows, :, group]
            i, j = np.nonzero((near >= least[rows][:, None]) & (near > -np.inf))
            yield rows[i] + at, j * groups + group[i]


def best_of_tile(asked: pa.Table, held: pa.Table, k: int, key: str) -> pa.Table:
    """query, key, cosine of each query's best k. Only pairs that may be among them are computed exactly."""
    order = np.argsort(held["id"].to_numpy(), kind="stable")
    held = held.take(pa.array(order))
    queries, ids = asked["id"].to_numpy(), held["id"].to_numpy()
    (lengths, some), (sizes, others) = vectors_of(asked["v"]), vectors_of(held["v"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    one_score = lambda q, places, score: found.append((np.full(len(places), q), places, np.full(len(places), score)))
    for n in np.unique(lengths).tolist() if len(ids) else []:
        apart = np.flatnonzero(sizes != n) if n else np.arange(len(ids))  # without a cosine
        for q in np.flatnonzero(lengths == n) if len(apart) else []:
            one_score(q, first_others(ids, apart, queries[q], k), 0.0)
        if not n or n not in others:
            continue
        (q, a), (r, b) = some[n], others[n]
        norms = [in_order(x * x) for x in (a, b)]
        plain = [np.isfinite(x) for x in norms]
        wild = r[~plain[1]]
        for i in range(len(q)) if len(wild) or not plain[0].all() else []:
            one_score(q[i], first_others(ids, wild if plain[0][i] else r, queries[q[i]], k), np.nan)
        q, a, r, b = q[plain[0]], a[plain[0]], r[plain[1]], b[plain[1]]
        if not len(q) or not len(r):
            continue
        norm_a, norm_b = norms[0][plain[0]], norms[1][plain[1]]
        own = tuple(np.searchsorted(ids[r], queries[q], side) for side in ("left", "right"))
        for i, j in near_pairs(a / np.sqrt(norm_a)[:, None], b / np.sqrt(norm_b)[:, None], own, k):
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                cosine = np.clip(in_order(a[x] * b[y]) / np.sqrt(norm_a[x] * norm_b[y]), -1.0, 1.0)
                found.append(best_pairs([(q[x], r[y], cosine)], k))
    place, row, score = best_pairs(found, k) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"query": asked["id"].take(pa.array(place)), key: held["id"].take(pa.array(row)), "score": pa.array(score, pa.float64())})


def best_pairs(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, row, score) each query's first k by score, no number first, then by row."""
    query, row, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, -np.where(np.isnan(score), np.inf, score), query))
    query, row, score = query[order], row[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], row[keep], score[keep]
