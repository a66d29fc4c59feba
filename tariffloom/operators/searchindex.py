"""Many searches at once over an index of letter runs: a search looks up few runs, and only texts that have them are scored.

Runs are of one to three letters. A text that holds a word of a query holds the word's rarest run. A name that scores SURE or
more without one is few edits away, so of the shorter one's pairs of letters most are in the longer one, and any number of
them beyond those that edits can spoil has one that is: the rarest so many do. So a query's rarest pairs are looked up among
all pairs of names, and all of its pairs among the rarest ones of shorter names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import search_base
from ..session import workspace

LEAST, MOST, SURE = 60.0, 25, 90.0
#: Of a query's pairs of letters, for each of its letters, so many are lost at most in a text that scores SURE: edits are a
#: tenth of both lengths or less, and each spoils two pairs.
LOST = 0.4
SPARSE = 0.29  # words for each letter, from which pairs of letters may all be lost


ROWS, LETTERS = 100_000, 4_000_000  # of what is broadcast at most


def small(rows: DataFrame, column: str) -> DataFrame:
    """rows, broadcast if they are few and the column's texts short together."""
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("letters")).first()
    return F.broadcast(rows) if told["n"] <= ROWS and told["letters"] <= LETTERS else rows


def runs_of(text: Column, size: int) -> Column:
    """All runs of so many letters of a text, in order."""
    count = F.length(text) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame) -> DataFrame:
    """run, text of distinct texts."""
    found = F.array_distinct(F.concat(*(runs_of(F.col("text"), n) for n in (1, 2, 3))))
    return texts.select("text", F.explode(found).alias("run"))


def few_words(text: Column) -> Column:
    return (F.length(text) >= 4) & (F.size(F.split(text, r"\s+")) < SPARSE * F.length(text))


def rarest(names: DataFrame) -> DataFrame:
    """run, text of the rarest pairs of letters of distinct names, as many as can't all be spoilt; of short names, and such
    of very short words, all letters."""
    t = F.col("text")
    each = names.select("text", F.when(few_words(t), F.ceil(F.length(t) * LOST) + 1).otherwise(F.length(t)).alias("take"), F.posexplode(F.when(few_words(t), runs_of(t, 2)).otherwise(runs_of(t, 1))).alias("at", "run"))
    often = each.groupBy("run").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("text").orderBy("often", "at"))
    return each.join(often, "run").withColumn("_k", rank).where("_k <= take").select("run", "text").distinct()


def asked_runs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, run, need (words or name) of the runs that a query looks up: the rarest, by how many texts have them. A run
    that no text has is looked up for a word, which then finds nothing."""
    q, n = F.col("q"), F.length("q")
    words = F.split(q, r"\s+")
    few = few_words(q)
    pairs = runs_of(q, 2)
    within = F.flatten(F.transform(words, lambda w: runs_of(w, 2)))
    name = F.when(few, F.array(pairs, within)).otherwise(F.array(runs_of(q, 1)))
    token = lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(runs_of(w, 3))
    groups = F.concat(
        F.transform("tokens", lambda w: F.struct(F.lit("words").alias("need"), F.lit(1).alias("take"), token(w).alias("runs"))),
        F.transform(name, lambda r: F.struct(F.lit("name").alias("need"), F.when(few, F.ceil(n * LOST) + 1).otherwise(n).cast("int").alias("take"), r.alias("runs"))),
    )
    listed = queries.select("query_id", F.posexplode(groups).alias("group", "g")).select("query_id", "group", "g.need", "g.take", F.posexplode("g.runs").alias("at", "run"))
    often = index.join(small(listed.select("run").distinct(), "run"), "run", "left_semi").groupBy("run").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("query_id", "group").orderBy(F.coalesce("often", F.lit(0)), "at"))
    return listed.join(often, "run", "left").withColumn("_k", rank).where(F.col("_k") <= F.col("take")).select("query_id", "run", "need").distinct()


def holds_word(tokens: Column, text: Column) -> Column:
    return F.exists(tokens, lambda w: F.contains(text, w))


def boost(q: Column, t: Column) -> Column:
    """130 for an equal text, 115 for one that starts with the query, 100 for one that holds it; else null."""
    return F.when(t == q, 130.0).when(F.startswith(t, q), 115.0).when(F.contains(t, q), 100.0)


@F.pandas_udf(T.DoubleType())
def base_score(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([search_base(a, b) for a, b in zip(q, t)], dtype="float64")


def alike(known: DataFrame, limit: int) -> DataFrame:
    """first, owner, said (owner_name, text, is_name): owners of equal names and texts have equal scores for every query, so the
    first of them stands for all. Of each such group the first so many owners are kept, which are all that can enter a list,
    and written as a table of its own: what reads it knows its size, which that of a repetitive file hides."""
    own = known.where("owner IS NOT NULL").groupBy("owner").agg(F.sort_array(F.collect_set(F.struct("owner_name", "text", "is_name"))).alias("said"))
    order = Window.partitionBy("said").orderBy("owner").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = own.withColumns({"_k": F.row_number().over(order), "first": F.first("owner").over(order)}).where(F.col("_k") <= limit).select("first", "owner", "said")
    at = workspace(known.sparkSession)
    kept.write.parquet(at)
    return known.sparkSession.read.schema(kept.schema).parquet(at)


def search(queries: DataFrame, texts: DataFrame, limit: int = MOST) -> DataFrame:
    """query_id, owner, owner_name, score of each query's best owners, with their rank.

    queries: query_id, query. texts: owner, owner_name, text, is_name. An owner passes if any of its texts holds a word
    (letters and digits) of the query, or its name scores SURE; its score is the best of its texts', 130, 115 or 100 for one
    that equals, begins with or holds the query, else the base score. Scores under LEAST are left out, ties go by owner_name,
    then owner. Owners of equal names and texts are searched as one. Blank and null queries find nothing, nor are blank texts found. Queries and the
    runs they look up are broadcast up to ROWS and LETTERS and joined beyond; only texts that share a looked-up run are read
    further, and each is scored once for each query."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q <> ''").withColumn("tokens", F.array_distinct(F.regexp_extract_all("q", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    groups = alike(texts.select("owner", "owner_name", F.lower("text").alias("text"), "is_name").where("text <> ''"), limit)
    known = groups.where("owner = first").select("owner", F.inline("said"))
    index = postings(known.select("text").distinct())
    wanted = asked_runs(asked, index)
    asked = small(asked, "q")
    met = index.join(small(wanted, "run"), "run").select("query_id", "text", "need").distinct().join(asked, "query_id")
    by_word = met.where((F.col("need") == "words") & holds_word(F.col("tokens"), F.col("text"))).select("query_id", "text")
    called = known.where("is_name").select("text").distinct()
    longer = met.where(F.col("need") == "name").join(called, "text", "left_semi").select("query_id", "text", "q")
    every = asked.select("query_id", F.explode(F.array_distinct(F.concat(runs_of(F.col("q"), 1), runs_of(F.col("q"), 2)))).alias("run"))
    shorter = rarest(called).join(small(every, "run"), "run").select("query_id", "text").distinct().join(asked, "query_id").where(F.length("text") < F.length("q"))
    names = longer.unionByName(shorter.select("query_id", "text", "q")).distinct()
    unsure = names.join(by_word, ["query_id", "text"], "left_anti")
    by_name = unsure.where(base_score("q", "text") >= SURE).select("query_id", "text")
    owners = by_word.join(known.select("owner", "text"), "text").select("query_id", "owner").unionByName(by_name.join(known.where("is_name").select("owner", "text"), "text").select("query_id", "owner")).distinct()
    theirs = owners.join(known, "owner")
    pairs = theirs.select("query_id", "text").distinct().join(asked, "query_id").drop("tokens").withColumn("boost", boost(F.col("q"), F.col("text")))
    sure = pairs.where("boost IS NOT NULL").select("query_id", "text", F.col("boost").alias("score"))
    rest = pairs.where("boost IS NULL").select("query_id", "text", base_score("q", "text").alias("score"))
    scored = theirs.join(sure.unionByName(rest), ["query_id", "text"]).groupBy("query_id", "owner", "owner_name").agg(F.round(F.max("score"), 2).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "owner_name", "owner")
    first = scored.where(F.col("score") >= LEAST).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    listed = first.select("query_id", F.col("owner").alias("first"), "owner_name", "score").join(groups.select("first", "owner"), "first")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "owner", "owner_name", "score", "rank")
