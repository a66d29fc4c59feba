"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORDS, hashed, mix, seeded, tidied

#: Bytes that separate words here: ASCII other than letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
KINDS = seeded(4, 3)
COUNTED = 1 << 22  # classes of features that are counted ahead


@dataclass(frozen=True)
class Settings:
    """The sample's bound and the learner's constants.

    per_class: labelled rows of each class that the fit takes at most. sample_bytes: of text that these have together in
    each class, but for the last one taken. Rows come in the order of a hash of doc_id, whatever their length, and are
    taken whole. least_docs: a feature needs to be in so many texts of the sample to get a coordinate.
    """

    per_class: int = 6_000
    sample_bytes: int = 20 << 20
    least_docs: int = 3
    epochs: int = 12
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    threshold: float = 0.3


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its words, word pairs and pairs around one word) for each row."""
    for words in hashed(column, fold=True, between=BETWEEN):
        h = words.hash
        single = mix(h ^ KINDS[0])
        pairs = mix(words.grams(2) ^ KINDS[1]) if len(h) > 1 else h[:0]
        skips = mix(WORDS.up[1] * h[:-2] + h[2:] ^ KINDS[2]) if len(h) > 2 else h[:0]
        for k in range(words.last - words.first):
            a, b = words.rows[k], words.rows[k + 1]
            yield words.first + k, np.unique(np.concatenate([single[a:b], pairs[a : max(a, b - 1)], skips[a : max(a, b - 2)]]))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes with their non-zero weights, and the bias. Coordinates learn at rates of their own, L1 keeps most at 0."""
    seen = np.zeros(COUNTED, np.int32)  # at least as often as each feature itself; rare ones go before any is sorted
    for r in rows:
        np.add.at(seen, (r % np.uint64(COUNTED)).astype(np.intp), 1)
    often = [r[seen[(r % np.uint64(COUNTED)).astype(np.intp)] >= s.least_docs] for r in rows]
    names, seen = np.unique(np.concatenate([*often, np.zeros(0, np.uint64)]), return_counts=True)
    names = names[seen >= s.least_docs]
    at = []
    for r in often:
        k = np.searchsorted(names, r)
        k[k == len(names)] = 0
        at.append(k[names[k] == r] if len(names) else k[:0])
    z, n, w = (np.zeros(len(names)) for _ in range(3))
    zb = nb = bias = 0.0
    order = np.argsort(mix(np.arange(len(rows), dtype=np.uint64)))
    for _ in range(s.epochs):
        for i in order:
            k = at[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[k].sum(), -30, 30)))
            g = p - labels[i]
            grown = n[k] + g * g
            z[k] += g - (np.sqrt(grown) - np.sqrt(n[k])) / s.alpha * w[k]
            n[k] = grown
            zk = z[k]
            w[k] = np.where(np.abs(zk) <= s.l1, 0.0, (np.sign(zk) * s.l1 - zk) / ((s.beta + np.sqrt(grown)) / s.alpha + s.l2))
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / s.alpha * bias
            nb += g * g
            bias = -zb / ((s.beta + np.sqrt(nb)) / s.alpha)
    kept = np.flatnonzero(w)
    return names[kept], w[kept], float(bias)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from a bounded sample of labelled rows that are not held out; a document's label is its highest one.

    The sample's first choice is by a share of the hash of doc_id, so what is ordered afterwards, without texts, is
    bounded too. Rows of docs that repeat each other count once, different texts of one doc_id are rows of their own.
    With no labels of a class, the model has no weights and its bias is the smoothed share of toxic labels.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = np.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0), float(prior)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, s.per_class / toxic))).otherwise(F.lit(min(1.0, s.per_class / clean)))
    draw = (F.xxhash64("doc_id", F.lit("sample")).cast("double") / float(1 << 64)) + 0.5
    place = Window.partitionBy("toxic").orderBy("draw", "doc_id")
    chosen = known.withColumn("draw", draw).where(F.col("draw") <= share).withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= s.per_class)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("stamp")).where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id", "toxic", "draw")), "doc_id")
    listed = texts.groupBy("toxic", "draw", "doc_id", "stamp").agg(F.max(F.octet_length("text")).alias("size"))
    place = Window.partitionBy("toxic").orderBy("draw", "doc_id", "stamp")
    taken = listed.withColumn("before", F.sum("size").over(place) - F.col("size")).withColumn("nth", F.row_number().over(place))
    taken = taken.where((F.col("nth") <= s.per_class) & (F.col("before") <= s.sample_bytes)).select("doc_id", "stamp")
    sample = texts.join(F.broadcast(taken), ["doc_id", "stamp"]).select("doc_id", "stamp", "text", "toxic").dropDuplicates(["doc_id", "stamp"])

    def learn(batches):
        found = [(i, t, y, f) for b in batches for i, t, y, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "stamp", "toxic")), (f for _, f in features(b.column("text"))))]
        found.sort(key=lambda x: x[:2])
        y = np.array([x[2] for x in found], dtype=float)
        names, weights, bias = ftrl([x[3] for x in found], y, s)
        drawn = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        yield pa.RecordBatch.from_pydict({"feature": np.append(names, np.uint64(0)).view(np.int64), "weight": np.append(weights, bias + prior - drawn), "bias": np.append(np.zeros(len(names), bool), True)})

    model = sample.coalesce(1).mapInArrow(learn, "feature long, weight double, bias boolean").toArrow().to_pydict()
    bias = [w for w, b in zip(model["weight"], model["bias"]) if b]
    rows = [(f, w) for f, w, b in zip(model["feature"], model["weight"], model["bias"]) if not b]
    names = np.array([f for f, _ in rows], dtype=np.int64).view(np.uint64)
    return names, np.array([w for _, w in rows]), float(bias[0] if bias else prior)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], columns: list[str] | None = None, s: Settings = Settings()) -> DataFrame:
    """The chosen columns of every row with score and predicted, which replace columns of these names; null and empty texts
    score what the bias says."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*(F.col(f"`{c}`") for c in columns or docs.columns if c not in ("score", "predicted")))
    ahead = kept if "text" in kept.columns else docs.select(*(F.col(f"`{c}`") for c in kept.columns), "text")
    place = ahead.columns.index("text")
    names_out = [*kept.columns, "score", "predicted"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["score double", "predicted int"])

    def run(batches):
        names, weights, bias = held.value
        for b in tidied(batches):
            total = np.full(b.num_rows, bias)
            for row, found in features(b.column(place)):
                at = np.searchsorted(names, found)
                at[at == len(names)] = 0
                if len(names):
                    total[row] += weights[at[names[at] == found]].sum()
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names_out) - 2], pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], names=names_out)

    return ahead.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, that a model fitted on docs and labels doesn't predict to be toxic."""
    own = {c: f"_own_{n}" for n, c in enumerate(docs.columns) if c in ("score", "predicted")}
    scored = score(docs.withColumnsRenamed(own), fit(docs, labels, s), s=s).where("predicted = 0")
    return scored.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
