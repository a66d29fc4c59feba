"""Language of whole texts by error-correcting output codes over hashed byte n-grams.

Each learned language has a codeword of bits. A binary classifier for each bit tells, from the n-grams of a text, on
which side of the bit its language stands; the language whose codeword loses least against all of these answers, each
weighted by how well its classifier does, is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, seeded, table, tidied

UNKNOWN = "und"
GRAMS = seeded(21, 3)


@dataclass(frozen=True)
class Settings:
    """The sample's bound, the code and the learner's constants.

    languages: the most frequent ones that get a codeword. sample_rows: labelled texts that the fit takes at most, the same
    number for each language. sample_bytes: of text that these have together, but for the last one of each language; texts
    come in the order of a hash of doc_id and the text and are taken whole. exhaustive: up to so many languages get every possible bit, more get
    random_bits. features: classes that n-grams of 1 to 3 bytes are hashed to; a power of two. chunk: bytes of text
    whose counts are held at a time. ambiguous: a lead of the best codeword over the second under this is flagged.
    """

    languages: int = 256
    sample_rows: int = 6_000
    sample_bytes: int = 16 << 20
    exhaustive: int = 5
    random_bits: int = 63
    features: int = 1 << 13
    chunk: int = 1 << 20
    epochs: int = 12
    rate: float = 0.5
    decay: float = 1e-5
    ambiguous: float = 0.2
    seed: int = 20


@dataclass(frozen=True)
class Model:
    """names: of languages. code: their codewords, of -1 and 1. weights, bias: of the classifier of each bit. trust: the
    weight of each bit's loss; these sum to 1."""

    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(n: int, s: Settings) -> np.ndarray:
    """A codeword for each of n languages: rows of -1 and 1 in which no bit is constant or equal to another or to its opposite.

    Of up to s.exhaustive languages all such bits are taken, so any two codewords differ in half of them or more. Beyond
    that, bits are drawn, each with half of the languages on either side."""
    if n < 2:
        return np.ones((n, 1))
    if n <= s.exhaustive:
        return np.array([[1 if k == 0 or m >> (k - 1) & 1 else -1 for m in range((1 << (n - 1)) - 1)] for k in range(n)], dtype=float)
    seen, bits, draw = set(), [], 0
    while len(bits) < s.random_bits and draw < 50 * s.random_bits:
        order = np.argsort(mix(np.arange(n, dtype=np.uint64) + seeded(s.seed + draw, 1)[0]), kind="stable")
        draw += 1
        bit = np.where(np.argsort(order) < n // 2, -1.0, 1.0)
        bit *= bit[0]
        if bit.tobytes() not in seen:
            seen.add(bit.tobytes())
            bits.append(bit)
    return np.stack(bits, axis=1)


def gram_counts(column: pa.Array, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of chunks of whole rows: for each row the square roots of how often the classes of its n-grams
    occur, scaled to unit length. A text longer than a chunk is counted piece by piece; n-grams don't reach over rows."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, most = 0, max(1, (32 << 20) // (8 * s.features))
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + s.chunk, side="right")) - 1)
        last = min(last, len(column), first + most)
        counts = np.zeros((last - first) * s.features)
        for at in range(int(offsets[first]), int(offsets[last]), s.chunk):
            end = min(at + s.chunk, int(offsets[last]))
            reach = data[at : min(end + len(GRAMS) - 1, int(offsets[last]))].astype(np.uint64)
            rows = np.searchsorted(offsets[first : last + 1], np.arange(at, at + len(reach)), side="right") - 1
            h = np.zeros(len(reach), np.uint64)
            for n, salt in enumerate(GRAMS):
                count = min(end - at, len(reach) - n)
                if count <= 0:
                    break
                h = (h[:count] << np.uint64(8)) | reach[n : n + count]
                inside = rows[:count] == rows[n : n + count]
                cell = (mix(h ^ salt) & np.uint64(s.features - 1)).astype(np.int64) + rows[:count] * s.features
                counts += np.bincount(cell[inside], minlength=len(counts))
        found = np.sqrt(counts, out=counts).reshape(last - first, s.features)
        found /= np.maximum(np.sqrt((found * found).sum(axis=1, keepdims=True)), 1e-12)
        yield first, found
        first = last


def learn(x: np.ndarray, y: np.ndarray, code: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and bias of a logistic classifier for each bit, by AdaGrad over small batches, and each bit's trust: the
    log-odds of its being right on the sample, with classes of equal weight."""
    side = code[y]
    share = np.bincount(y, minlength=len(code))[y]
    importance = len(y) / (len(np.unique(y)) * share)
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for epoch in range(s.epochs):
        order = np.argsort(mix(np.arange(len(y), dtype=np.uint64) + seeded(s.seed + 7 + epoch, 1)[0]), kind="stable")
        for at in range(0, len(order), 64):
            k = order[at : at + 64]
            m = side[k] * (x[k] @ w + b)
            g = -side[k] / (1 + np.exp(np.clip(m, -30, 30))) * importance[k, None] / len(k)
            step = x[k].T @ g + s.decay * w
            gw += step * step
            w -= s.rate * step / np.sqrt(gw)
            step = g.sum(axis=0)
            gb += step * step
            b -= s.rate * step / np.sqrt(gb)
    wrong = (importance[:, None] * (side * (x @ w + b) <= 0)).sum(axis=0) / importance.sum()
    trust = np.maximum(np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 1e-3)
    return w, b, trust / trust.sum()


def decoded(answers: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of classifiers' answers (log-odds): the place of the codeword of the least weighted loss (the first of equal
    ones), its probability among all, and its lead over the second (1 if there is no second)."""
    loss = np.stack([np.logaddexp(0, -answers * c) @ model.trust for c in model.code], axis=1)
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * model.code.shape[1])
    odds /= odds.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = odds[np.arange(len(best)), best]
    second = np.sort(odds, axis=1)[:, -2] if odds.shape[1] > 1 else np.zeros(len(best))
    return best, top, top - second


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def readable(text="text"):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """The model from a bounded sample of the labelled texts that are not held out.

    Of the s.languages most frequent values of lang, texts with a letter are drawn by a hash of doc_id and the text, for each
    an equal share of s.sample_rows and about one of s.sample_bytes at most. Which rows are drawn is settled without texts, on rows that a
    share of the hash has bounded. Rows that repeat each other count once; without labelled rows the model is empty."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & readable())
    often = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.languages).collect()
    names = sorted(r["lang"] for r in often)
    code = codewords(len(names), s)
    if not names:
        return Model([], code, np.zeros((s.features, 1)), np.zeros(1), np.ones(1))
    rows, size = max(1, s.sample_rows // len(names)), s.sample_bytes // len(names)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * rows / r["n"])) for r in often], "lang string, share double")
    draw = F.xxhash64("doc_id", "text", F.lit("sample")).cast("double") / float(1 << 64) + 0.5
    drawn = known.withColumn("draw", draw).join(F.broadcast(shares), "lang").where(F.col("draw") <= F.col("share"))
    listed = drawn.groupBy("lang", "draw", "doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    place = Window.partitionBy("lang").orderBy("draw", "doc_id")
    taken = listed.withColumn("before", F.sum("size").over(place) - F.col("size")).withColumn("nth", F.row_number().over(place))
    taken = taken.where((F.col("nth") <= rows) & (F.col("before") <= size)).select("lang", "draw", "doc_id")
    sample = drawn.join(F.broadcast(taken), ["lang", "draw", "doc_id"]).select("lang", "draw", "doc_id", F.lower("text").alias("text"))
    sample = sample.dropDuplicates(["lang", "draw", "doc_id"])

    def run(batches):
        keys, rows = [], []
        for b in tidied(batches):
            keys += zip(*(b.column(c).to_pylist() for c in ("lang", "draw", "doc_id")))
            rows += [found.astype(np.float32) for _, found in gram_counts(b.column("text"), s)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        x = np.concatenate(rows)[order] if rows else np.zeros((0, s.features), np.float32)
        w, b, trust = learn(x, np.array([names.index(keys[k][0]) for k in order]), code, s)
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "bias": [b.tobytes()], "trust": [trust.tobytes()]})

    told = sample.coalesce(1).mapInArrow(run, "weights binary, bias binary, trust binary").first()
    bits = code.shape[1]
    return Model(names, code, np.frombuffer(told["weights"]).reshape(s.features, bits), np.frombuffer(told["bias"]), np.frombuffer(told["trust"]))


def identify(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score (probability of its codeword among all), ambiguous (its lead over the second is under
    s.ambiguous) for every row of docs, of whole texts.

    Null texts and such without a letter are `und`, with a score of 0, and ambiguous; so is every text if nothing was
    learned. Rows are judged one by one, so repeated ones are judged alike; an empty table gives no rows. A text costs
    time in proportion to its length; memory is bounded by the Arrow batch that holds it and s.chunk."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    ahead = docs.select("doc_id", F.when(readable(), F.lower("text")).alias("text"))

    def run(batches):
        model = held.value
        for b in tidied(batches):
            names, score, unsure = [], [], []
            none = b.column("text").is_null().to_numpy(zero_copy_only=False)
            for first, x in gram_counts(b.column("text"), s):
                if model.names:
                    best, top, lead = decoded(x @ model.weights + model.bias, model)
                    names += [model.names[k] for k in best]
                    score.append(np.clip(top, 0, 1))
                    unsure.append(lead < s.ambiguous)
                else:
                    names += [UNKNOWN] * len(x)
                    score.append(np.zeros(len(x)))
                    unsure.append(np.ones(len(x), bool))
            names = [UNKNOWN if n else x for x, n in zip(names, none.tolist())]
            score = np.where(none, 0.0, np.concatenate([*score, np.zeros(0)]))
            unsure = none | np.concatenate([*unsure, np.zeros(0, bool)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return ahead.mapInArrow(run, f"doc_id {ahead.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
