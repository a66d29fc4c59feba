"""Near-duplicate documents by min-max hashing with banding; links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, mix, seeded, shingle_sets, tidied
from .graph import components


@dataclass(frozen=True)
class Settings:
    """words: of a shingle. percent: the least similarity of a link, in hundredths.

    bands * rows / 2 permutations give a minimum and a maximum each; half of the bands are made of minima, half of
    maxima. At similarity 0.8 a pair shares no band with a probability of (1 - 0.8**5)**30, 7 in a million.
    ahead: bands of the first round. In buckets that stay open, about one node is a pivot, then first ones; in that round
    all nodes of buckets of at most small ones are pivots, and from there on growth is their increase. share: pairs of one
    pivot that one copy of its set serves. filter_rows: ids of wanted texts that are broadcast at most.
    bits: of the bitmap of a set, by which pairs are ruled out before their sets are read; a multiple of 64.
    """

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    ahead: int = 3
    first: int = 4
    growth: int = 4_096
    small: int = 24
    share: int = 4_096
    filter_rows: int = 1_000_000
    bits: int = 2048
    seed: int = 11


def digest(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation h -> a * h + b modulo 2**32."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(len(a), dtype=np.uint32)
    for at in range(0, len(h), 4096):
        x = a[:, None] * h[None, at : at + 4096] + b[:, None]
        low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return np.concatenate([low, high])


def bitmap(found: np.ndarray, bits: int) -> list[int]:
    """Which of so many classes of hashes the set has members of, in longs."""
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(found % np.uint64(bits)).astype(np.intp)] = 1
    return np.packbits(marks).view(np.int64).tolist()


def may_link(s: Settings):
    """Whether a pair's sizes and bitmaps leave its similarity possible.

    Each class that only one set has members of holds a word run that only this one has, so the symmetric difference has
    at least as many members as the bitmaps have different bits. No pair that reaches the similarity is ruled out.
    """
    near = 100 * F.least("n", "p_n") >= s.percent * F.greatest("n", "p_n")
    apart = sum((F.bit_count(F.col("map")[i].bitwiseXOR(F.col("p_map")[i])) for i in range(s.bits // 64)), F.lit(0))
    return near & ((100 + s.percent) * apart <= (100 - s.percent) * (F.col("n") + F.col("p_n")))


def stamped(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), "text")


def profiles(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, stamp (64-bit hash of the text, which tells rows of one doc_id apart), n (size of the shingle set), digest
    (of the set, null if empty), map (its bitmap), bands (a key for each band)."""
    half = s.bands // 2 * s.rows
    a = (seeded(s.seed, half) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (seeded(s.seed + 1, half) >> np.uint64(32)).astype(np.uint32)
    salt = seeded(s.seed + 2, s.bands)
    fold = seeded(s.seed + 3, s.rows) | np.uint64(1)

    def run(batches):
        for batch in tidied(batches):
            n, sets, maps, keys = [], [], [], []
            for _, found in shingle_sets(batch.column("text"), s.words):
                n.append(len(found))
                maps.append(bitmap(found, s.bits))
                if len(found):
                    sign = signature(found, a, b).astype(np.uint64).reshape(s.bands, s.rows)
                    keys.append(mix((mix(sign + salt[:, None]) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64))
                    sets.append(digest(found))
                else:
                    keys.append(np.zeros(0, np.int64))
                    sets.append(None)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            columns = [batch.column("doc_id"), batch.column("stamp"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(maps, pa.list_(pa.int64())), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "stamp", "n", "digest", "map", "bands"])

    return stamped(docs).mapInArrow(run, "doc_id long, stamp long, n long, digest binary, map array<long>, bands array<long>")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """A row with a number (node) for each set: its digest, n, map and bands, and the row that stands for it: none, doc_id,
    stamp and the times that this one occurs. That is the one of the smallest doc_id, or of a null one if there is no other."""
    full = rows.where(F.col("digest").isNotNull())
    times = full.groupBy("digest", "doc_id", "stamp").agg(F.count("*").alias("times"))
    chosen = times.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stamp", "times")).alias("r"))
    some = full.select("digest", "n", "map", "bands").dropDuplicates(["digest"])
    return some.join(chosen, "digest").select(F.monotonically_increasing_id().alias("node"), "digest", "n", "map", "bands", "r.*")


def full_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, s: Settings, work: Scratch) -> DataFrame:
    """node and set (binary, sorted 64-bit hashes) of the wanted nodes, from the text that stands for each."""
    chosen = work.cut(nodes.select("node", "digest", F.col("doc_id").alias("w_id"), F.col("stamp").alias("w_stamp"), "times").join(wanted, "node"))
    small = chosen.count() <= s.filter_rows

    def met(some: DataFrame) -> DataFrame:
        some = F.broadcast(some) if small else some
        return stamped(docs).join(some, (F.col("stamp") == F.col("w_stamp")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "node", "digest")

    texts, again = met(chosen.where("times = 1")), chosen.where("times > 1")
    if not again.isEmpty():
        texts = texts.unionByName(met(again).dropDuplicates(["node", "text"]))

    def run(batches):
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [found for _, found in shingle_sets(some.column("text"), s.words)]
                kept = pa.array([digest(x) == d for x, d in zip(sets, some.column("digest").to_pylist())], pa.bool_())  # another text may have that stamp
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["node", "set"]).filter(kept)

    return work.cut(texts.mapInArrow(run, "node long, set binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    A node may be end a of very many pairs (the pivot of a large group), so its pairs are dealt over copies of its set,
    one for about s.share pairs, and no task gets them all."""

    def run(batches):
        for batch in tidied(batches):
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.share).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    left = sets.join(copies.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.col("set").alias("left"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    met = dealt.join(left, ["a", "copy"]).join(right, "b")
    return met.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def joined(labels: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """labels (node, label) after more links: only the labels that these connect are looked at again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    again = work.cut(components(ends, work)).withColumnRenamed("label", "l_new")
    old = labels.join(again.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("l_new", "label").alias("label"))
    return work.cut(old.unionByName(again.select("node", F.col("l_new").alias("label"))).distinct())


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """judged() without stamps: doc_id, n_shingles, component_id, kept."""
    return judged(docs, s).drop("stamp")


def judged(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each of docs: doc_id, stamp, n_shingles, component_id (the smallest doc_id reachable by links), kept.

    Texts with equal sets are one node, so exact copies cost nothing further. Nodes that share a band's key form a
    bucket. Its nodes are compared with its first node by number, which near copies agree on in most buckets: at first
    in s.ahead bands, then in all of them where labels still differ. Sizes and bitmaps rule out pairs first, then full
    sets decide. In the buckets that still hold several labels, a growing share of the nodes
    are pivots for all others, until every bucket is connected or all its pairs are compared. So no link is lost, and a
    bucket of thousands of near copies costs a few comparisons for each instead of all pairs.
    Null texts, empty ones and such of white space have no shingles, are linked with nothing and are kept. Rows that
    repeat a doc_id each get a row; equal texts get one component. Of each component one text (doc_id and stamp) is
    kept: of the smallest doc_id, or of a null one if there is no other, that with the smallest stamp; rows that repeat
    it are kept as well. An empty table gives no rows, and columns other than doc_id and text don't matter.
    """
    work = Scratch()
    rows = work.cut(profiles(docs, s))
    nodes = work.cut(distinct_sets(rows))
    labels = None

    def entries(bands: int) -> DataFrame:
        """node, n, label and key of the first so many bands."""
        some = nodes.select("node", "n", F.slice("bands", 1, bands).alias("bands"))
        some = some.withColumn("label", F.col("node")) if labels is None else some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return some.select("node", "n", "label", F.explode("bands").alias("key"))

    def with_pivots(some: DataFrame, pivots: DataFrame, after, sets: DataFrame | None = None) -> None:
        """Compares the nodes of buckets with their pivots (p_key, p_node, p_n, p_label and, if it is at hand, p_map), and
        brings labels up to date. Full sets are read from docs unless given."""
        nonlocal labels
        near = may_link(s) if "map" in some.columns else 100 * F.least("n", "p_n") >= s.percent * F.greatest("n", "p_n")
        met = some.join(pivots, (F.col("key") == F.col("p_key")) & (F.col("label") != F.col("p_label")) & near & after)
        pairs = met.select(F.col("p_node").alias("a"), F.col("node").alias("b")).distinct()
        if "map" not in some.columns:
            end = lambda c, mark: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{mark}n"), F.col("map").alias(f"{mark}map"))
            pairs = pairs.join(end("b", ""), "b").join(end("a", "p_"), "a").where(may_link(s)).select("a", "b")
        pairs = work.cut(pairs)
        if sets is None:
            wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
            sets = full_sets(docs, wanted, nodes, s, work)
        found = work.cut(confirmed(pairs, sets, s))
        labels = work.cut(components(found, work)) if labels is None else joined(labels, found, work)

    for bands in (s.ahead, s.bands):
        some = entries(bands)
        ends = some.groupBy("key").agg(F.min(F.struct("node", "n", "label")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        lead = ends.select(F.col("key").alias("p_key"), F.col("lead.node").alias("p_node"), F.col("lead.n").alias("p_n"), F.col("lead.label").alias("p_label"))
        with_pivots(some, lead, F.col("node") > F.col("p_node"))
    open_ = lambda some: some.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high AND size > 2").select("key", "size")
    some = entries(s.bands)
    spread = F.xxhash64("node")  # its place between the least and the greatest long picks a share of any bucket
    nth = (spread.cast("double") + float(1 << 63)) / float(1 << 64) * F.col("size")
    left = some.drop("label").join(open_(some), "key").join(nodes.select("node", "map"), "node")
    left = work.cut(left.withColumns({"spread": spread, "nth": nth}))
    sets = full_sets(docs, left.select("node").distinct(), nodes, s, work)
    before, now = 0.0, 1.0
    while True:
        some = left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        undone = open_(some).where(F.lit(now <= s.first) | (F.col("size") > F.greatest(F.lit(before), F.lit(s.small)))).select("key")
        share = (F.col("nth") < now) & (F.col("nth") >= before)
        fits = share if now < s.first else F.when(F.col("size") <= s.small, F.lit(now == s.first)).otherwise(share)
        pivots = work.cut(some.where(fits).join(undone, "key").select(*(F.col(c).alias(f"p_{c}") for c in ("key", "node", "n", "map", "label", "spread"))))
        if not pivots.isEmpty():
            with_pivots(some, pivots, F.struct("spread", "node") > F.struct("p_spread", "p_node"), sets)
        elif undone.isEmpty():
            break
        before, now = now, s.first if now < s.first else now * s.growth
    first = F.struct("none", "doc_id", "stamp")
    whole = nodes.select("node", "digest", first.alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("least").alias("first"))
    of_set = whole.join(least, "label").select("digest", F.col("first.doc_id").alias("component"), F.col("first.stamp").alias("first"))
    out = rows.select("doc_id", "stamp", "n", "digest").join(of_set, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    kept = F.col("digest").isNull() | F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("stamp") == F.col("first"))
    return work.kept(out.select("doc_id", "stamp", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept")))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without those that are linked, directly or not, to one that judged() keeps, and without repeated rows.

    Rows are told by doc_id and stamp, so other texts of the same or of no doc_id stay. What goes is broadcast up to
    s.filter_rows and joined beyond; so is what rows repeat. All columns of docs are returned, whatever their names."""
    told = judged(docs, s)
    names = {"doc_id": "w_id", "stamp": "w_stamp"}
    gone = cut(told.where(~F.col("kept")).select("doc_id", "stamp").distinct().withColumnsRenamed(names))
    twice = cut(told.where("kept").groupBy("doc_id", "stamp").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "stamp").withColumnsRenamed(names))
    hint = lambda rows: F.broadcast(rows) if rows.count() <= s.filter_rows else rows
    same = lambda rows: docs["doc_id"].eqNullSafe(rows["w_id"]) & (F.xxhash64(docs["text"]) == rows["w_stamp"])
    gone, again = hint(gone), not twice.isEmpty()
    kept = docs.join(gone, same(gone), "left_anti")
    if not again:
        return kept
    twice = hint(twice)
    return kept.join(twice, same(twice), "left_anti").unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))
