"""Each name's best catalogue entries by the matcher's score, without scoring most pairs.

Letter counts, lengths and shared words bound a pair's score from above. Names and texts are dealt to tiles; in a tile the
pairs of a name are scored in the order of their bounds, until none that is left can enter its list. Lists are bounded, and
only they leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy

BLOCK, SLICE = 20_000, 2_000  # texts and names of a tile
CLASSES = 64  # of letters; letters of one class count as equal, which only raises bounds
ROWS = 32  # names that are bounded at a time


def letter_counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), CLASSES), np.int32)
    for row, text in zip(out, texts):
        np.add.at(row, np.frombuffer(text.encode("utf-32-le"), "<u4") % CLASSES, 1)
    return out


class Texts:
    """A tile's texts with what their bounds need, and for each word the texts that have it."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.letters = letter_counts(texts).T.copy()
        self.length = np.array([len(t) for t in texts], np.int64)
        words = [set(t.split()) for t in texts]
        self.words = np.array([len(w) for w in words], np.int64)
        self.unique = np.array([len(" ".join(w)) for w in words], np.int64)
        where: dict[str, list[int]] = {}
        for k, own in enumerate(words):
            for w in own:
                where.setdefault(w, []).append(k)
        self.where = {w: np.array(k, np.int64) for w, k in where.items()}

    def bounds(self, names: list[str]) -> Iterator[np.ndarray]:
        """For each name an upper bound of its score, 0 to 1, with every text.

        A common subsequence is no longer than the letters that both have (c). So a ratio is at most 200 c / (sum of lengths),
        also one of sorted or of distinct words; a part of the longer string against the shorter one of n letters at most
        200 c / (n + c). Shared words of length s, with blanks, give 200 s / (s + length of either's distinct words), 100 if
        one side has no others, and 100 for parts."""
        counts = letter_counts(names)
        for at in range(0, len(names), ROWS):
            some = counts[at : at + ROWS]
            common = np.zeros((len(some), len(self.texts)), np.int32)
            for k in np.flatnonzero(some.any(axis=0)):
                common += np.minimum(some[:, k, None], self.letters[k])
            for name, c in zip(names[at : at + ROWS], common):
                yield self.bound(name, c.astype(np.float64))

    def bound(self, name: str, c: np.ndarray) -> np.ndarray:
        own = set(name.split())
        unique, size = len(" ".join(own)), len(name)
        shared, length = np.zeros(len(c), np.int64), np.full(len(c), -1, np.int64)
        for w in own:
            at = self.where.get(w)
            if at is not None:
                shared[at] += 1
                length[at] += len(w) + 1
        some, s = shared > 0, np.maximum(length, 0)
        best = 200 * c / np.maximum(np.minimum(size + self.length, unique + self.unique), 1)
        best = np.maximum(best, np.where(some, 200 * s / np.maximum(np.minimum(unique, self.unique) + s, 1), 0))
        best[some & ((shared == len(own)) | (shared == self.words))] = 100
        short = np.minimum(np.minimum(size, self.length), np.minimum(unique, self.unique))
        part = np.where(some, np.maximum(200 * c / np.maximum(short + c, 1), 95), 200 * c / np.maximum(short + c, 1))
        ratio = np.maximum(size, self.length) / np.maximum(np.minimum(size, self.length), 1)
        part *= np.where(ratio < 1.5, 0, np.where(ratio <= 8, 0.9, 0.6))
        return np.minimum(np.maximum(best, part), 100) / 100


def best_of(names: list[str], texts: Texts, owners: list[list[tuple]], top: int) -> Iterator[tuple[str, list[tuple], int]]:
    """(name, [(score, owner's name, owner)] best first, pairs scored). owners: of each text (name, owner), the first by name."""
    for name, bound in zip(names, texts.bounds(names)):
        found: dict[object, tuple] = {}
        least, scored = -1.0, 0
        limits = np.round(bound + 1e-9, 4)
        for k in np.argsort(-limits, kind="stable").tolist():
            if limits[k] < least:
                break
            score = 0.0
            if bound[k] > 0:
                score = round(fuzzy(name, texts.texts[k]), 4)
                scored += 1
            if score < least:
                continue
            for called, owner in owners[k]:
                if owner not in found or -score < found[owner][0]:
                    found[owner] = (-score, called, owner)
            if len(found) > top:
                found = {x[2]: x for x in sorted(found.values())[:top]}
            if len(found) == top:
                least = -max(x[0] for x in found.values())
        yield name, [(-score, called, owner) for score, called, owner in sorted(found.values())], scored


def best_entries(names: DataFrame, texts: DataFrame, top: int, name: str = "norm", block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """name, owner, owner_name, score (rounded to four places) of each distinct name's `top` best owners.

    texts: text, owner, owner_name. An owner's score is its best text's; ties go by owner_name, then owner. Nothing is left
    out: a pair that is not scored cannot be in the list. Of one text, only its first `top` owners can be in a list. Names are
    sent to every block of texts and texts to every slice of names, so work is dealt evenly and a tile's memory is bounded;
    lists of a name's tiles are merged. Null names and texts take no part; no texts give no rows."""
    names = names.where(F.col(name).isNotNull()).select(name).distinct()
    order = Window.partitionBy("text").orderBy("owner_name", "owner")
    owned = texts.where("text IS NOT NULL").select("text", "owner_name", "owner").distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top)
    held = owned.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("owner_name", "owner"))).alias("owners"))
    blocks, slices = max(1, -(-held.count() // block)), max(1, -(-names.count() // slice_))
    tile = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = names.select(name, every(blocks).alias("block"), tile(name, slices).alias("slice"))
    given = held.select("text", "owners", tile("text", blocks).alias("block"), every(slices).alias("slice"))
    kind = texts.schema["owner"].dataType.simpleString()

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and others.num_rows:
            owners = [[(o["owner_name"], o["owner"]) for o in x] for x in others["owners"].to_pylist()]
            for asked, found, _ in best_of(some[name].to_pylist(), Texts(others["text"].to_pylist()), owners, top):
                out += [(asked, owner, called, score) for score, called, owner in found]
        types = (pa.string(), others.schema.field("owners").type.value_type.field("owner").type, pa.string(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names=[name, "owner", "owner_name", "score"])

    lists = asked.groupBy("block", "slice").cogroup(given.groupBy("block", "slice")).applyInArrow(lambda a, b: run(a, b), f"{name} string, owner {kind}, owner_name string, score double")
    if blocks > 1:
        lists = lists.groupBy(name, "owner", "owner_name").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.col("score").desc(), "owner_name", "owner"))
    return lists.withColumn("_k", rank).where(F.col("_k") <= top).drop("_k") if blocks > 1 else lists


def rematched(kept: DataFrame, names: DataFrame, old: DataFrame, new: DataFrame, top: int, name: str = "norm") -> DataFrame:
    """best_entries(names, new) from kept, the lists that names had with the texts of old, where catalogues differ little.

    Names that have a list keep it and are compared with the texts that came in only. Names without one, and such whose list
    holds an owner that lost a text or its name, are compared with all texts. Lists of names that are no longer asked go.
    kept: name, owner, owner_name, score, as best_entries() gives them."""
    columns = ["text", "owner", "owner_name"]
    old, new = (t.select(columns).where("text IS NOT NULL").distinct() for t in (old, new))
    added, lost = new.join(old, columns, "left_anti"), old.join(new, columns, "left_anti").select("owner").distinct()
    names = names.where(F.col(name).isNotNull()).select(name).distinct()
    spoilt = kept.join(lost, "owner", "left_semi").select(name).distinct()
    steady = names.join(kept.select(name).distinct(), name, "left_semi").join(spoilt, name, "left_anti")
    whole = best_entries(names.join(steady, name, "left_anti"), new, top, name)
    both = kept.join(steady, name, "left_semi").select(name, "owner", "owner_name", "score").unionByName(best_entries(steady, added, top, name))
    best = both.groupBy(name, "owner", "owner_name").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(F.col("score").desc(), "owner_name", "owner"))
    return whole.unionByName(best.withColumn("_k", rank).where(F.col("_k") <= top).drop("_k"))
