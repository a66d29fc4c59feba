"""Compression of vectors to codes: codebooks of their parts, learned in rounds over all rows, assigned by VA-file filtering.

A part's nearest codebook entry is found as a VA-file finds neighbours: the entries' coordinates are quantised to a few
bits each, tables made for a part give bounds of its distance to any entry from these cells, and only entries whose
bounds overlap the best one's are compared with the part itself, in whole numbers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, tidied
from .hot import with_values

LARGE = 1 << 62  # components are cut to this on both sides
MOST = (1 << 63) - 1  # stands for greater errors


@dataclass(frozen=True)
class Settings:
    """scale: of components before they become integers. parts: of a vector. entries: of each part's codebook. rounds: of
    assignment and means. bits: of an entry's coordinate. block: parts that are bounded at a time."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    bits: int = 3
    block: int = 2048


def edges(size: int, s: Settings) -> list[int]:
    """Where the parts of a vector begin and end; equal ones if size is a multiple of their number, and nearly so if not."""
    return [k * size // s.parts for k in range(s.parts + 1)]


def integers(column: pa.Array, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of vectors have size components, and floor(scale * x) of these."""
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(lengths == size)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(rows):
        return rows, np.zeros((0, size), np.int64)
    with np.errstate(over="ignore"):
        found = np.floor(s.scale * flat[starts[rows][:, None] + np.arange(size)])
    return rows, np.clip(found, -LARGE, LARGE).astype(np.int64)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label and vector (of doubles) of the rows whose vector is not null and has finite components only."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.where(F.col("vector").isNotNull() & fine)


class Cells:
    """A codebook's entries as cells: for each coordinate, s.bits bits between the least and the greatest entry."""

    def __init__(self, entries: np.ndarray, s: Settings):
        self.entries, self.cells = entries, 1 << s.bits
        self.low = entries.min(axis=0)
        self.width = (entries.max(axis=0) - self.low) // self.cells + 1
        codes = (entries - self.low) // self.width
        self.chosen = np.zeros((entries.shape[1] * self.cells, len(entries)))  # which cell of each coordinate an entry is in
        for e, code in enumerate(codes):
            self.chosen[np.arange(entries.shape[1]) * self.cells + code, e] = 1
        self.first = self.low[:, None] + self.width[:, None] * np.arange(self.cells)
        self.last = self.first + self.width[:, None] - 1

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each part to each entry, as their cells tell."""
        below, above = self.first - parts[:, :, None], parts[:, :, None] - self.last
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        add = lambda x: (x * x).reshape(len(parts), -1).astype(np.float64) @ self.chosen
        return add(near), add(far)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part its nearest entry (of equal ones the first), their squared distance, and how many entries were compared."""
        low, high = self.bounds(parts)
        row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
        apart = parts[row] - self.entries[entry]
        distance = np.full(low.shape, MOST)
        distance[row, entry] = (apart * apart).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(parts)), best], len(row)


def assigned(parts: np.ndarray, entries: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and squared distances, these as Python integers where longs or doubles could not hold a bound."""
    reach = 2 * max([int(np.abs(x).max()) for x in (parts, entries) if x.size] or [0]) + 2
    if parts.shape[1] and reach * reach * parts.shape[1] < 1 << 53:
        cells = Cells(entries, s)
        found = [cells.nearest(parts[at : at + s.block])[:2] for at in range(0, len(parts), s.block)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    apart = parts.astype(object)[:, None, :] - entries.astype(object)[None]
    distance = (apart * apart).sum(axis=2) if parts.shape[1] else np.zeros((len(parts), len(entries)), object)
    best = np.array([min(range(len(entries)), key=d.__getitem__) for d in distance], np.int64)
    return best, distance[np.arange(len(parts)), best] if len(parts) else np.zeros(0, object)


@dataclass(frozen=True)
class Codebooks:
    """size: of vectors. books: for each part, its entries as integers."""

    size: int
    books: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book.tolist() for x in entry).encode()).hexdigest()


def first_rows(kept: DataFrame, size: int, s: Settings) -> np.ndarray:
    """The vectors of the smallest vec_ids (null after all others; of one id the least vector); each task finds its own first."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in tidied(batches):
            ids = b.column("vec_id").fill_null(MOST).to_numpy()
            rows, found = integers(b.column("vector"), size, s)
            ids = ids[rows]
            limit = max(held) if len(held) == s.entries else MOST
            ranks = np.unique(ids[ids <= limit])[: s.entries]
            for i, v in zip(ids[np.isin(ids, ranks)].tolist(), found[np.isin(ids, ranks)].tolist()):
                held[i] = min(held.get(i, v), v)
            held = {i: held[i] for i in sorted(held)[: s.entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec_id", "first"])

    some = kept.select("vec_id", "vector").mapInArrow(run, "vec_id long, first array<long>")
    rows = some.groupBy("vec_id").agg(F.min("first").alias("first")).orderBy("vec_id").limit(s.entries).collect()
    return np.array([r["first"] for r in rows], np.int64).reshape(len(rows), size)


def better(kept: DataFrame, books: Codebooks, s: Settings) -> Codebooks:
    """Codebooks after one round: each entry becomes the floored mean of the parts that it is nearest to.

    A task adds up its parts, so a row for each component of each entry is all that it passes on. Sums travel in two longs."""
    cuts = edges(books.size, s)
    held = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = held.value
        counts = [[0] * len(book) for book in books.books]
        sums = [np.zeros(book.shape, object) for book in books.books]
        for b in tidied(batches):
            _, found = integers(b.column("vector"), books.size, s)
            for p, book in enumerate(books.books):
                parts = found[:, cuts[p] : cuts[p + 1]]
                best, _ = assigned(parts, book, s)
                for e in np.unique(best).tolist():
                    mine = parts[best == e]
                    exact = mine.size and int(np.abs(mine).max()) * len(mine) < 1 << 62
                    counts[p][e] += len(mine)
                    sums[p][e] += (mine if exact else mine.astype(object)).sum(axis=0).astype(object)
        rows = [(p, e, k, counts[p][e], int(x) >> 32, int(x) & 0xFFFFFFFF) for p, of in enumerate(sums) for e, sum_ in enumerate(of) for k, x in enumerate(sum_) if counts[p][e]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["part", "entry", "place", "n", "high", "low"])

    told = kept.select("vector").mapInArrow(run, "part int, entry int, place int, n long, high long, low long")
    new = [book.copy() for book in books.books]
    for r in told.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        new[r["part"]][r["entry"], r["place"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    held.unpersist()
    return Codebooks(books.size, new)


def train(rows: DataFrame, s: Settings = Settings()) -> Codebooks | None:
    """Codebooks learned from all rows of embeddings whose vectors have the commonest length (of equally common ones the
    shortest); None without any. What reaches the driver is bounded by the entries."""
    kept = vectors(rows)
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    cuts, first = edges(size, s), first_rows(kept, size, s)
    books = Codebooks(size, [first[:, a:b] for a, b in zip(cuts, cuts[1:])])
    for _ in range(s.rounds):
        books = better(kept, books, s)
    return books


def encode(rows: DataFrame, books: Codebooks, s: Settings = Settings()) -> DataFrame:
    """vec_id, label, code (binary: a byte for each part), error (sum of squared distances of the parts to their entries)."""
    held, cuts = rows.sparkSession.sparkContext.broadcast(books), edges(books.size, s)
    kept = vectors(rows)

    def run(batches):
        books = held.value
        for b in tidied(batches):
            at, found = integers(b.column("vector"), books.size, s)
            codes, errors = np.zeros((len(at), len(books.books)), np.uint8), np.zeros(len(at), object)
            for p, book in enumerate(books.books):
                best, distance = assigned(found[:, cuts[p] : cuts[p + 1]], book, s)
                codes[:, p] = best
                errors += distance.astype(object)
            code, error = [None] * b.num_rows, [None] * b.num_rows
            for k, c, e in zip(at.tolist(), codes, errors):
                code[k], error[k] = c.tobytes(), min(e, MOST)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.binary()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code binary, error long")


def decode(codes: DataFrame, books: Codebooks, s: Settings = Settings()) -> DataFrame:
    """codes with vector, the approximation that each code stands for."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(float(x) / s.scale) for x in entry)) for entry in book.tolist())) for book in books.books))
    parts = F.transform(F.sequence(F.lit(0), F.lit(s.parts - 1)), lambda p: F.get(F.get(flat, p), F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int")))
    return codes.withColumn("vector", F.flatten(parts))


def compressed(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 for every row with a vector of finite components.

    Vectors of another length than the commonest get no code and no error (null). Fewer vectors than entries give smaller
    codebooks; repeated rows weigh as often as they occur, but start one entry. Components beyond 2**62 in magnitude are
    cut there and errors beyond a long are given as the greatest long. Errors of a label that many rows have are added up
    before they are shuffled and broadcast back. Without vectors there are no rows; other columns don't matter."""
    work, books = Scratch(), train(rows, s)
    if books is None:
        return vectors(rows).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    coded = work.cut(encode(rows, books, s))
    total = F.when(F.count("error") > 0, F.coalesce(F.try_sum("error"), F.lit(MOST)))
    sums = work.cut(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")))
    out = with_values(coded, sums, "label", "n")
    return work.kept(out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def op13_sql(rounds: int = 6) -> str:
    apart = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min({{'d': {apart}, 'e': e}}) AS best FROM points JOIN e{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, best.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}
), m{k} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM s{k} GROUP BY p, e, i
), n{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM m{k} GROUP BY p, e
), e{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.y, o.y) AS y FROM e{k} o LEFT JOIN n{k} n ON n.p = o.p AND n.e = o.e)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), size AS (SELECT len(q) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), parts AS (SELECT p, p * n // 8 AS a, (p + 1) * n // 8 AS b FROM size, (SELECT unnest(range(8)) AS p)
), points AS MATERIALIZED (SELECT rid, p, q[a + 1:b] AS x FROM v, parts, size WHERE len(q) = size.n
), first AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e, q FROM (SELECT vec_id, min(q) AS q FROM v, size WHERE len(q) = size.n GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT 16)
), e0 AS MATERIALIZED (SELECT p, e, q[a + 1:b] AS y FROM first, parts
), {', '.join(steps)}
, codes AS (SELECT rid, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
), book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v LEFT JOIN codes USING (rid), book
"""


OP13_SQL = op13_sql()
