"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

QUERY_BLOCK = 16_384  # queries broadcast at a time: at most 8 MB at 64 components
TILE = 4_096  # candidate rows of one matrix product
FAN_IN = 64  # lists merged in the first level of the tree
OUT = "query_id long, vec_id long, score long, part int"


def valid_vector(vector: Column) -> Column:
    """Not null, not empty, and every component present and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def quantised(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(256 * x)) for each length of vector, as doubles, which hold them exactly."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, np.floor(256.0 * flat[starts[rows][:, None] + np.arange(size)])))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; by BLAS while sums stay below 2**53, else by integers, held to the range of a long."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], dtype=object) @ np.array([[int(x) for x in r] for r in b], dtype=object).T
    return np.clip(exact, -(2**63) + 2, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest (score, then smaller id); rows may be padded by id -1 at the end of the order."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def selected(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial selection in one tile: all that tie with the k-th score are looked at, k are kept."""
    if scores.shape[1] <= 4 * k:
        return best(scores, np.broadcast_to(ids, scores.shape), k)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = nth < k
    shape = (scores.shape[0], k)
    return scores[rows[keep], columns[keep]].reshape(shape), ids[columns[keep]].reshape(shape)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k best candidates by integer inner product of floor(256 * x): query_id, rank, vec_id, score.

    Queries go out in blocks of at most QUERY_BLOCK rows, a bounded broadcast that is given up when the block's lists are
    written, all blocks to one table; every partition of candidates is a shard that multiplies the block tile by tile and
    keeps one running list of k per query, and lists meet in a tree: FAN_IN shards first, then all. A candidate with a
    query's id is its own row and is left out. Rows without an id, and vectors that are null, empty or hold null or
    non-finite components, take no part; vectors are compared only with such of the same length; ties go to the smaller
    id. Equal rows repeated under one id are made one before the search, of queries and candidates alike; different
    vectors under one id each count. Scores beyond the range of a long are held to it. An empty table gives no rows.
    """
    spark = queries.sparkSession
    take = lambda df, name: cut(df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).alias("vector")).where(F.col(name).isNotNull() & valid_vector(F.col("vector"))).distinct())
    shards, asked = take(candidates, "vec_id"), take(queries, "query_id")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))  # blocks are hashed, so half the bound is aimed at
    path = shared_dir(spark)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)) == block).toArrow()
        ids = rows["query_id"].to_numpy()
        held = spark.sparkContext.broadcast([(ids[at], m) for at, m in quantised(rows["vector"].combine_chunks())] if rows.num_rows else [])
        found = best_lists(shards.mapInArrow(shard_search(held, k), OUT), ["query_id", F.expr(f"part div {FAN_IN}")], k)
        found.write.mode("append").parquet(path)
        held.unpersist()
    return best_lists(spark.read.parquet(path), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def best_lists(lists: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shard_search(held, k: int):
    def search(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = [(q, m, np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)) for q, m in held.value]
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for rows, matrix in quantised(batch.column("vector")):
                for n, (q, m, scores, found) in enumerate(state):
                    if m.shape[1] != matrix.shape[1]:
                        continue
                    for at in range(0, len(rows), TILE):
                        own, tile = ids[rows[at : at + TILE]], matrix[at : at + TILE]
                        for top in range(0, len(q), TILE):
                            here = slice(top, top + TILE)
                            s, i = masked(products(m[here], tile), own, q[here], k)
                            merged = best(np.hstack([scores[here], s]), np.hstack([found[here], i]), k)
                            if top == 0:
                                grown = [np.zeros((len(q), merged[0].shape[1]), np.int64) for _ in range(2)]
                            grown[0][here], grown[1][here] = merged
                        scores, found = grown
                    state[n] = (q, m, scores, found)
        for q, _, scores, found in state:
            width = scores.shape[1]
            keep = (found != HOLE).ravel()
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, width)[keep], "vec_id": found.ravel()[keep], "score": scores.ravel()[keep], "part": np.full(keep.sum(), part, np.int32)})

    return search


HOLE, LEAST = 2**63 - 1, -(2**63) + 1  # id and score that fill places of lists shorter than k


def masked(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """selected(), without each query's own row: that one gets the least score and the id HOLE."""
    hit = queries[:, None] == ids
    if not hit.any():
        return selected(scores, ids, min(k, len(ids)))
    s, i = selected(scores, ids, min(k + int(hit.sum(axis=1).max()), len(ids)))
    own = i == queries[:, None]
    s, i = np.where(own, LEAST, s), np.where(own, HOLE, i)
    return best(s, i, min(k, s.shape[1]))


def op1_topk(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
