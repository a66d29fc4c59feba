"""Vector codes: filtering against plain search, whole results against SQL, odd rows, joins on hot keys."""

import numpy as np
import pytest
from conftest import oracle, rows_of

from tariffloom.llm import codes, hot

S = codes.Settings()
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("reach", [1, 3, 900, 1 << 20, 1 << 40, codes.LARGE])
@pytest.mark.parametrize("entries", [1, 2, 16])
def test_nearest_equals_plain_search(reach, entries):
    rng = np.random.default_rng(reach % 1000 + entries)
    parts, book = (rng.integers(-reach, reach, (n, 5), endpoint=True) for n in (300, entries))
    best, distance = codes.assigned(parts, book, S)
    for v, e, d in zip(parts.tolist(), best, distance):
        plain = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in book.tolist()]
        assert (int(e), int(d)) == (plain.index(min(plain)), min(plain))


def test_filter_leaves_few_and_bounds_hold():
    rng = np.random.default_rng(3)
    parts, book = rng.integers(-2000, 2000, (500, 8)), rng.integers(-2000, 2000, (16, 8))
    cells = codes.Cells(book, S)
    low, high = cells.bounds(parts)
    true = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    assert cells.nearest(parts)[2] < 0.35 * true.size


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, d):
    d = f"/root/testdata/{d}"
    assert rows_of(codes.op13_codes(spark, d).toPandas()) == rows_of(oracle(codes.OP13_SQL, d))


def sql(path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    found = con.sql(codes.OP13_SQL).df().astype(object)
    return found.where(found.notna(), None)


def made(spark, path, rows):
    spark.createDataFrame([(*r, "c", 7) for r in rows], SCHEMA + ", code string, error int").write.parquet(f"{path}/embeddings.parquet")
    return codes.op13_codes(spark, str(path)).toPandas()


ODD = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None), (904, [1.0] * 3, 4), (905, [], 4), (None, [0.5] * 16, None)]


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k // 2, rng.normal(size=16).round(3).tolist(), None if k % 3 == 0 else k % 5) for k in range(120)]
    rows += [rows[5]] * 40 + ODD
    found = made(spark, tmp_path, rows)
    assert len(found) == len(rows) - 4 and rows_of(found) == rows_of(sql(tmp_path))


@pytest.mark.parametrize("rows", [[], ODD[:2], ODD[-1:], [(k, [0.25 * k] * 12, 0) for k in range(5)], [(1, [3e30, -3e30] * 4, 0), (2, [1.0] * 8, 0)]])
def test_small_tables(spark, tmp_path, rows):
    found = made(spark, tmp_path, rows)
    assert len(found) == sum(r[1] is not None and None not in r[1] for r in rows)
    if rows and max(abs(x or 0) for r in rows for x in r[1] or []) < 1e9:
        assert rows_of(found) == rows_of(sql(tmp_path))


def test_decoded_vectors_are_near(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = codes.train(rows)
    told = {r.vec_id: r.vector for r in codes.decode(codes.encode(rows, books), books).collect()}
    errors = {r.vec_id: r.error for r in codes.encode(rows, books).collect()}
    for r in rows.collect():
        own = np.floor(np.array(r.embedding, float) * S.scale)
        assert int(((own - np.array(told[r.vec_id]) * S.scale) ** 2).sum().round()) == errors[r.vec_id]


def test_values_of_hot_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"k{k}") for k in range(3000)], "id long, name string")
    values = rows.groupBy("name").count()
    found = hot.with_values(rows, values, "name", "count").collect()
    assert sorted(r.id for r in found) == list(range(3000))
    assert all(r["count"] == (1 if str(r["name"]).startswith("k") else 1000) for r in found)
