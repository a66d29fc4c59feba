"""Whole jobs of the domain's queries that the first round cut short."""

import pytest
from conftest import oracle, rows_of

from tariffloom.operators import match
from tariffloom.plans import catalogue, domain, pricing

SF = "/root/testdata/sf0.01"  # has providers beyond 40


@pytest.mark.parametrize("name", ["partner_tree_all", "embedding_topk_all"])
def test_whole_tables(spark, name):
    found, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), oracle(catalogue.SQL[name], SF)
    assert rows_of(found) == rows_of(wanted)
    if name == "partner_tree_all":
        assert set(found[found.depth == 1].node) == {str(r.partner_id) for r in domain.items(spark, SF).select("partner_id").distinct().collect()}
    else:
        assert set(found["query"]) == {r.vec_id for r in domain.read(spark, SF, "embeddings").where("vec_id % 50 = 0").collect()}


def test_cosine_in_blocks(spark, monkeypatch):
    rows = domain.read(spark, "/root/testdata/sf0.001", "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    whole = rows_of(match.cosine_top_k(asked, rows).toPandas())
    monkeypatch.setattr(match, "SMALL", 3)
    assert rows_of(match.cosine_top_k(asked, rows).toPandas()) == whole


@pytest.mark.parametrize("name", ["snapshot_merge_all", "dedup_same_day_all"])
def test_whole_price_lists(spark, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    assert rows_of(found) == rows_of(oracle(catalogue.SQL[name], SF))
    rows = domain.items(spark, SF)
    old, new = pricing.stored(spark, SF).count(), pricing.incoming(spark, SF, whole=True).count()
    assert old + new == rows.count() + old and len(found) == (old + new if name == "snapshot_merge_all" else new)


def test_tiles_equal_all_pairs(spark, monkeypatch):
    """Equal vectors, null and zero ones, null components and other lengths; pairs are scored in arrays, not by a fold for each."""
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], None, [None, 1.0], [1.0, 2.0, 3.0], [2.0, 0.0], [-1.0, 0.5], [], [0.3, 0.4]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(match, "SMALL", 4)
    found = match.cosine_top_k(df.where("vec_id IN (0, 2, 3, 5)"), df, 4)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["vec_id"], round(r["score"], 3)))
    assert got == {0: [(1, 1.0), (6, 1.0), (9, 0.6), (2, 0.0)], 2: [(0, 0.0), (1, 0.0), (3, 0.0), (4, 0.0)], 3: [(0, 0.0), (1, 0.0), (2, 0.0), (4, 0.0)], 5: [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]}
