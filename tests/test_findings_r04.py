"""What the fourth round's findings found."""

import pytest
from conftest import oracle, rows_of

from tariffloom.operators import match
from tariffloom.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_f1_tiles_meet_all_blocks(spark, apart, monkeypatch):
    """Few queries, rows in many tiles: every tile meets them, wherever its partition is."""
    monkeypatch.setattr(match, "SMALL", 60)
    assert rows_of(catalogue.QUERIES["embedding_topk"](spark, SF).toPandas()) == rows_of(oracle(catalogue.SQL["embedding_topk"], SF))


def test_f1_order_of_cosines(spark, monkeypatch, tmp_path):
    """Multiples of one vector, negative cosines, repeated rows and fewer rows than asked for: order and scores are the SQL's."""
    vectors = [[0.1 * x * n for x in (3.3, -1.7, 2.9)] for n in range(1, 60)] + [[-1.0, 0.5, -2.0], [-1.0, 0.4, -2.0], [1e-30, 2e-30, 0.0], [1e30, -2e30, 1e25]]
    df = spark.createDataFrame(list(enumerate(vectors)) + [(3, vectors[3]), (61, [0.5, 0.5, 0.5])], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for pairs, small in ((32_768, 65_536), (7, 16)):
        monkeypatch.setattr(match, "PAIRS", pairs)
        monkeypatch.setattr(match, "SMALL", small)
        monkeypatch.setattr(match, "GROUP", 2)
        for sql in (catalogue.SQL["embedding_topk"], catalogue.SQL["embedding_topk"].replace("a.vec_id < 20", "a.vec_id < 3").replace("rank <= 5", "rank <= 70")):
            k, asked = (5, "vec_id < 20") if "rank <= 5" in sql else (70, "vec_id < 3")
            got = match.cosine_top_k(df.where(asked), df, k).selectExpr("query", "rank", "vec_id", "round(score, 6) AS score").toPandas()
            assert rows_of(got) == rows_of(con.sql(sql).df())


def test_f5_every_row_asks(spark, apart, monkeypatch):
    monkeypatch.setattr(match, "SMALL", 150)
    found = catalogue.QUERIES["embedding_topk_all"](spark, SF).toPandas()
    assert rows_of(found) == rows_of(oracle(catalogue.SQL["embedding_topk_all"], SF))
    assert set(found["query"]) == set(oracle("SELECT vec_id FROM embeddings", SF)["vec_id"])


def test_f3_rows_are_shuffled_once(spark, tmp_path, monkeypatch):
    """A batch and what is stored meet in one shuffle, a part in one task; rows that come again are told by hashes, of whatever
    number. An item_id that another line has stored is no repetition."""
    from tariffloom.operators import upserts
    from tariffloom.plans import pricelists
    from tariffloom.streaming import ingest

    kind = "item_id string, partner_id long, service_name_raw string, effective_date date, price decimal(14,2), document_no int"
    frame = lambda rows: spark.createDataFrame([(i, p, " x ", None, None, n) for i, p, n in rows], kind)
    first, second = frame([(f"i{k}", k % 9, 0) for k in range(60)]), frame([(f"i{k}", k % 9, 1) for k in range(40, 80)] + [("i1", 2, 1), ("i77", 5, 1)])
    wanted = sorted([(f"i{k}", k % 9) for k in range(80)] + [("i1", 2)])
    for most in (10_000, 3):
        monkeypatch.setattr(ingest, "REPEATED", most)
        table = pricelists.versions_table(spark, f"file://{tmp_path}/t{most}", first, 8)
        table.merge(first, 0, ingest.upserted)
        plan = ingest.upserted(table.read(), frame([("new", 1, 1)]), table.part(), 8)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        table.merge(second, 1, ingest.upserted)
        rows = table.read()
        assert sorted((r.item_id, r.partner_id) for r in rows.collect()) == wanted
        assert rows.schema == upserts.upsert(None, first).schema == upserts.schema_of(first)


def test_f4_rows_columns_are_compiled(spark):
    """Generators, which are never compiled, stand over distinct headers only; rows without a table's number stay out, others not."""
    from tariffloom.functions import prices
    from tariffloom.operators import tables

    kind = "table_id long, row_idx int, cells array<string>, hint int"
    plan = tables.priced_rows(spark.createDataFrame([], kind), levels=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 2 * plan.count("Aggregate [header_cells") == 4
    head = [" Услуга ", "Цена", None]
    rows = [(t, n, c) for t in (1, 2) for n, c in enumerate([[None, " "], head, ["Раздел 1"], ["　- Осмотр\t", " 1 200\n", ""], ["ИТОГО", "5", ""], ["Ёж", None, "7"]])]
    rows += [(3, None, ["Снимок", "9"]), (3, 1, ["Зуб", "\n12 "]), (None, 1, ["x", "1"])]
    found = tables.priced_rows(spark.createDataFrame([(*r, None) for r in rows], kind))
    got = sorted(str((r.table_id, r.row_idx, r.service_name_raw, r.price_resident, r.section_path)) for r in found.collect())
    same = [(3, "Осмотр", 1200.0, ["Раздел 1"]), (5, "Ёж", 7.0, ["Раздел 1"])]
    assert got == sorted([str((t, *x)) for t in (1, 2) for x in same] + [str((3, None, "Снимок", 9.0, [])), str((3, 1, "Зуб", 12.0, []))])
    texts = ["", " a ", "  a b　\n", "\x0b\x0ca\r", "​ a", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    from pyspark.sql import functions as F

    assert [r.v for r in df.select("n", prices.trimmed(F.col("t")).alias("v")).orderBy("n").collect()] == ["", "a", "a b", "a", "​ a", ""]
    assert "regexp_replace" not in str(prices.trimmed(F.col("t")))


def test_f2_marks_and_codes(spark):
    """Marks are trimmed without a regular expression, and codes are peeled, up to three, only off names that one leads."""
    from pyspark.sql import functions as F

    from tariffloom.operators import geometry

    assert "regexp_replace" not in str(geometry.stripped(F.col("t")))
    names = ["A1.5 УЗИ почек", "12.3 45.6 1234 99.1 Приём врача", "Осмотр 12.3", "№ -.Снимок зуба—|\t", "1234 5", "А01.02 x", "", None, " .: "]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(names)], "n int, t string").withColumn("c", geometry.leading_code(F.col("t")))
    got = [(r.c["name"], r.c["code"]) for r in df.orderBy("n").collect()]
    assert got == [("УЗИ почек", "A1.5"), ("99.1 Приём врача", "12.3"), ("Осмотр 12.3", None), ("Снимок зуба", None), ("1234 5", None), ("А01.02 x", None), ("", None), (None, None), ("", None)]
