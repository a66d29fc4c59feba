"""Texts shorter than a window: told without counting all words, and never dealt out by op10."""

import pytest

from tariffloom.llm import substrings
from tariffloom.llm.queries import OP10_SQL

S = substrings.Settings()
WORD = " \t\n\x0b\x0c\r"


def test_has_window_equals_a_count(spark):
    texts = [None, "", " ", "a", "x " * 19, "x " * 20, "x " * 19 + "x", " \t" + "é\n" * 19 + "é", "a b" + " " * 200, "w" * 5000, "\n".join("abcdefghij" * 2), " ".join("x" * 40), "x\x1cy " * 10, "x\x1cy " * 20]
    found = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", "text", substrings.has_window(S).alias("has")).collect()
    for r in found:
        words = "".join(" " if c in WORD else c for c in r.text or "").split(" ")
        assert r.has == (len([w for w in words if w]) >= S.window), repr(r.text)


def test_a_third_without_text_and_a_third_of_equal_short_texts(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(k, None if k % 3 == 0 else ("ok" if k % 2 else "") if k % 3 == 1 else f"{k} {passage} end {k}") for k in range(900)]
    rows += [(None, None)] * 40 + [(None, passage)] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = substrings.op10_substrings(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert sorted(by_id[None]) == [(0, 0)] * 40 + [(25, 0)] * 3
    for k, text in rows[:900]:  # rows without an id have the passage first, document 2 the window that ends in "end"
        assert by_id[k] == ([(0, 0)] if not text else [(1, 0)] if text == "ok" else [(28, 25 if k == 2 else 26)])


@pytest.mark.parametrize("salted", [2, 512])
def test_equals_sql_with_hot_copies(spark, tmp_path, monkeypatch, salted):
    import duckdb
    from conftest import rows_of

    monkeypatch.setattr("tariffloom.llm.hot.SHARE", salted)
    passages = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(k, passages[0] if k % 3 == 0 else "short text" if k % 3 == 1 else f"{passages[k % 2]} own {k} {passages[2]}") for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows_of(substrings.op10_substrings(spark, str(tmp_path)).toPandas()) == rows_of(con.sql(OP10_SQL).df())
