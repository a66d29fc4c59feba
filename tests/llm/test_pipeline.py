"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
import pytest
from test_operators import brute_repeats, shingles

from tariffloom.llm import substrings


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{n}"
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_rows(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_near_duplicates(stages):
    before, after = ({r.doc_id: r.text or "" for r in df.collect()} for df in stages[1])
    sets = {i: shingles(t, 5) for i, t in before.items()}
    linked = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ids = sorted(before)
    group = {i: i for i in ids}
    find = lambda x: x if group[x] == x else find(group[x])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert set(after) == {i for i in ids if find(i) == i}


def test_substrings(stages):
    before, after = ({r.doc_id: r.text or "" for r in df.collect()} for df in stages[2])
    wanted = {d: (n, gone) for d, n, gone, _ in brute_repeats(list(before.items()))}
    assert {d: len(t.encode().split()) for d, t in after.items()} == {d: n - gone for d, (n, gone) in wanted.items()}
    assert all(after[d] == before[d] for d, (_, gone) in wanted.items() if not gone)


def test_packed(stages):
    before, after = stages[3]
    found = after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in before.select("doc_id").collect()} and all(r["sum(length)"] == r["max(doc_tokens)"] for r in found)


def test_rewrite_of_repeated_ids(spark):
    long_ = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, long_, 3), (2, "x " + long_, 4), (2, "other", 5), (None, None, 0)], "doc_id long, text string, n_chars int")
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in substrings.rewrite(df).collect()), key=str)
    assert got == sorted([(1, long_, 3), (2, "x", 1), (2, "other", 5), (0, None, 0)], key=str)
