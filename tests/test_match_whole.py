"""The match cascade against brute force over the whole catalogue."""

import pytest

from tariffloom.functions.similarity import fuzzy
from tariffloom.operators import match

NAMES = ["алт", "фгдс", "узи", "ekg", "ab", "анализ крови", "мрт головного мозга", "рентген", "осмотр"]


@pytest.fixture(scope="module")
def services(spark):
    return spark.createDataFrame([(i, n, [n[::-1]] if i % 2 else [], True) for i, n in enumerate(NAMES)], "service_id int, service_name string, synonyms array<string>, is_active boolean")


def brute(raw, allowed=None):
    best = [(-max(round(fuzzy(raw, t), 4) for t in ([n, n[::-1]] if i % 2 else [n])), n, i) for i, n in enumerate(NAMES) if allowed is None or i in allowed]
    return [(i, -s) for s, _, i in sorted(best)[:5]]


def test_every_text_is_scored(spark, services):
    raws = ["аллт", "фгс", "узы", "ekk", "abc", "zzzz", "анализы крове"]
    got = {r.raw: r for r in match.cascade(spark.createDataFrame([(r,) for r in raws], "raw string"), services).collect()}
    for raw in raws:
        assert [(c.service_id, c.score) for c in got[raw].candidates] == brute(raw)
    assert [got[r].status for r in raws[:4]] == ["matched_auto", "matched_auto", "needs_review", "needs_review"]
    assert (got["abc"].service_id, got["abc"].confidence, got["zzzz"].status, len(got["zzzz"].candidates)) == (4, 0.9, "unmatched", 5)


def test_allowed_and_vector_hits(spark, services):
    names = spark.createDataFrame([("аллт",), ("zzzz",)], "raw string")
    allowed = spark.createDataFrame([("аллт", 0), ("аллт", 1)], "norm string, service_id int")
    hits = spark.createDataFrame([("zzzz", 6, 0.9), ("аллт", 0, 0.1)], "norm string, service_id int, score double")
    got = {r.raw: r for r in match.cascade(names, services, allowed=allowed, vector_hits=hits).collect()}
    assert [(c.service_id, c.score) for c in got["аллт"].candidates] == brute("аллт", {0, 1})
    assert (got["zzzz"].service_id, got["zzzz"].method, got["zzzz"].status, len(got["zzzz"].candidates)) == (6, "embedding", "matched_auto", 5)
