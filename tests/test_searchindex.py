"""Searches over the index of letter runs against scoring every text; scores in SQL against the functions."""

import random

import duckdb
import pytest
from test_fuzzyjoin import made

from tariffloom.functions import similarity
from tariffloom.operators import search, searchindex
from tariffloom.plans import scores


def brute(query, rows, limit=25):
    """Every text of every owner scored."""
    q = query.lower().strip()
    tokens = "".join(c if c.isalnum() else " " for c in q).split()
    owners = {}
    for owner, called, text, is_name in rows:
        t = (text or "").lower()
        if not t or not q:
            continue
        base = similarity.search_base(q, t)
        boost = 130.0 if t == q else 115.0 if t.startswith(q) else 100.0 if q in t else 0.0
        o = owners.setdefault(owner, [0.0, False, called])
        o[0] = max(o[0], base, boost)
        o[1] = o[1] or any(w in t for w in tokens) or is_name and base >= 90
    found = sorted((-round(s, 2), called, owner) for owner, (s, good, called) in owners.items() if good and round(s, 2) >= 60)
    return [(k + 1, owner, -s) for k, (s, called, owner) in enumerate(found[:limit])]


@pytest.fixture(scope="module")
def rows():
    draw, texts = random.Random(4), made(11, 260, 4)
    out = []
    for k in range(90):
        name = texts[k].capitalize()
        out.append((k, name, name, True))
        out += [(k, name, draw.choice([*texts[90:], None, "", "Ab"]), False) for _ in range(2)]
    return out


QUERIES = ["анализ крови", "аналз крови", "Узи Почек", "ab", "x", "12", "-", "  ", "", None, "крови анализ общий", "консультация", "конслтация врача", "q w e r t y", "мозга-мрт", "zzz", "smal gizmo", "прием первичный врача общий"]


def test_many_searches_equal_all_pairs(spark, rows):
    queries = QUERIES + [t[:2] + t[3:] for t in made(12, 30, 4)]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    texts = spark.createDataFrame(rows, "owner int, owner_name string, text string, is_name boolean")
    found = {}
    for r in searchindex.search(frame, texts).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.owner, r.score))
    for k, query in enumerate(queries):
        assert found.get(k, []) == brute(query or "", rows), query


def test_few_texts_are_looked_up(spark, rows):
    texts = spark.createDataFrame(sorted({(r[2].lower(),) for r in rows if r[2]}), "text string")
    asked = spark.createDataFrame([(0, "конслтация врача", ["конслтация", "врача"])], "query_id int, q string, tokens array<string>")
    index = searchindex.postings(texts)
    wanted = searchindex.asked_runs(asked, index)
    assert wanted.count() < 20
    met = index.join(wanted, "run").select("text").distinct().count()
    assert met < 0.6 * texts.count()


def test_services_of_one_query_equal_those_of_many(spark):
    services = spark.createDataFrame([(1, "ОАК крови", "анализы", ["кровь общий"], True), (2, "УЗИ", None, None, True), (3, "Узи почек", "УЗИ", [], False)], "service_id int, service_name string, category string, synonyms array<string>, is_active boolean")
    items = spark.createDataFrame([(1, 5, True, 10.0), (1, 6, True, 20.0), (1, 6, False, 1.0)], "service_id int, partner_id int, is_active boolean, resident_kzt double")
    one = search.services("кров", services, items).collect()
    assert [(r.service_id, r.category, r.score, r.partner_count, r.min_price, r.max_price) for r in one] == [(1, "анализы", 115.0, 2, 10.0, 20.0)]
    assert search.services(" ", services, items).count() == 0 and search.services("узи", services).collect()[0].service_id == 2


@pytest.mark.parametrize("always", [False, True])
def test_scores_in_sql(always):
    pairs = [(a, b) for a in made(1, 25, 6) for b in [*made(2, 25, 4), "abc", "ab x", "x"]]
    con = duckdb.connect()
    con.execute("CREATE TABLE pairs (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO pairs VALUES (?, ?)", pairs)
    found = con.execute(f"WITH {scores.ctes('pairs', always)} SELECT a, b, token_set, part, weighted FROM scored").fetchall()
    assert len(found) == len(set(pairs))
    for a, b, token_set, part, weighted in found:
        assert abs(token_set - similarity.token_set(a, b)) < 1e-9 and abs(weighted - similarity.weighted(a, b)) < 1e-9
        assert not always or abs(part - similarity.partial(a, b)) < 1e-9


def test_owners_of_equal_texts_are_searched_as_one(spark, rows):
    """Copies of a catalogue under other keys give the lists that scoring every text gives; the tables met don't grow with them."""
    many = [(owner + 1000 * k, *rest) for k in range(30) for owner, *rest in rows]
    texts = spark.createDataFrame(many, "owner int, owner_name string, text string, is_name boolean")
    groups = searchindex.alike(texts.where("text <> ''"), 25)
    assert groups.where("owner = first").count() <= 90 and groups.count() <= 25 * 90
    queries = ["анализ крови", "аналз крови", "ab", "консультация"]
    found = {}
    for r in searchindex.search(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), texts).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.owner, r.score))
    for k, query in enumerate(queries):
        assert found.get(k, []) == brute(query, many), query
