"""Cases that the first round's operators cut short."""

import numpy as np
import pytest

from tariffloom.llm import ann, html, neardup, topk
from tariffloom.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ship(spark)


def words(prefix, n=40, changed=None):
    return " ".join("changed" if i == changed else f"{prefix}{i}" for i in range(n))


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(1, words("a")), (2, words("a")), (2, words("b"))], [(1, words("a")), (2, words("b"))]),
        ([(1, words("a")), (None, words("a")), (None, words("b")), (None, words("c"))], [(1, words("a")), (None, words("b")), (None, words("c"))]),
        ([(7, words("d")), (7, words("d")), (7, words("e")), (3, None), (3, "")], [(7, words("d")), (7, words("e")), (3, None), (3, "")]),
    ],
)
def test_keep_one_of_repeated_and_null_ids(spark, rows, wanted):
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame(wanted, "doc_id long, text string").collect()))


@pytest.mark.parametrize("ids", [(None, None, None), (4, 4, 4), (None, 4, None)])
def test_keep_one_of_near_copies_under_one_or_no_id(spark, ids):
    rows = list(zip(ids, (words("a", 60), words("a", 60, 59), words("b", 60))))
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = neardup.keep_one(df).collect()
    assert len(got) == 2 and sum(r.text == rows[2][1] for r in got) == 1
    assert 4 not in ids or next(r.doc_id for r in got if r.text != rows[2][1]) == 4
    assert len({r.component_id for r in neardup.near_duplicates(df).collect()}) == len(set(ids))


@pytest.fixture(scope="module")
def copies(spark):
    """Ids 0 to 39, the nearest and best of id 0 copied 25 times in one partition; queries 0 (copied as well) and 1."""
    m = np.random.default_rng(4).normal(size=(40, 8)).astype(np.float32)
    m[7] = m[0] * 1.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows + [rows[7]] * 25, "vec_id long, embedding array<float>").coalesce(1)
    return m.astype(np.float64), df, spark.createDataFrame([rows[0]] * 30 + [rows[1]], "vec_id long, embedding array<float>")


def test_topk_of_more_copies_than_k(copies, monkeypatch):
    m, df, queries = copies
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)  # 30 equal queries are one
    whole = np.floor(256 * m)
    got = topk.top_k(queries, df, 5).collect()
    for q in (0, 1):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(40) if i != q)[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_ann_of_more_copies_than_k(copies):
    m, df, queries = copies
    got = ann.nearest(queries, df, 10, ann.Settings(mass=1.0)).collect()
    for q in (0, 1):
        best = sorted((float(np.sqrt(((m[q] - m[i]) ** 2).sum())), i) for i in range(40) if i != q)[:10]
        assert sorted((r.rank, r.vec_id) for r in got if r.query_id == q) == [(n + 1, i) for n, (_, i) in enumerate(best)]


def test_different_vectors_of_one_id_at_equal_scores(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (5, [1.0, 2.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0]), (6, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for found in (topk.top_k(df.where("vec_id = 0"), df, 3), ann.nearest(df.where("vec_id = 0"), df, 3, ann.Settings(mass=1.0))):
        assert sorted(r.vec_id for r in found.collect()) == [5, 5, 6]


BODY = "<h1>Head</h1><p>" + "The mayor said, on Monday, that the bridge opens. " * 6 + "</p><p>" + "Work, as planned, went on for years. " * 6 + "</p>"
TEXT = "Head " + ("The mayor said, on Monday, that the bridge opens. " * 6 + "Work, as planned, went on for years. " * 6).strip()
SIDE = "<div class='sidebar'><p>Side words, more of them.</p></div><footer><p>Foot.</p></footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='layout has-sidebar'><div>{BODY}</div>{SIDE}</div></body>",
        f"<body><div class='no-sidebar'><article>{BODY}</article></div>{SIDE}</body>",
        f"<body><form id='aspnetForm'><div>{BODY}</div>{SIDE}</form></body>",
        f"<body><form><fieldset><article>{BODY}</article></fieldset>{SIDE}</form></body>",
        f"<body><div class='login-page'><main>{BODY}</main>{SIDE}</div></body>",
        f"<body><div class='login-page'><div>{BODY}</div>{SIDE}</div></body>",
        "<body><div class='post'><div class='post-header'><h1>Head</h1></div>" + BODY.split("</h1>")[1] + f"</div>{SIDE}</body>",
        f"<body><div class='share-layout side'><article>{BODY}</article></div><div class='comments'><article class='comment'><p>{'Nice, I say. ' * 90}</p></article></div></body>",
        f"<body><div>{BODY}</div><div class='comments'><p>{'Nice, I say. ' * 90}</p></div></body>",
    ],
)
def test_html_of_wrapped_articles(page):
    assert html.main_text(page) == TEXT
