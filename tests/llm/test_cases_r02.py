"""Null ids, clashing names, long texts without spaces, odd pages; sharding and the learner against plain versions."""

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tariffloom.llm import bpe, html, neardup, packing, sharding, substrings, tokenfiles, toxicity
from tariffloom.llm.common import ship

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = "doc_id long, text string, score int, predicted string, kept string, stamp string, w_id int, part int, none int, n_chars int"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ship(spark)


def words(prefix, n=60):
    return " ".join(f"{prefix}{k}" for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(None, words("a")), (None, None), (1, words("a")), (2, words("b")), (None, words("b") + " " + words("c")), (3, ""), (3, "x" * 70_000)]
    return spark.createDataFrame([(i, t, 1, "p", "k", "s", 2, 3, 4, 5) for i, t in texts], ODD)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, 1, "p", "k", "s", 2, 3, 4, 5)] * 3, ODD)


def test_stages_keep_columns(spark, odd, nulls):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    for df in (odd, nulls, odd.limit(0)):
        for done in (toxicity.keep_clean(df, labels), neardup.keep_one(df), substrings.rewrite(df)):
            assert done.columns == df.columns and [f.dataType for f in done.schema.fields] == [f.dataType for f in df.schema.fields]
            assert all((r.kept, r.stamp, r.w_id, r.part, r.none) == ("k", "s", 2, 3, 4) for r in done.collect())
    assert neardup.keep_one(odd).count() == 6 and substrings.rewrite(odd).count() == 7
    cut = {r.text: r.n_chars for r in substrings.rewrite(odd).collect()}
    assert cut[""] in (0, 5) and Counter(r.doc_id for r in substrings.rewrite(odd).collect() if r.text == "")[1] == 1


def test_null_ids_and_texts(odd, nulls, spark, tmp_path):
    for n, df in enumerate((odd, nulls)):
        rows = Counter((r.doc_id, r.text or "") for r in df.collect())
        assert Counter(r.doc_id for r in packing.pack(df, BYTES).where("start = 0").collect()) == Counter(d for d, _ in rows.elements())
        tokenfiles.write(df, f"file://{tmp_path}/{n}", WORDS)
        assert Counter(r.doc_id for r in tokenfiles.read(spark, f"file://{tmp_path}/{n}").collect()) == Counter(d for d, _ in rows.elements())
        assert Counter(r.doc_id for r in sharding.shard(df).collect()) == Counter(d for d, _ in rows.elements())
        t = Tokenizer.from_file(WORDS)
        wanted = Counter((d, tuple(t.encode(x, add_special_tokens=False).ids)) for d, x in rows.elements())
        assert Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(df, WORDS).collect()) == wanted
        assert neardup.near_duplicates(df).count() == df.count() == substrings.remove_repeats(df).count()


def test_sharding_recomputed(spark):
    rows = [(i, f"text {i % 7}") for i in range(300)] + [(None, "x")] * 3 + [(5, "again")] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = [1.0, 2.0, 0.5]

    def best(key, weights):
        unit = [(int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for n in range(len(weights))]
        return max(range(len(weights)), key=lambda n: (-weights[n] / math.log(unit[n]), -n))

    wanted = Counter((i, len(t) + 1, zlib.crc32(t.encode()), best("null" if i is None else i, weights), best("null" if i is None else i, [*weights, 1.0])) for i, t in rows)
    got = sharding.shard(df, 3, weights).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == wanted
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_slots_of_equal_rows(spark):
    df = spark.createDataFrame([(5, "x")] * 50, "doc_id long, text string")
    run, sharding.RUN = sharding.RUN, 7
    try:
        assert sorted(r.slot for r in sharding.shard(df).collect()) == list(range(50))
    finally:
        sharding.RUN = run


def plain_ftrl(rows, labels, s):
    """The learner one feature at a time."""
    seen = Counter(f for r in rows for f in r.tolist())
    z, n, w = ({f: 0.0 for f in seen if seen[f] >= s.least_docs} for _ in range(3))
    zb = nb = bias = 0.0
    from tariffloom.llm.common import mix

    for _ in range(s.epochs):
        for i in np.argsort(mix(np.arange(len(rows), dtype=np.uint64))).tolist():
            mine = [f for f in rows[i].tolist() if f in w]
            g = 1 / (1 + math.exp(-max(-30, min(30, bias + sum(w[f] for f in mine))))) - labels[i]
            for f in mine:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w[f]
                n[f] += g * g
                w[f] = 0.0 if abs(z[f]) <= s.l1 else (math.copysign(s.l1, z[f]) - z[f]) / ((s.beta + math.sqrt(n[f])) / s.alpha + s.l2)
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / s.alpha * bias
            nb += g * g
            bias = -zb / ((s.beta + math.sqrt(nb)) / s.alpha)
    return {f: x for f, x in w.items() if x}, bias


def test_learner():
    draws = np.random.default_rng(4)
    texts = [" ".join(draws.choice(["good", "bad", "fine", "ugly", "day", "night"], 12)) + (" awful" if k % 3 == 0 else "") for k in range(60)]
    rows = [f for _, f in toxicity.features(pa.array(texts))]
    labels = np.array([k % 3 == 0 for k in range(60)], float)
    s = toxicity.Settings(epochs=5, l1=0.5)
    names, weights, bias = toxicity.ftrl(rows, labels, s)
    wanted, plain_bias = plain_ftrl(rows, labels, s)
    assert set(names.tolist()) == set(wanted) and abs(bias - plain_bias) < 1e-9
    assert all(abs(x - wanted[f]) < 1e-9 for f, x in zip(names.tolist(), weights.tolist()))


def test_sample_is_ordered(spark):
    """Long texts take part, repeated rows count once, and the bound is in bytes whatever the schedule."""
    rows = [(i, ("bad " if i % 2 else "good ") * (20_000 if i < 4 else 5)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows * 3, "doc_id long, text string")
    one, two = (toxicity.fit(df.repartition(n), labels, toxicity.Settings(l1=0.1)) for n in (2, 7))
    assert (one[0] == two[0]).all() and np.allclose(one[1], two[1]) and len(one[0])
    assert len(toxicity.fit(df, labels, toxicity.Settings(l1=0.1, sample_bytes=0, per_class=1))) == 3


BODY = "<p>Real, text of the article, long enough to count, with commas.</p><p>More, of it.</p>"
TEXT = "Real, text of the article, long enough to count, with commas. More, of it."


@pytest.mark.parametrize(
    "page",
    [
        f"<title>x<body><article>{BODY}</article>", f"<div class='site no-sidebar'><div>{BODY}</div></div>", f"<div class='layout with-sidebar'>{BODY}</div>", f"<div class='content has-sidebar'>{BODY}</div>",
        f"<div class='search-article'>{BODY}</div>", f"<div class='article-header-image story'>{BODY}</div>", f"<form id=aspnetForm><div>{BODY}</div></form>", f"<svg><article>{BODY}</article>",
        f"<nav><a href=/a>Home, of all</a></nav><div class=login-page><div>{BODY}</div></div>", f"<select><option>a</option></select><div>{BODY}<aside>x, y, z</aside></div>",
    ],
)
def test_names_do_not_decide(page):
    assert html.main_text(page) == TEXT


def test_html_cases():
    assert html.main_text("<p>Let <math><mi>x</mi></math> be, a number.</p>") == "Let x be, a number."
    assert html.main_text(f"<script>if (a<b) <p>no</p>{BODY}") == "" and html.main_text("<object><p>Fallback, text.</p></object>") == "Fallback, text."
    begun = time.time()
    assert html.main_text("<div>" * 100_000 + "<p>deep, text</p>" + "</foo></div>" * 100_000) == "deep, text"
    assert html.main_text("<b>" * 30_000 + "<svg>" * 30_000 + "<li>a, b" * 2_000).startswith("a, b")
    assert time.time() - begun < 20
