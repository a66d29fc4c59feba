"""The ten operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import oracle, rows_of
from tokenizers import Tokenizer

from tariffloom.llm import ann, bpe, html, neardup, packing, queries, sharding, substrings, tokenfiles, topk, toxicity
from tariffloom.llm.common import ship

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    ship(spark)


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgäé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(300), say(60)
    edited = base.split()
    edited[7] = "changed"
    return [
        base, base, " ".join(edited), base.upper(), None, "", " \n\t ", "one", "one", "two words", say(30) + " " + passage, passage + " " + say(40), passage, passage + " " + passage, say(20_000),
        "a  b   c\n\n\nd \t e  ", "<|endoftext|> and <|startoftext|>x", "中文 🎉 ÀÉ ﬁ don't 12345 ½", "x" * 5000, say(19), say(21), "word. " * 50,
    ]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i * 3, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(odd_texts())]
    rows += [rows[0], rows[14]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def texts(documents):
    return [(r.doc_id, r.text or "") for r in documents.collect()]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    assert rows_of(queries.QUERIES[name](spark, sf).toPandas()) == rows_of(oracle(queries.SQL[name], sf))


@pytest.fixture(scope="module")
def vectors(spark):
    draws = np.random.default_rng(1)
    m = draws.normal(size=(600, 16)).astype(np.float32)
    m[5], m[6] = m[4], m[4]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(1000, None), (1001, []), (1002, [None] * 16), (1003, [float("nan")] * 16), (1004, [0.0] * 16), (1005, [1.0, 2.0]), (None, rows[0][1]), rows[3]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def valid(vectors):
    found = {r.vec_id: r.embedding for r in vectors.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)}
    return {k: np.array(v, dtype=np.float64) for k, v in found.items()}


def test_topk(vectors):
    v = valid(vectors)
    q = vectors.where("vec_id % 50 = 0")
    got = defaultdict(list)
    for r in topk.top_k(q, vectors, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in (k for k in v if k % 50 == 0):
        a = np.floor(256 * v[i])
        best = sorted((-int((a * np.floor(256 * b)).sum()), k) for k, b in v.items() if k != i and len(b) == len(a))[:5]
        assert sorted(got[i]) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert topk.top_k(q.limit(0), vectors.limit(0)).count() == 0


def test_exact_products():
    big = np.full((1, 4), 2.0**40)
    assert topk.products(big, -big)[0, 0] == -(2**63) + 2 and topk.products(big / 2**20, big / 2**20)[0, 0] == 4 * 2**40


def test_ann(vectors):
    v = {k: x for k, x in valid(vectors).items() if len(x) == 16 and x.any()}
    got = ann.nearest(vectors.where("vec_id % 100 = 0"), vectors, 10).collect()
    hits = wanted = 0
    for i in (k for k in v if k % 100 == 0):
        true = sorted((float(np.sqrt(((v[i] - x) ** 2).sum())), k) for k, x in v.items() if k != i)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine) and all(abs(s - np.sqrt(((v[i] - v[k]) ** 2).sum())) < 1e-12 for _, k, s in mine)
        hits += len({k for _, k in true} & {k for _, k, _ in mine})
        wanted += 10
    assert hits >= 0.9 * wanted
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_ann_recall_on_table(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.1"
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    m, ids = np.stack(e.embedding).astype(np.float64), e.vec_id.to_numpy()
    got = {(r.query_id, r.vec_id) for r in ann.op5_ann(spark, sf).collect()}
    true = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((m - m[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        true += sum((ids[i], k) in got for k in ids[np.lexsort((ids, d))[:10]])
    assert true >= 0.9 * 10 * (ids % 100 == 0).sum()


def shingles(text, n):
    w = text.encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n", [2, 5])
def test_neardup(documents, nothing, n):
    rows = texts(documents)
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc)
    wanted = Counter((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))
    got = neardup.near_duplicates(documents, neardup.Settings(words=n)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == wanted and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(nothing).count() == 0


def test_neardup_large_group(spark):
    """A group of near copies larger than a bucket that is compared in one round."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i + 7, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:100] + [f"y{i}-{k}" for k in range(100)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.Settings(words=2, first=2, small=2)).collect()}
    assert all(got[i + 7] == 7 for i in range(120)) and all(got[1000 + i] == 1000 + i for i in range(60))


def test_packing(documents, nothing):
    t = Tokenizer.from_file(BYTES)
    ids = Counter(np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes() for _, x in texts(documents))
    got = packing.pack(documents, BYTES, packing.Settings(open_windows=2, fan_in=2)).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    once = {i: Counter(x for d, x in texts(documents) if d == i) for i in by_doc}
    for i, pieces in by_doc.items():
        if sum(once[i].values()) == 1:
            whole = b"".join(x for _, x, _ in sorted(pieces))
            assert whole in ids and all(n == len(whole) // 4 for _, _, n in pieces)
    assert sum(len(x) for x in ids for _ in range(ids[x])) == sum(len(r.ids) for r in got)
    assert packing.pack(nothing, BYTES).count() == 0


def test_toxicity(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).where(toxicity.held_out()).join(labels, "doc_id").collect()
    hit = Counter((r.predicted, r.toxic) for r in found)
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) >= 0.75 and hit[1, 0] <= 0.01 * (hit[0, 0] + hit[1, 0])


def test_toxicity_cases(documents, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents, none)
    got = toxicity.score(documents, model, ["doc_id"]).collect()
    assert len(got) == documents.count() and len({r.score for r in got}) == 1
    assert toxicity.score(nothing, model).count() == 0
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (3, 1, None), (6, 0, 0), (None, 1, 1), (27, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(documents, labels).columns == documents.columns


def test_sharding(documents, nothing):
    got = sharding.shard(documents).collect()
    assert len(got) == documents.count() and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    known = Counter((d, len(x.encode()) + 1, zlib.crc32(x.encode())) for d, x in texts(documents))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == known
    heavy = sharding.shard(documents.sparkSession.range(4000).selectExpr("id AS doc_id", "'x' AS text"), 2, [1.0, 3.0]).groupBy("shard").count().collect()
    assert 2800 < {r.shard: r["count"] for r in heavy}[1] < 3200 and sharding.shard(nothing).count() == 0


def test_tokenfiles(documents, nothing, spark, tmp_path):
    t = Tokenizer.from_file(WORDS)
    tokenfiles.write(documents, f"file://{tmp_path}/x", WORDS, tokenfiles.Settings(segment=300))
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in tokenfiles.read(spark, f"file://{tmp_path}/x").collect())
    wanted = Counter((d, np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, x in texts(documents))
    assert Counter((d, x) for _, d, x in got) == wanted and [d for _, d, _ in got] == sorted(d for _, d, _ in got)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids) // 4
    tokenfiles.write(nothing, f"file://{tmp_path}/y", WORDS)
    assert tokenfiles.read(spark, f"file://{tmp_path}/y").count() == 0


@pytest.mark.parametrize("n, top", [(0, 5), (1, 5), (1023, 49407), (1024, 49407), (3000, 2**32 - 1), (5000, 0)])
def test_blocks(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype("<u4")
    back = list(tokenfiles.read_segment(tokenfiles.write_segment([(3, ids[: n // 2].tobytes()), (None, ids[n // 2 :].tobytes())], tokenfiles.Settings())))
    assert [k for k, _ in back] == [3, None] and (np.concatenate([x for _, x in back]) == ids).all()


def test_bpe(documents, nothing):
    t = Tokenizer.from_file(WORDS)
    known = Counter()
    for d, x in texts(documents):
        ids = t.encode(x, add_special_tokens=False).ids
        known[d, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.decode(bpe.encode(documents, WORDS), WORDS).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == known
    assert bpe.decode(bpe.encode(nothing, WORDS), WORDS).count() == 0


def test_bpe_random_pieces():
    rng = random.Random(3)
    t, own = Tokenizer.from_file(WORDS), bpe.Bpe.of(WORDS)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzaeiouthsné.,'%&019 ") for _ in range(rng.randint(1, 70))) for _ in range(2000)]
    assert [e.ids for e in t.encode_batch(some, add_special_tokens=False)] == [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)]


PAGES = {
    "<html><body><nav><a href=/x>Home, page</a></nav><div class='ad'>Buy, now</div><article><h1>Head &amp; tail</h1><p><b>One,\n two</b>three<br>four<p>Five.</article><footer>&copy; x, y, z</footer></body></html>": "Head & tail One, twothree four Five.",
    "": "", None: "", "<script>var a='<p>no</p>'</script><style>p{}</style>": "",
    "<div id=sidebar><p>Long, long, sidebar text, with commas, and more</p></div><div class=post><p>Real, text here, of some length.</p><p>More.</p></div><div class=comments><p>Nice, nice, nice, nice, nice</p></div>": "Real, text here, of some length. More.",
    "plain text only": "plain text only", "<main><ul><li>a<li>b, c</ul><p>done</main>": "a b, c done", "<article><p>cut &am": "cut &am",
    "<article><header><h1>T</h1></header><p>Body, of it.</p><form><p>Sign, up</p></form><!-- <p>hidden</p> --><aside>x</aside></article>": "T Body, of it.",
}


def test_html(spark):
    df = spark.createDataFrame([(i, "u", h, 7) for i, h in enumerate(PAGES)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}
    assert html.extract(df.limit(0)).count() == 0


def test_html_pages(spark, sf):
    import re
    from html import unescape

    for r in html.op9_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?:br|/?p|/?h1)>", " ", inside))).split())


def brute_repeats(rows):
    seen, out = {}, Counter()
    for d, t in sorted(set(rows)):
        w = t.encode().split()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            seen[x] = min(seen.get(x, (d, k)), (d, k))
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] < (d, k):
                gone[k : k + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings(documents, nothing):
    for s in (substrings.Settings(), substrings.Settings(group_bytes=1, filter_rows=1, tile=3, automaton_words=30, pairs=1)):
        got = substrings.remove_repeats(documents, s).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(texts(documents))
    assert substrings.remove_repeats(nothing).count() == 0


def test_substrings_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = substrings.op10_substrings(spark, sf).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows)


def thue_morse(length, a, b):
    return [a if bin(k).count("1") % 2 == 0 else b for k in range(length)]


def test_hashes_that_sums_confuse(spark):
    """Arrangements that sums modulo a power of two can't tell apart: of words in a text, and of letters in a word."""
    mixed = lambda a, b: [x for k, y in enumerate(thue_morse(1024, a, b)) for x in (f"u{k}", y)]
    rows = [(1, " ".join(mixed("a", "b"))), (2, " ".join(mixed("b", "a"))), (3, "".join(thue_morse(2048, "a", "b"))), (4, "".join(thue_morse(2048, "b", "a"))), (5, "A" * 5000), (6, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substrings.remove_repeats(df).collect())
    sets = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, neardup.Settings(words=2)).collect()}
    assert sets[3] == (1, 3) and sets[4] == (1, 4) and sets[6] == (1, 5)


def test_substrings_common_blocks(spark):
    """Half windows that stand in many contexts, periodic texts, and passages across tiles."""
    rng = random.Random(8)
    line = " ".join(f"l{k}" for k in range(10))
    texts = [" ".join([f"a{rng.randint(0, 60)}" for _ in range(8)] + [line]) for _ in range(120)]
    texts += ["w " * 300, "w x " * 90, " ".join(texts[:40]), " ".join(texts[20:50]), " ".join(f"p{k}" for k in range(400)), " ".join(f"p{k}" for k in range(50, 390))]
    rows = [(rng.randint(0, 90), t) for t in texts] + [(None, texts[-1]), (None, texts[-3]), (-(2**63), "w " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda d: -(2**63) if d is None else d
    for s in (substrings.Settings(), substrings.Settings(group_bytes=2000, automaton_words=90, tile=7)):
        got = substrings.remove_repeats(df, s).collect()
        assert Counter((key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([(key(d), t) for d, t in rows])
        assert sum(r.doc_id is None for r in got) == 2
