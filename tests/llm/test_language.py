"""Language identification: the code, n-gram counts and decoding by plain versions; held-out accuracy; odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tariffloom.llm import language
from tariffloom.llm.common import mix

S = language.Settings(features=1 << 12, chunk=64)
WORDS = {"en": "the house and there was with which that", "de": "das haus und dort war mit welches daß für", "fr": "la maison et là était avec laquelle ça", "nl": "het huis en daar was met welk dat zij"}


def made(n):
    rng = np.random.default_rng(5)
    return [(k, " ".join(rng.choice(WORDS[lang].split(), 12)), lang) for k in range(n) for lang in [list(WORDS)[k % 4]]]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 40])
def test_codewords_differ(n):
    code = language.codewords(n, language.Settings())
    assert len(code) == n and len({tuple(r) for r in code}) == n
    if n > 1:
        bits = {tuple(b * b[0]) for b in code.T}
        assert len(bits) == code.shape[1] and all(len(set(b)) == 2 for b in code.T)


def test_counts_are_those_of_plain_code():
    texts = ["abc abc", "", None, "é" * 100, "x", "long " * 60]
    found = np.concatenate([x for _, x in language.gram_counts(pa.array(texts), S)])
    for text, row in zip(texts, found):
        data, plain = (text or "").encode(), np.zeros(S.features)
        for n, salt in enumerate(language.GRAMS, 1):
            for k in range(len(data) - n + 1):
                plain[int(mix(np.array([int.from_bytes(data[k : k + n], "big")], np.uint64) ^ salt)[0]) % S.features] += 1
        plain = np.sqrt(plain)
        np.testing.assert_allclose(row, plain / max(np.linalg.norm(plain), 1e-12))


def test_decoding_takes_the_least_weighted_loss():
    code = language.codewords(4, S)
    model = language.Model(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.linspace(1, 2, 7) / np.linspace(1, 2, 7).sum())
    answers = np.random.default_rng(1).normal(size=(50, 7))
    best, top, lead = language.decoded(answers, model)
    for a, k in zip(answers, best):
        losses = [sum(t * np.log1p(np.exp(-x * c)) for t, x, c in zip(model.trust, a, word)) for word in code]
        assert k == int(np.argmin(losses))
    assert ((0 < top) & (top <= 1)).all() and (lead >= 0).all()
    wrong = -3.0 * code[2].copy() * np.where(np.arange(7) == 0, 1, -1)  # one bit flipped
    assert language.decoded(wrong[None], model)[0][0] == 2
    assert language.decoded(np.zeros((1, 7)), model)[2][0] == 0  # a tie is ambiguous


def test_learns_from_rows_that_are_not_held_out(spark):
    rows = made(400)
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    spoilt = kept + [(i, t, "fr") for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    small = language.Settings(features=1 << 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, small)
    other = language.fit(spark.createDataFrame(spoilt, docs.schema), small)
    assert model.names == sorted(WORDS) and (model.weights == other.weights).all() and (model.trust == other.trust).all()
    found = {r.doc_id: r.lang_pred for r in language.identify(docs.drop("lang"), model, small).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_odd_rows(spark):
    rows = [*made(200), (None, "das haus", "de"), (900, None, "en"), (901, "", "en"), (902, "12 + 7 = 19!", "en"), (903, "the house " * 50_000, None), (904, "the house", "en"), (904, "the house", "en")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    small = language.Settings(features=1 << 12)
    model = language.fit(docs, small)
    found = language.identify(docs, model, small).collect()
    assert len(found) == len(rows)
    told = [(r.doc_id, r.lang_pred) for r in found]
    assert (None, "de") in told and told.count((904, "en")) == 2 and (903, "en") in told
    assert {x for i, x in told if i in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    none = docs.limit(0)
    empty = language.fit(none, small)
    assert empty.names == [] and language.identify(none, empty, small).count() == 0
    assert {r.lang_pred for r in language.identify(docs, empty, small).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'de'"), small)
    assert {r.lang_pred for r in language.identify(docs, one, small).collect()} == {"de", "und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    found = language.op11_language(spark, d).collect()
    assert len(found) == len(told)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == told[r.doc_id] for r in held) >= 0.97 * len(held)
