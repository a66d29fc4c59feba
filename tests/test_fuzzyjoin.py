"""The bounds of scores, and lists of best entries, against scoring every pair."""

import random

import numpy as np
import pytest

from tariffloom.functions.similarity import fuzzy
from tariffloom.operators import fuzzyjoin

WORDS = "анализ крови общий узи почек мрт мозга головного консультация врача прием первичный ab abc x 12 small ring bolt gizmo".split()


def made(seed, n, longest=6):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, longest))) for _ in range(n)]
    for k in range(0, n, 3):  # misspelt
        t = texts[k]
        at = draw.randrange(len(t))
        texts[k] = (t[:at] + draw.choice("абвxyz ") + t[at + 1 :]).strip() or "x"
    return [" ".join(t.split()) or "x" for t in texts]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_hold(seed):
    names, texts = made(seed, 80, 12), [*made(seed + 10, 80, 3), "zz", "x" * 90, "анализ", "анализ анализ анализ крови"]
    held = fuzzyjoin.Texts(texts)
    for name, bound in zip(names, held.bounds(names)):
        for text, limit in zip(texts, bound):
            assert fuzzy(name, text) <= limit + 1e-9, (name, text)


def brute(name, texts, top):
    best = {}
    for text, owner, called in texts:
        score = round(fuzzy(name, text), 4)
        best[owner] = max(best.get(owner, (-1, called)), (score, called))
    return [(o, s) for s, _, o in sorted(((-s, c, o) for o, (s, c) in best.items()))[:top]]


@pytest.mark.parametrize("block,slice_", [(20_000, 2_000), (25, 10)])
def test_lists_equal_all_pairs(spark, block, slice_):
    texts = made(5, 120)
    rows = [(t, k % 90, f"service {k % 90 % 7}") for k, t in enumerate(texts)] + [(None, 5, "service 5"), (texts[0], 3, "service 3")]
    names = [*made(6, 40), "zzzz", texts[4], None]
    found = fuzzyjoin.best_entries(spark.createDataFrame([(n,) for n in names], "norm string"), spark.createDataFrame(rows, "text string, owner long, owner_name string"), 5, block=block, slice_=slice_)
    lists = {}
    for r in sorted(found.collect(), key=lambda r: (-r.score, r.owner_name, r.owner)):
        lists.setdefault(r.norm, []).append((r.owner, -r.score))
    usable = [r for r in rows if r[0] is not None]
    assert set(lists) == {n for n in names if n}
    for name, got in lists.items():
        assert got == brute(name, usable, 5), name


def test_few_pairs_are_scored():
    texts = sorted(set(made(7, 3000, 5)))
    held, owners = fuzzyjoin.Texts(texts), [[(t, k)] for k, t in enumerate(texts)]
    names = [t[:3] + "x" + t[4:] for t in texts[:60] if len(t) > 12]
    scored = [n for _, _, n in fuzzyjoin.best_of(names, held, owners, 5)]
    assert np.mean(scored) < 0.15 * len(texts)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, owner long, owner_name string")
    names = spark.createDataFrame([("a b",)], "norm string")
    assert fuzzyjoin.best_entries(names, none, 5).count() == 0
    assert fuzzyjoin.best_entries(names.limit(0), spark.createDataFrame([("a", 1, "a")], none.schema), 5).count() == 0


def test_rematch_equals_a_full_match(spark):
    """After texts came, went and were renamed, and other names are asked."""
    schema = "text string, owner long, owner_name string"
    texts, names = made(21, 80), made(22, 30)
    old = [(t, k % 50, f"service {k % 50}") for k, t in enumerate(texts[:60])]
    new = [(t, o, "renamed" if o == 7 else c) for t, o, c in old if o % 9] + [(t, 100 + k, f"service {k}") for k, t in enumerate(texts[60:])] + [(texts[1], 11, "service 11"), (None, 1, "service 1")]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    asked = lambda some: frame([(n,) for n in some], "norm string")
    kept = fuzzyjoin.best_entries(asked(names[:25]), frame(old, schema), 5).cache()
    told = lambda found: sorted((r.norm, r.owner, r.owner_name, r.score) for r in found.collect())
    assert told(fuzzyjoin.rematched(kept, asked(names[3:]), frame(old, schema), frame(new, schema), 5)) == told(fuzzyjoin.best_entries(asked(names[3:]), frame(new, schema), 5))
    assert told(fuzzyjoin.rematched(kept, asked(names[:25]), frame(old, schema), frame(old, schema), 5)) == told(kept)
