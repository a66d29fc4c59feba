"""Providers found or made, against taking documents one after another; groups of keys."""

import random
import re

import pytest

from tariffloom.operators import providers

DOCS, KNOWN = "document_id long, name string, bin string", "partner_id long, partner_name string, bin string"


def norm(name):
    return " ".join(re.findall(r"[a-z0-9Ѐ-ӿ]+", name.lower().replace("ё", "е")))


def number(text):
    digits = re.sub(r"\D", "", text or "")
    return digits if len(digits) == 12 else None


def one_by_one(docs, known):
    """Each document against all providers there are by then."""
    held = [{"id": i, "name": n, "bin": number(b)} for i, n, b in sorted(known)]
    base = max((h["id"] for h in held), default=0)
    out = {}
    for doc, name, bin_ in sorted(docs, key=lambda d: d[0]):
        b, called = number(bin_), (name or "").strip(" ") or providers.UNNAMED
        found = next((h for h in held if b and h["bin"] == b), None) or next((h for h in held if norm(called) and norm(h["name"]) == norm(called)), None)
        if found is None:
            found = {"id": base + 1 + doc, "name": called, "bin": None}
            held.append(found)
        found["bin"] = found["bin"] or b
        out[doc] = found["id"]
    return out, {h["id"]: h["name"] for h in held}


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one(spark, seed):
    draw = random.Random(seed)
    numbers = [None, "", "12", *(str(k) * 12 for k in range(1, 7)), "БИН 111-111-111-111"]
    names = ["Клиника А", " клиника а!", "Клиника Ё", "клиника е", "B", "c", None, "", "!!", "D 1", "D 2"]
    known = [(k, draw.choice([n for n in names if n]), draw.choice(numbers)) for k in range(1, draw.choice([1, 5]))]
    docs = [(3 * k, draw.choice(names), draw.choice(numbers)) for k in range(120)]
    draw.shuffle(docs)
    done, all_ = providers.resolve_or_create(spark.createDataFrame(docs, DOCS), spark.createDataFrame(known, KNOWN))
    ids, called = one_by_one(docs, known)
    assert {r.document_id: r.partner_id for r in done.collect()} == ids
    assert {r.partner_id: r.partner_name for r in all_.collect()} == called
    told = {r.document_id: r.by for r in done.collect()}
    assert [d for d in told if told[d] == "new"] and all((told[d] == "new") == (ids[d] == max([k for k, *_ in known], default=0) + 1 + d) for d in told)


def test_two_documents_of_one_new_provider(spark):
    known = spark.createDataFrame([(7, "Старая клиника", "1" * 12)], KNOWN)
    docs = [(1, "Новая клиника", None), (2, "НОВАЯ  клиника", "2" * 12), (3, None, "2" * 12), (4, "Старая клиника", "3" * 12), (5, "Иная", "3" * 12), (6, "Старая клиника", "3" * 12)]
    done, _ = providers.resolve_or_create(spark.createDataFrame(docs, DOCS), known)
    # 4 falls back to the name though that provider has another number; 5 then makes the number's own provider, which 6 finds
    assert {r.document_id: (r.partner_id, r.by) for r in done.collect()} == {1: (9, "new"), 2: (9, "name"), 3: (9, "bin"), 4: (7, "name"), 5: (13, "new"), 6: (13, "bin")}


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], KNOWN), spark.createDataFrame([(1, None, None), (2, None, None)], DOCS)
    done, made = providers.resolve_or_create(docs, none)
    assert {r.partner_id for r in done.collect()} == {2} and [(r.partner_id, r.partner_name) for r in made.collect()] == [(2, providers.UNNAMED)]
    done, made = providers.resolve_or_create(docs.limit(0), none)
    assert done.count() == 0 and made.count() == 0


def test_groups(spark):
    draw = random.Random(3)
    pairs = [(f"b{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(50)] + [(f"p{k}", f"p{k + 1}") for k in range(40)] + [("x", None), (None, "y"), (None, None)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        for v in (a, b):
            v is None or find(v)
        if a and b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.label for r in providers.groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert found == {v: find(v) for v in root}
