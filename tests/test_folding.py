"""Compatibility forms against the Unicode data."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tariffloom.functions import folding, text


def folded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(4)
    return [r.f for r in rows.select("n", folding.compatible(F.col("t")).alias("f")).orderBy("n").collect()]


def test_every_letter(spark):
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    lines = ["|".join(letters[k : k + 400]) for k in range(0, len(letters), 400)]
    for line, found in zip(lines, folded(spark, lines)):
        if found != unicodedata.normalize("NFKC", line):
            assert [x for x in zip(line.split("|"), found.split("|")) if unicodedata.normalize("NFKC", x[0]) != x[1]] == []


@pytest.mark.parametrize("form", ["NFD", "NFKD"])
def test_composition(spark, form):
    words = ["Ёлка и йод", "ǖ Ǟ ấ ộ ữ", "café naïve Ångström", "Ӑӓ ѓ ќ ї", "Ａ１ ﬁ № ½ ㎏", "ァ ガ", None, "", "plain text – «x»"]
    decomposed = [None if w is None else unicodedata.normalize(form, w) for w in words]
    assert folded(spark, decomposed) == [None if w is None else unicodedata.normalize("NFKC", w) for w in decomposed]


def test_normalise(spark):
    rows = spark.createDataFrame([("ＯАК　№ ５",), ("йод Ёж ﬁn",), ("Узи – почек",)], "t string")
    assert [r.f for r in rows.select(text.normalise(F.col("t")).alias("f")).collect()] == ["oак no 5", "йод еж fin", "узи почек"]
