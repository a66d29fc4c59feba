"""Unicode compatibility forms folded (NFKC) by built-in functions, from tables made of the Unicode data when they are first used."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and marks of usual texts that stay as they are: such texts are told by one pass and left alone.
USUAL = r"\x00-\x7FÀ-ÖØ-öø-ÿЀ-ӿ–—‘’“-„«»₸"
BETWEEN, ENDS = "\u0001", "\u0002"  # part the entries of a table


@lru_cache(1)
def tables() -> tuple[str, str, str, str, str]:
    """Letters with what one letter each becomes; the entries of those that become more or none, and a class of these; and the
    pairs that are composed, each with its composition, inner ones first. Hangul is left to its own rule."""
    one, by, more, pairs = [], [], [], []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        folded = unicodedata.normalize("NFKC", c)
        if folded != c:
            if len(folded) == 1:
                one.append(c)
                by.append(folded)
            else:
                more.append((c, folded))
        whole = unicodedata.decomposition(c)
        if whole and "<" not in whole and len(whole.split()) == 2 and unicodedata.normalize("NFC", c) == c:
            pairs.append((len(unicodedata.normalize("NFD", c)), c, "".join(chr(int(x, 16)) for x in whole.split())))
    return "".join(one), "".join(by), BETWEEN.join(f"{c}{ENDS}{f}" for c, f in more), "".join(f"\\x{{{ord(c):X}}}" for c, _ in more), BETWEEN.join(f"{c}{pair}" for _, c, pair in sorted(pairs))


def let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def compatible(text: Column) -> Column:
    """text in its compatibility form: single letters by translate(), letters that become several by a table, and where there are
    combining marks, pairs of a letter and a mark composed. Marks of one letter are expected in canonical order, and
    conjoining Hangul is left as it is. Null is null."""
    one, by, more, class_, pairs = tables()

    def spelled(t: Column) -> Column:
        known = F.str_to_map(F.lit(more), F.lit(BETWEEN), F.lit(ENDS))
        return F.when(t.rlike(f"[{class_}]"), F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")).otherwise(t)

    def composed(t: Column) -> Column:
        step = lambda done, p: F.replace(done, F.substring(p, 2, F.lit(2)), F.substring(p, 1, F.lit(1)))
        return F.when(t.rlike(r"\p{M}"), F.aggregate(F.split(F.lit(pairs), BETWEEN), t, step)).otherwise(t)

    return F.when(text.rlike(f"[^{USUAL}]"), let(let(F.translate(text, one, by), spelled), composed)).otherwise(text)
