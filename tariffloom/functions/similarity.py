"""Similarity of short strings as Arrow functions: edit-based ratios over whole strings, tokens and parts (0 to 100)."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel counting over one big integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common / total length; two empty strings are equal."""
    total = len(a) + len(b)
    return 200.0 * common(a, b) / total if total else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_set(a: str, b: str) -> float:
    """The best of comparing shared tokens, and those with either side's rest; 100 if one side has no rest."""
    if not a.split() or not b.split():
        return 0.0
    shared, left, right = parts(a, b)
    if shared and (not left or not right):
        return 100.0
    one, two = (" ".join(x for x in (shared, rest) if x) for rest in (left, right))
    best = ratio(one, two)
    return max(best, ratio(shared, one), ratio(shared, two)) if shared else best


def partial(a: str, b: str) -> float:
    """The shorter string against every window of the longer one, also those cut by its ends."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    if short in long_:
        return 100.0
    n, best, letters = len(short), 0.0, set(short)
    for end in range(1, len(long_) + n):
        begin = max(0, end - n)
        window = long_[begin:end]
        edge = window[-1] if end <= len(long_) else window[0]
        if edge in letters and 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    if len(a) == len(b):
        n, (short, long_) = len(a), (b, a)
        best = max([best, *(ratio(short, long_[max(0, e - n) : e]) for e in range(1, 2 * n) if long_[max(0, e - n) : e])])
    return best


def partial_token(a: str, b: str) -> float:
    shared, left, right = parts(a, b)
    if shared:
        return 100.0
    sorted_ = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(sorted_, partial(left, right))


def weighted(a: str, b: str) -> float:
    """Whole and token ratios for lengths that differ less than one and a half times; beyond, partial ones count less."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    tokens = 0.95 * max(token_sort(a, b), token_set(a, b))
    if longer < 1.5:
        return max(ratio(a, b), tokens)
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_token(a, b))


@lru_cache(maxsize=200_000)
def fuzzy(a: str, b: str) -> float:
    """The matcher's score, 0 to 1."""
    return max(token_set(a, b), weighted(a, b)) / 100.0


@lru_cache(maxsize=200_000)
def search_base(a: str, b: str) -> float:
    return max(token_set(a, b), partial(a, b))


@F.pandas_udf(T.DoubleType())
def fuzzy_rounded(a: pd.Series, b: pd.Series) -> pd.Series:
    """fuzzy() to four places, rounded from its binary value."""
    return pd.Series([round(fuzzy(x or "", y or ""), 4) for x, y in zip(a, b)])
