"""Similarities of texts and vectors (SIM, NUM5): built-in expressions, and Arrow-batched kernels where none exists."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chorale.functions.text import col

FUZZY_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "feat", "ft"]


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def token_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the words, with up to 0.2 for words at the same places, 1 at most."""
    x, y = _words(col(a)), _words(col(b))
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    j = jaccard(x, y)
    bonus = F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), F.least(same / F.greatest(F.size(x), F.lit(1)) * 0.2, F.lit(1.0) - j)).otherwise(0.0)
    return j + bonus


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def release_similarity(a: Column | str, b: Column | str, artist: bool = False) -> Column:
    """Edit distance with word coverage (artists) or with words and containment (titles); words in brackets don't count."""
    x, y = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    cx, cy = (F.trim(F.regexp_replace(t, r"(?U)\s*\([^)]*\)", "")) for t in (x, y))
    wx, wy = F.array_distinct(_words(cx)), F.array_distinct(_words(cy))
    words = jaccard(wx, wy)
    if artist:
        near = lambda q: F.exists(wy, lambda r: F.lit(1.0) - F.levenshtein(q, r) / F.greatest(F.length(q), F.length(r)) >= 0.8)
        score = edit_similarity(x, y) * 0.5 + F.when(F.size(wx) > 0, F.size(F.filter(wx, near)) / F.greatest(F.size(wx), F.lit(1))).otherwise(0.0) * 0.4 + words * 0.1
    else:
        short, long = F.least(F.length(cx), F.length(cy)), F.greatest(F.length(cx), F.length(cy))
        within = F.when((short >= 3) & (cx.contains(cy) | cy.contains(cx)), short / F.greatest(long, F.lit(1))).otherwise(0.0)
        score = edit_similarity(x, y) * 0.6 + words * 0.25 + within * 0.15
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.least(F.lit(1.0), score))


def words_match(a: Column | str, b: Column | str, least: float = 0.7) -> Column:
    clean = lambda c: F.array_distinct(F.filter(_words(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w\s]", "")), lambda w: ~w.isin(FUZZY_STOP_WORDS)))
    return jaccard(clean(a), clean(b)) >= least


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of numbers; 0 if one has no length."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler similarity from its published definition: prefix of four at most, weight 0.1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _kernel(one):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, DoubleType())


def ratcliff(a: Column | str, b: Column | str) -> Column:
    """Twice the matching characters over all; the order of the two matters."""
    return _kernel(lambda x, y: SequenceMatcher(None, x, y).ratio())(col(a), col(b))


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return _kernel(jaro_winkler_of)(col(a), col(b))


def mixed_similarity(a: Column | str, b: Column | str) -> Column:
    """Weighted mean of the sequence, Jaro-Winkler, edit and word similarities of two normal names."""
    a, b = col(a), col(b)
    parts = ratcliff(a, b) * 0.3 + jaro_winkler(a, b) * 0.4 + edit_similarity(a, b) * 0.2
    spaced = a.contains(" ") | b.contains(" ")
    return F.when((a == "") | (b == ""), 0.0).when(F.lower(a) == F.lower(b), 1.0).when(spaced, parts + token_similarity(a, b) * 0.1).otherwise(parts / 0.9)


