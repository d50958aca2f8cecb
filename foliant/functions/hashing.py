"""Tokens and 32-bit FNV-1a hashes, with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FNV_SEED, FNV_PRIME, SIGN_SEED, MASK = 2166136261, 16777619, 1469598103, 0xFFFFFFFF
WORD = r"[a-z0-9][a-z0-9_/.:-]+"


def fnv1a(text: Column, seed: int | Column = FNV_SEED) -> Column:
    """32-bit FNV-1a over code points (over UTF-16 units for text beyond the basic plane it differs)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = seed if isinstance(seed, Column) else F.lit(seed)
    return F.aggregate(codes, start.cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def tokens(text: Column) -> Column:
    """Words of two characters or more, then the trigrams of words of three or more; duplicates stay."""
    found = words(text)
    grams = F.flatten(F.transform(F.filter(found, lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))))
    return F.concat(found, grams)


def token_count(text: Column) -> Column:
    """The size of ``tokens``, without making them; null for a null text, as ``size`` of null in the functions API."""
    return F.aggregate(words(text), F.lit(0), lambda s, w: s + 1 + F.greatest(F.length(w) - 2, F.lit(0)))


def query_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2))


def is_positive(token: Column) -> Column:
    """The sign hash is even exactly if an odd number of the token's codes are odd (its seed is odd, as is the prime)."""
    return F.pmod(F.length(F.regexp_replace(token, "[^13579acegikmoqsuwy_/-]", "")), F.lit(2)) == 1


def token_weight(token: Column) -> Column:
    """Weights in twentieths (1.4, 1 and 0.65), so that sums are exact in any order."""
    return F.when(F.length(token) > 5, 28).when(F.length(token) > 3, 20).otherwise(13)


def keyword_overlap(terms: Column, text: Column) -> Column:
    """The share of the terms that the lower-cased text contains; the text is lower-cased once."""
    from foliant.functions.vectors import let

    share = let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))
    return F.when(F.size(terms) > 0, share).otherwise(F.lit(0.0))
