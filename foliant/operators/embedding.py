"""Feature-hashed embeddings with layout features, and their sign signatures."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant import schemas
from foliant.functions import hashing
from foliant.functions.text import count_of

#: Words that a worker remembers, and the longest of them.
_MEMO_WORDS, _MEMO_CHARS = 100_000, 64
_WORD = re.compile(hashing.WORD)


def bucket_sums(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, bucket, weight): signed token weights by bucket, in twentieths, exact in any order. A text's tokens are summed where it is; only buckets are moved."""
    own = rows.select(*keys, F.explode(text_buckets(F.lower(F.col(text)))).alias("b"))
    return own.groupBy(*keys, F.pmod("b", F.lit(512)).cast("int").alias("bucket")).agg(F.sum(F.shiftright("b", 9)).alias("weight"))


def layout_features(text: Column, bbox: Column, page_ratio: Column, block_count: Column, line_count: Column, is_fallback: Column, n_tokens: Column) -> Column:
    n = F.length(text)
    share = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    flag = lambda word, value: F.when(F.contains(text, F.lit(word)), value).otherwise(0.0)
    parts = [
        bbox["x"], bbox["y"], bbox["width"], bbox["height"], page_ratio, F.least(n / 700, F.lit(1.0)), share(count_of(text, "[0-9]")), share(count_of(text, "[A-Z]")),
        F.least(F.coalesce(block_count, F.lit(0)) / 18, F.lit(1.0)), F.least(F.coalesce(line_count, F.lit(0)) / 32, F.lit(1.0)), F.when(is_fallback, 1.0).otherwise(0.0),
        flag("table", 0.7), flag("figure", 0.6), flag("%", 0.3), flag("$", 0.3), F.least(n_tokens / 64, F.lit(1.0)),
    ]
    finite = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.array(*[finite(p.cast("double")) for p in parts])


def _fnv(token: str) -> int:
    h = hashing.FNV_SEED
    for c in token:
        h = ((h ^ ord(c)) * hashing.FNV_PRIME) & hashing.MASK
    return h


def _slot(token: str) -> tuple[int, int]:
    weight = 28 if len(token) > 5 else 20 if len(token) > 3 else 13
    return _fnv(token) % schemas.TEXT_DIMS, weight if sum(ord(c) & 1 for c in token) & 1 else -weight


class _Slots:
    """(buckets, weights) of all tokens of a lower-cased text, a word and its trigrams at a time; words are remembered, from task to task of a worker."""

    def __init__(self) -> None:
        self.memo: dict[str, array] = {}

    def of(self, low: str | None) -> np.ndarray:
        out = array("i")
        for w in _WORD.findall(low or ""):
            if (s := self.memo.get(w)) is None:
                if len(self.memo) > _MEMO_WORDS:
                    self.memo.clear()
                tokens = [w, *(w[k : k + 3] for k in range(len(w) - 2))]
                s = array("i", [x for t in tokens for x in _slot(t)])
                if len(w) <= _MEMO_CHARS:
                    self.memo[w] = s
            out.extend(s)
        return np.frombuffer(out, np.int32).reshape(-1, 2) if out else np.empty((0, 2), np.int32)


_SLOTS = _Slots()


def slots_of(low: str | None) -> np.ndarray:
    return _SLOTS.of(low)


def text_buckets(low: Column) -> Column:
    """The buckets that a lower-cased text's tokens touch, with the sums of their weights, which may be 0: numbers of sum * 512 + bucket."""

    @F.pandas_udf("array<bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text in part:
                at = slots_of(text)
                sums = np.bincount(at[:, 0], at[:, 1], schemas.TEXT_DIMS).astype(np.int64)
                touched = np.flatnonzero(np.bincount(at[:, 0], minlength=schemas.TEXT_DIMS))
                out.append(sums[touched] * 512 + touched)
            yield pd.Series(out, dtype=object)

    return run(low)


def unit_vector(low: Column, layout: Column) -> Column:
    """The 368 signed bucket sums of a lower-cased text's tokens and the layout features, scaled to unit length.

    Narrow: one Arrow batch at a time, words' hashes memoised, so texts cross to Python and not their many tokens. Squares are summed from the first to the last.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part, features in parts:
            out = np.empty((len(part), schemas.EMBEDDING_DIMS), np.float32)
            for k, (text, own) in enumerate(zip(part, features, strict=True)):
                at = slots_of(text)
                raw = np.concatenate((np.bincount(at[:, 0], at[:, 1], schemas.TEXT_DIMS) / 20.0, np.asarray(own, np.float64)))
                n = np.sqrt(np.cumsum(raw * raw)[-1])
                out[k] = raw / n if n else raw
            yield pd.Series(list(out))

    # Not to be copied into filters and other columns: it runs once a row.
    return run.asNondeterministic()(low, layout)


def embed(rows: DataFrame, page_count: Column | None = None) -> DataFrame:
    """Add ``vector`` (384 floats of unit length) and ``signature`` (12 words of sign bits) to chunks.

    ``page_count`` may be a column; without it the page ratio is 0. Token weights are summed exactly, so a bucket whose
    tokens cancel is exactly 0 and counts as positive.
    """
    toks = rows.withColumn("_low", F.lower("text"))
    ratio = F.lit(0.0) if page_count is None else F.when(page_count > 0, F.col("page_number") / page_count).otherwise(0.0)
    layout = layout_features(F.col("text"), F.col("bbox"), ratio, F.col("block_count"), F.col("line_count"), F.col("is_fallback"), hashing.token_count(F.col("text")))
    out = toks.withColumn("vector", unit_vector(F.col("_low"), layout))
    return out.withColumn("signature", signature(F.col("vector"))).drop("_low")


def embed_queries(queries: DataFrame, text: str = "text") -> DataFrame:
    """Add ``vector``, ``signature`` and ``terms`` to (query_id, text)."""
    from foliant.operators.layout import box

    q = queries.withColumn("bbox", box(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(1.0))).withColumn("block_count", F.lit(0)).withColumn("line_count", F.lit(0)).withColumn("is_fallback", F.lit(False))
    q = embed(q if text == "text" else q.withColumn("text", F.col(text)))
    return q.withColumn("terms", hashing.query_terms(F.col(text))).drop("bbox", "block_count", "line_count", "is_fallback")


def signature(vector: Column, dims: int = schemas.EMBEDDING_DIMS) -> Column:
    from foliant.functions.vectors import pack_signature

    return pack_signature(vector, dims)


@lru_cache(4096)
def _projection(n: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the sign of each of ``n`` components, by hashes of its number: the same for all vectors of a length."""
    places, signs = np.empty(n, np.int64), np.empty(n)
    for i in range(n):
        h, g = seed & hashing.MASK, (seed + 1) & hashing.MASK
        for c in str(i):
            h = ((h ^ ord(c)) * hashing.FNV_PRIME) & hashing.MASK
            g = ((g ^ ord(c)) * hashing.FNV_PRIME) & hashing.MASK
        places[i], signs[i] = h % dims, 1 if g & 1 else -1
    return places, signs


def hash_project(vector: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A random projection by hashes of the component's number, scaled to unit length."""
    places, signs = _projection(len(vector), dims, seed)
    out = np.bincount(places, np.asarray(vector, np.float64) * signs, dims)  # added from the first to the last
    n = np.sqrt((out * out).sum())
    return (out / n if n * n >= 1e-12 else out).astype(np.float32)
