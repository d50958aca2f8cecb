"""Two-stage hybrid search: Hamming distance and keywords choose candidates, dot products rank them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from foliant.functions.hashing import keyword_overlap
from foliant.functions.text import snippet_for
from foliant.functions.vectors import dot, hamming

# Candidates per result, and what a keyword share counts in either stage.
OVERSAMPLE, PREFILTER_BOOST, RERANK_BOOST = 8, 12.0, 0.18
LIMIT = 6
#: Bytes of queries that are sent to every task; more are searched in parts.
MAX_QUERY_BYTES = 64_000_000
#: Queries that meet an Arrow batch of entries at a time, and bytes of a table of its texts' trigrams.
QUERIES_AT_A_TIME, MAX_TABLE_BYTES = 256, 32_000_000
#: What a token can have.
TOKEN_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_/.:-"
_SIGN = np.full(256, -1, np.int32)
_SIGN[list(TOKEN_SIGNS.encode())] = np.arange(len(TOKEN_SIGNS))


def prefilter_score(distance: Column, boost: Column) -> Column:
    return distance - F.lit(PREFILTER_BOOST) * boost


def _candidates(entries: DataFrame, queries: DataFrame, limit: int, order: list[str], keywords: bool) -> DataFrame:
    """Each query's ``8 * limit`` entries of least score, by their ``order`` columns. The queries are the broadcast side. Rows that are sorted
    hold numbers only; each query's rows are cut inside every task (without keywords: inside every batch) before any sort."""
    if keywords:
        scored = keyword_rows(entries, queries, OVERSAMPLE * limit, order)
    else:
        scored = near_rows(entries, queries, OVERSAMPLE * limit, order).withColumn("keyword_boost", F.lit(0.0))
    scored = scored.withColumn("score", prefilter_score(F.col("hamming"), F.col("keyword_boost")))
    ranked = scored.withColumn("candidate", F.row_number().over(Window.partitionBy("query_id").orderBy("score", *order)))
    return ranked.where(F.col("candidate") <= OVERSAMPLE * limit)


def _distances(signatures: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, rows) of arrays of words, and which rows have that many."""
    whole = np.array([s is not None and len(s) == words for s in signatures], bool)
    out = np.zeros((words, len(signatures)), np.int64)
    if whole.any():
        out[:, whole] = np.stack(signatures[whole]).T
    return out, whole


def near_rows(entries: DataFrame, queries: DataFrame, n: int, order: list[str]) -> DataFrame:
    """(query_id, order columns, hamming): of every Arrow batch of entries each query's ``n`` of least distance, ties by ``order``.

    These hold each query's ``n`` nearest of all, so a task never sorts or keeps more than a batch's pairs with a few queries, and of
    a batch ``n`` rows a query are left. ``queries``: query_id and q_signature, of a size that the caller has checked. As in a
    comparison of arrays, a pair of which one has no whole signature has no distance and comes first.
    """
    asked = queries.select("query_id", "q_signature").toPandas()
    sizes = {len(s) for s in asked["q_signature"] if s is not None}
    words = max(sizes, default=0)
    if len(sizes) > 1:  # no common width: pair by pair
        pairs = entries.select(*order, "signature").crossJoin(F.broadcast(queries))
        return pairs.select("query_id", *order, hamming(F.col("signature"), F.col("q_signature")).alias("hamming"))
    shared = entries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), *_distances(asked["q_signature"].to_numpy(), words)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q_words, q_whole = shared.value
        for part in parts:
            part = part.sort_values(order, na_position="first", ignore_index=True)
            own, whole = _distances(part["signature"].to_numpy(), words)
            rows, keep = len(part), min(n, len(part))
            for a in range(0, len(ids), QUERIES_AT_A_TIME):
                some = slice(a, a + QUERIES_AT_A_TIME)
                d = np.zeros((len(ids[some]), rows), np.int64)
                for k in range(words):
                    d += np.bitwise_count(q_words[k, some, None] ^ own[k])
                d[~q_whole[some]], d[:, ~whole] = -1, -1
                places = d * rows + np.arange(rows)  # by distance, then by order
                best = np.argpartition(places, keep - 1, axis=1)[:, :keep] if keep < rows else np.broadcast_to(np.arange(rows), d.shape)
                out = part[order].take(best.ravel()).reset_index(drop=True)
                out.insert(0, "query_id", np.repeat(ids[some], keep))
                got = np.take_along_axis(d, best, axis=1).ravel()
                out["hamming"] = pd.array(got, "Int32")
                out.loc[got < 0, "hamming"] = pd.NA
                yield out

    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), *[StructField(c, entries.schema[c].dataType) for c in order], StructField("hamming", IntegerType())])
    return entries.select(*order, "signature").mapInPandas(run, schema)


def _best(score: np.ndarray, rows: pd.DataFrame, order: list[str], n: int) -> pd.DataFrame:
    """Of each query's rows the ``n`` of least score, no score first, then by ``order``."""
    rows = rows.assign(_score=score).sort_values(["query", "_score", *order], na_position="first", ignore_index=True)
    return rows[rows.groupby("query").cumcount().to_numpy() < n].drop(columns="_score")


def keyword_rows(entries: DataFrame, queries: DataFrame, n: int, order: list[str]) -> DataFrame:
    """(query_id, order columns, hamming, keyword_boost): of every task's entries each query's ``n`` of least score, ties by ``order``.

    A keyword share lowers a score by ``PREFILTER_BOOST`` at most. So distances are counted for all pairs, and terms only where the distance
    less that is no worse than the ``n``-th best score so far: first the trigrams of terms, from one table of a batch's trigrams, and longer terms
    in the text itself where these still bring the score below, best first.
    ``queries``: query_id, q_signature, q_terms, of a size that the caller has checked. A pair of which one has no whole signature has no
    score and comes first; a null text has no term.
    """
    asked = queries.select("query_id", "q_signature", "q_terms").toPandas()
    sizes = {len(s) for s in asked["q_signature"] if s is not None}
    if len(sizes) > 1:  # no common width: pair by pair
        pairs = entries.select(*order, "signature", "text").crossJoin(F.broadcast(queries))
        return pairs.select("query_id", *order, hamming(F.col("signature"), F.col("q_signature")).alias("hamming"), keyword_overlap(F.col("q_terms"), F.col("text")).alias("keyword_boost"))
    words = max(sizes, default=0)
    vocabulary = Trigrams()
    terms = [_Terms(ts, vocabulary) for ts in asked["q_terms"]]
    shared = entries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), *_distances(asked["q_signature"].to_numpy(), words), terms, vocabulary))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q_words, q_whole, q_terms, known = shared.value
        best: list[list[float]] = [[] for _ in ids]  # the n best scores so far, negative, as a heap
        worst = np.full(len(ids), np.inf)  # the n-th of them

        def look(q: int, at: np.ndarray, distances: np.ndarray, found: np.ndarray, lows: list[str]) -> list[tuple[int, int, int, float]]:
            """(row, query, hamming, boost) of the rows that are no worse than the n-th best so far."""
            if not len(at):
                return []
            out, t, h = [], q_terms[q], distances[at].astype(np.int64)
            sure, maybe = t.counts(found, at)
            least = h - PREFILTER_BOOST * ((sure + maybe.sum(axis=0)) / t.size if t.size else 0.0)
            for k in np.argsort(least, kind="stable").tolist():
                if least[k] > worst[q]:
                    break
                boost = t.share(sure[k], maybe[:, k], lows[at[k]])
                score = int(h[k]) - PREFILTER_BOOST * boost
                if score > worst[q]:
                    continue
                out.append((int(at[k]), q, int(h[k]), boost))
                (heapq.heappush if len(best[q]) < n else heapq.heappushpop)(best[q], -score)
                if len(best[q]) == n:
                    worst[q] = -best[q][0]
            return out

        kept, fresh, waiting = None, [], 0
        rows_at_a_time = max(128, min(4096, MAX_TABLE_BYTES // max(1, len(known.places))))
        for part in (p.iloc[a : a + rows_at_a_time] for p in parts for a in range(0, len(p), rows_at_a_time)):
            part = part.sort_values(order, na_position="first", ignore_index=True)
            own, whole = _distances(part["signature"].to_numpy(), words)
            lows = ["" if x is None else x.lower() for x in part["text"]]
            found, own_rows = known.table(lows), []
            for a in range(0, len(ids), QUERIES_AT_A_TIME):
                some = slice(a, a + QUERIES_AT_A_TIME)
                d = np.zeros((len(ids[some]), len(part)), np.int16)
                for k in range(words):
                    d += np.bitwise_count(q_words[k, some, None] ^ own[k])
                d[~q_whole[some]], d[:, ~whole] = -1, -1
                for q, distances in enumerate(d, a):
                    at = np.flatnonzero(distances <= worst[q] + PREFILTER_BOOST)
                    none = at[distances[at] < 0][:n]  # the first by order: enough of them
                    own_rows += [(int(r), q, -1, 0.0) for r in none]
                    at = at[distances[at] >= 0]
                    if len(best[q]) < n < len(at):  # the nearest bring a bound for the others
                        first = np.argpartition(distances[at], n - 1)
                        own_rows += look(q, at[first[:n]], distances, found, lows)
                        at = at[first[n:]]
                        at = at[distances[at] <= worst[q] + PREFILTER_BOOST]
                    own_rows += look(q, at, distances, found, lows)
            if own_rows:
                at, of, far, boosts = zip(*own_rows, strict=True)
                fresh.append(part[order].take(at).assign(query=of, hamming=far, keyword_boost=boosts))
                waiting += len(own_rows)
            if waiting > max(n * len(ids), 10_000):
                kept, fresh, waiting = _least(kept, fresh, order, n), [], 0
        if fresh or kept is not None:
            kept = _least(kept, fresh, order, n).reset_index(drop=True)
            out = kept[order].copy()
            out.insert(0, "query_id", ids[kept["query"].to_numpy()])
            out["hamming"] = kept["hamming"].astype("Int32").mask(kept["hamming"] < 0)
            out["keyword_boost"] = kept["keyword_boost"].astype("float64")
            yield out

    columns = [StructField("query_id", queries.schema["query_id"].dataType), *[StructField(c, entries.schema[c].dataType) for c in order]]
    return entries.select(*order, "signature", "text").mapInPandas(run, StructType([*columns, StructField("hamming", IntegerType()), StructField("keyword_boost", DoubleType())]))


class Trigrams:
    """Places in a batch's table of trigrams of the signs that a token can have."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}

    def add(self, gram: str) -> int:
        return self.places.setdefault(gram, len(self.places))

    def table(self, lows: list[str]) -> np.ndarray:
        """(trigrams, texts): 1 where a lower-cased text has it."""
        out = np.zeros((len(self.places), len(lows)), np.uint8)
        by_code = np.full(len(TOKEN_SIGNS) ** 3 + 1, -1, np.int32)
        for gram, at in self.places.items():
            by_code[_code(*(TOKEN_SIGNS.index(c) for c in gram))] = at
        for k in range(0, len(lows), 256):
            data = [x.encode() for x in lows[k : k + 256]]
            flat = np.frombuffer(b"\n".join([*data, b"\n"]), np.uint8)
            sign = _SIGN[flat]
            known = sign >= 0
            places = np.where(known[:-2] & known[1:-1] & known[2:], by_code[_code(sign[:-2], sign[1:-1], sign[2:])], -1)
            hits = np.flatnonzero(places >= 0)
            of = np.repeat(np.arange(k, k + len(data), dtype=np.int32), [len(x) + 1 for x in data])
            out[places[hits], of[hits]] = 1
        return out


class _Terms:
    """A query's terms: trigrams, longer ones by their trigrams, and others, which only the text can tell."""

    def __init__(self, terms: list[str] | None, vocabulary: Trigrams):
        terms = [] if terms is None else list(terms)
        plain = [t for t in terms if t is not None and len(t) >= 3 and not set(t) - set(TOKEN_SIGNS)]
        self.size, self.short = len(terms), np.array([vocabulary.add(t) for t in plain if len(t) == 3], np.int64)
        self.long = [t for t in plain if len(t) > 3]
        self.other = [t for t in terms if t is not None and (len(t) < 3 or set(t) - set(TOKEN_SIGNS))]
        grams = [[vocabulary.add(t[k : k + 3]) for k in range(len(t) - 2)] for t in self.long]
        self.grams, self.starts = np.array([g for own in grams for g in own], np.int64), np.cumsum([0, *map(len, grams[:-1])])

    def counts(self, found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some texts the number of trigram terms they have, and (terms, texts) whether they may have the others."""
        sure = found[self.short[:, None], at].sum(axis=0, dtype=np.int64)
        maybe = np.ones((len(self.long) + len(self.other), len(at)), np.bool_)
        if self.long:
            maybe[: len(self.long)] = np.minimum.reduceat(found[self.grams[:, None], at], self.starts, axis=0)
        return sure, maybe

    def share(self, sure: int, maybe: np.ndarray, low: str) -> float:
        rest = self.long + self.other
        return (int(sure) + sum(rest[k] in low for k in np.flatnonzero(maybe))) / self.size if self.size else 0.0


def _code(a, b, c):
    return (a * len(TOKEN_SIGNS) + b) * len(TOKEN_SIGNS) + c


def _least(kept: pd.DataFrame | None, fresh: list[pd.DataFrame], order: list[str], n: int) -> pd.DataFrame:
    rows = pd.concat([*([] if kept is None else [kept]), *fresh], ignore_index=True)
    score = np.where(rows["hamming"] < 0, np.nan, rows["hamming"] - PREFILTER_BOOST * rows["keyword_boost"])
    return _best(score, rows, order, n)


def candidates(entries: DataFrame, queries: DataFrame, *, limit: int = LIMIT, order: list[str] | None = None) -> DataFrame:
    """The first stage alone, without keywords: each query's ``8 * limit`` nearest signatures."""
    q = queries.select("query_id", F.col("signature").alias("q_signature"))
    return _in_parts(entries, q, limit, order or ["doc_id", "page_number", "chunk_ord"], False)


def _in_parts(entries: DataFrame, q: DataFrame, limit: int, order: list[str], keywords: bool) -> DataFrame:
    """Measure the queries first; beyond what may be broadcast they meet the entries part by part."""
    found = [_candidates(entries, part, limit, order, keywords) for part in query_parts(q.select("query_id", "q_signature", *(["q_terms"] if keywords else [])))]
    return reduce(DataFrame.unionByName, found)


def query_parts(q: DataFrame) -> list[DataFrame]:
    """Queries (query_id, q_signature and maybe q_terms) in parts that may be sent to every task: one unless they are large."""
    width = F.size("q_signature") * 8 + 8
    if "q_terms" in q.columns:
        width = width + F.aggregate("q_terms", F.lit(0), lambda s, t: s + F.length(t) + 16)
    size = q.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // MAX_QUERY_BYTES))
    return [q] if parts == 1 else [q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k) for k in range(parts)]


def broadcastable(rows: DataFrame, text: Column | str | None = None) -> DataFrame:
    """Rows for the small side of a join with every row: broadcast after a check of their size, else left to the engine."""
    size = F.length(text) if text is not None else F.lit(64)
    n = rows.agg(F.coalesce(F.sum(size + 64), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(rows) if n <= MAX_QUERY_BYTES else rows


def search(entries: DataFrame, queries: DataFrame, *, limit: int = LIMIT, order: list[str] | None = None, per_document: bool = False) -> DataFrame:
    """The ``limit`` best entries of each query, ranked from 1.

    ``entries``: vector, signature, the ``order`` columns (their document order, which breaks ties and tells them apart) and, for keywords, text.
    They are read twice, so they should come from a table: first narrow, then the few candidates with all their columns.
    ``queries``: query_id, vector, signature and, for keywords, terms (with doc_id if ``per_document``: then each
    query searches that document only, a plain join). Queries to be matched with all entries are measured first and
    searched in parts if they are large.
    """
    order = order or ["doc_id", "page_number", "chunk_ord"]
    keywords = "terms" in queries.columns and "text" in entries.columns
    q = queries.select("query_id", F.col("vector").alias("q_vector"), F.col("signature").alias("q_signature"), *([F.col("terms").alias("q_terms")] if keywords else []), *([F.col("doc_id").alias("q_doc")] if per_document else []))
    if per_document:
        pairs = entries.join(q, F.col("doc_id") == F.col("q_doc"))
        boost = keyword_overlap(F.col("q_terms"), F.col("text")) if keywords else F.lit(0.0)
        scored = pairs.withColumn("hamming", hamming(F.col("signature"), F.col("q_signature"))).withColumn("keyword_boost", boost)
        scored = scored.withColumn("score", prefilter_score(F.col("hamming"), F.col("keyword_boost")))
        found = scored.withColumn("candidate", F.row_number().over(Window.partitionBy("query_id").orderBy("score", *order))).where(F.col("candidate") <= OVERSAMPLE * limit).drop("q_doc")
    else:
        return rerank(entries, _in_parts(entries, q, limit, order, keywords), queries, limit=limit, order=order)
    return _ranked(found, limit)


def first_stage(entries: DataFrame, queries: DataFrame, *, limit: int = LIMIT, order: list[str] | None = None) -> DataFrame:
    """Each query's ``8 * limit`` candidates by distance and keywords: query_id, the ``order`` columns, hamming, keyword_boost, score and candidate."""
    q = queries.select("query_id", F.col("signature").alias("q_signature"), F.col("terms").alias("q_terms"))
    return _in_parts(entries, q, limit, order or ["doc_id", "page_number", "chunk_ord"], True)


def rerank(entries: DataFrame, found: DataFrame, queries: DataFrame, *, limit: int = LIMIT, order: list[str] | None = None) -> DataFrame:
    """The ``limit`` best of each query's candidates by dot products, with the columns of their entries."""
    pairs = entries.join(found, order or ["doc_id", "page_number", "chunk_ord"]).join(queries.select("query_id", F.col("vector").alias("q_vector")), "query_id")
    return _ranked(pairs, limit)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    similarity = dot(F.col("vector"), F.col("q_vector")) + F.lit(RERANK_BOOST) * F.col("keyword_boost")
    ranked = found.withColumn("similarity", similarity).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate")))
    return ranked.where(F.col("rank") <= limit).drop("q_vector", "q_signature", "q_terms")


def search_one(entries: DataFrame, vector: list[float], signature: list[int], *, limit: int = LIMIT, order: list[str] | None = None) -> DataFrame:
    """One query as literals: two top-k selections, no join."""
    order = order or ["doc_id", "page_number", "chunk_ord"]
    sig, vec = F.array(*[F.lit(int(x)).cast("long") for x in signature]), F.array(*[F.lit(float(x)) for x in vector])
    near = entries.withColumn("hamming", hamming(F.col("signature"), sig)).orderBy("hamming", *order).limit(OVERSAMPLE * limit)
    return near.withColumn("similarity", dot(F.col("vector"), vec)).orderBy(F.desc("similarity"), "hamming", *order).limit(limit)


def search_texts(chunk_rows: DataFrame, queries: DataFrame, *, limit: int = LIMIT, per_document: bool = False) -> DataFrame:
    """``search`` for embedded text queries, with a snippet around the query."""
    return with_snippets(search(chunk_rows, queries, limit=limit, per_document=per_document), queries)


def with_snippets(hits: DataFrame, queries: DataFrame) -> DataFrame:
    named = queries.select("query_id", F.col("text").alias("query_text"))
    return hits.join(named, "query_id").withColumn("snippet", snippet_for(F.col("text"), F.col("query_text")))


def open_chunk(chunk_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, id) to page and box; null where there is none."""
    return wanted.join(chunk_rows.select("doc_id", "id", "page_number", "bbox"), ["doc_id", "id"], "left")


def peek_page(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page_number) to the page's summary; null where there is none."""
    return wanted.join(pages.select("doc_id", "page_number", "summary"), ["doc_id", "page_number"], "left")


def open_page(wanted: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Page numbers clamped to the pages there are."""
    return wanted.join(page_counts, "doc_id").withColumn("page_number", F.greatest(F.lit(1), F.least("page_number", "page_count")))


def describe_tools(spark) -> DataFrame:
    rows = [("search", "Search the chunks for passages about a query."), ("openPage", "Open a page, with a box to look at if one is given."), ("openChunk", "Open the place of a chunk by its id."), ("peekPage", "Give the summary of a page.")]
    return spark.createDataFrame(rows, "name string, description string")
