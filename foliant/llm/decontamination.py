"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import HOT_PARTS, bitmap, checkpoint

WINDOW = 13
#: Shingles that are broadcast as they are (at most 64 bytes each here); beyond it a bit map of fixed size goes out.
MAX_SHINGLES = 200_000
MAX_SHINGLE_BYTES = 16_000_000
#: A shingle that occurs more often than this is hot.
HOT_SHINGLE = 10_000

#: What words are made of. Digits, letters (lower-cased) and every byte from 0x80.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Members:
    """Which byte strings may be shingles: an exact set, or bits of their checksums (then with false alarms)."""

    def __init__(self, items: list[bytes] | None, bits: bytes | None = None):
        self.items, self.bits = frozenset(items) if items is not None else None, bits

    def found(self, candidates: list[bytes]) -> list[int]:
        if self.items is not None:
            known = self.items
            return [k for k, c in enumerate(candidates) if c in known]
        bits, crc, last = self.bits, zlib.crc32, len(self.bits) * 8 - 1
        return [k for k, c in enumerate(candidates) if bits[(h := crc(c) & last) >> 3] >> (h & 7) & 1]


def members(shingles: DataFrame) -> Members:
    """Send out the one column ``shingle`` of distinct strings after checking its size."""
    n, size = shingles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("shingle")), F.lit(0))).first()
    if n <= MAX_SHINGLES and size <= MAX_SHINGLE_BYTES:
        return Members([bytes(r["shingle"]) for r in shingles.collect()])
    return Members(None, bitmap(shingles.select(F.crc32("shingle").alias("crc")), "crc", n))


def windows(items: DataFrame, *, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, words, spots): each item's windows; spots are (offset, shingle) of its word pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ws = words(t.as_py())
                n = min(size, len(ws))
                out = [ws[k : k + n] for k in range(len(ws) - n + 1)] if n else []
                spots = [[{"offset": k, "shingle": b" ".join(w[k : k + 2])} for k in range(max(1, len(w) - 1))] for w in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(out), pa.int64()), pa.array([b" ".join(w) for w in out], pa.binary()), pa.array([len(w) for w in out], pa.int32()), pa.array(spots, pa.list_(pa.struct([("offset", pa.int32()), ("shingle", pa.binary())])))],
                    names=["item_id", "window", "n", "spots"],
                )

    named = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
    return named.mapInArrow(run, "item_id long, window binary, n int, spots array<struct<offset:int,shingle:binary>>")


def shingle_counts(docs: DataFrame, known: Members, text: str = "text") -> DataFrame:
    """How often each known shingle occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                ws = words(t.as_py())
                pairs = [a + b" " + b for a, b in zip(ws, ws[1:], strict=False)]
                counts.update(pairs[k] for k in known.found(pairs))
            if len(counts) > MAX_SHINGLES:
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
                counts.clear()
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, known: Members, hot: Members, spread: int, singles: bool, key: str, text: str, size: int) -> DataFrame:
    """One row a document: its number of words and, at each known shingle, the words around it.

    A hot shingle's places are dealt to ``spread`` salts, in turn; all others have salt 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            n_words, spots = [], []
            for t in batch.column(1):
                ws = words(t.as_py())
                pairs = [a + b" " + b for a, b in zip(ws, ws[1:], strict=False)]
                at = [(k, pairs[k]) for k in known.found(pairs)]
                if singles:
                    at += [(k, ws[k]) for k in known.found(ws)]
                n_words.append(len(ws))
                salts = [0] * len(at)
                for k in hot.found([s for _, s in at]):
                    salts[k] = turn = (turn + 1) % spread
                spots.append([{"salt": salt, "pos": k, "shingle": s, "before": b" ".join(ws[max(0, k - size + 1) : k]), "after": b" ".join(ws[k : k + size]), "left": min(k, size - 1), "right": min(size, len(ws) - k)} for salt, (k, s) in zip(salts, at, strict=True)])
            kind = pa.list_(pa.struct([("salt", pa.int32()), ("pos", pa.int32()), ("shingle", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("left", pa.int32()), ("right", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spots, kind)], names=["doc_id", "n_words", "spots"])

    kind = "doc_id long, n_words long, spots array<struct<salt:int,pos:int,shingle:binary,before:binary,after:binary,left:int,right:int>>"
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, kind)


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences whose words are the window's, word for word."""
    for p in parts:
        ok = []
        for before, after, offset, window in zip(p["before"], p["after"], p["offset"], p["window"], strict=True):
            head = bytes(before).split()
            around = head + bytes(after).split()
            w, first = bytes(window).split(), len(head) - offset
            ok.append(around[first : first + len(w)] == w)
        hit = p[ok]
        yield pd.DataFrame({"row": hit["row"], "start": (hit["pos"] - hit["offset"]).astype("int64"), "n": hit["n"].astype("int64"), "wid": hit["wid"]})


def owned(occurrences: DataFrame, owners: DataFrame, spread: int) -> DataFrame:
    """Occurrences (row, start, n, wid) with the items of their window (wid, item_id).

    A window in more than a thousandth of all occurrences is hot: fewer than a thousand are, so their names go to all tasks; their
    occurrences are dealt to ``spread`` salts, their items copied to each.
    """
    counts = occurrences.groupBy("wid").agg(F.count(F.lit(1)).alias("times"))
    hot = F.broadcast(counts.where(F.col("times") * HOT_PARTS > occurrences.count()).select("wid", F.lit(spread).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = occurrences.join(hot, "wid", "left").withColumn("salt", F.pmod(F.xxhash64("row", "start"), parts).cast("int")).drop("parts")
    copied = owners.join(hot, "wid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, ["wid", "salt"]).drop("salt")


def hits(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, spread: int = 64) -> DataFrame:
    """Per document: the words that lie in an occurrence of an item's window, and the items found.

    Returns ``doc_id``, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and
    20 * n_hit >= n_words).

    A window occurs only where each of its word pairs does, so one pair finds it: the rarest by
    counts over all documents (a first pass). Documents give up the words around known pairs; these meet
    the windows in a join on the pair, bounds on length and position go first, words are compared last.

    * Null and wordless texts have no words and are clean; null or wordless items have no windows.
    * An item of fewer words than ``size`` is one window; a single word is its own shingle.
    * Items with a null id cannot be named and take no part.
    * Items with equal windows each count; repeated items count once an item_id. Rows that repeat a
      document are judged by themselves. Empty tables on either side are fine; other columns are ignored.

    What is sent to all tasks is a set of checked size, or beyond that a bit map of fixed size, which
    lets more words through but loses none. Hot pairs are spread over ``spread`` salted copies of their windows, and so are
    hot windows over copies of their items.
    """
    wins = checkpoint(windows(items, item=item, text=item_text, size=size).dropDuplicates(["item_id", "window"]))
    spots = wins.select("window", "n", F.explode("spots").alias("s")).select("window", "n", "s.offset", "s.shingle").distinct()
    counts = checkpoint(shingle_counts(docs, members(spots.select("shingle").distinct()), text))
    ranked = spots.join(counts.withColumnRenamed("n", "often"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = checkpoint(ranked.groupBy("window", "n").agg(F.min(F.struct("often", "shingle", "offset")).alias("rare")).select("window", "n", "rare.shingle", "rare.offset", "rare.often", F.monotonically_increasing_id().alias("wid")))
    chosen = prefix.select("shingle").distinct()
    singles = bool(prefix.where("n = 1").take(1))
    hot = members(prefix.where(F.col("often") > HOT_SHINGLE).select("shingle").distinct())
    rows = checkpoint(candidates(docs, members(chosen), hot, spread, singles, key, text, size).withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", F.explode("spots").alias("s")).select("row", "s.*")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salted = np.zeros(batch.num_rows, np.int32)
            salted[hot.found(batch.column(1).to_pylist())] = 1
            at = np.repeat(np.arange(batch.num_rows), np.where(salted, spread, 1))
            salt = np.arange(len(at)) - np.searchsorted(at, at)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns], pa.array(salt.astype(np.int32))], names=["n", "shingle", "offset", "window", "wid", "salt"])

    # The same test as for the places decides which windows get a copy for each salt.
    salted = prefix.select("n", "shingle", "offset", "window", "wid").mapInArrow(dealt, "n int, shingle binary, offset int, window binary, wid long, salt int")
    met = found.join(salted, ["shingle", "salt"]).where((F.col("offset") <= F.col("left")) & (F.col("n") - F.col("offset") <= F.col("right")))
    # Words are compared before anything is gathered by window.
    occurrences = checkpoint(met.select("row", "pos", "before", "after", "offset", "window", "n", "wid").mapInPandas(_verify, "row long, start long, n long, wid long"))
    at = owned(occurrences, wins.select("item_id", "window").join(prefix.select("window", "wid"), "window").select("wid", "item_id"), spread)
    # Words covered: what each occurrence adds behind the farthest end before it.
    spans = occurrences.select("row", "start", "n").distinct().withColumn("end", F.col("start") + F.col("n"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    added = spans.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("added", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before")))
    covered = added.groupBy("row").agg(F.sum("added").alias("n_hit"))
    named = at.select("row", "item_id").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("names"))
    out = rows.select("row", "doc_id", "n_words").join(covered, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc_id").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "row",
    )


def decontaminate(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, unchanged, with all their columns, whatever their names.

    Rows are told apart by key and text, so repeated rows go or stay together. Null and empty texts are clean; a null key
    is a key. Empty documents give an empty result, and an empty benchmark keeps all.
    """
    digest = F.xxhash64(F.coalesce(docs[key].cast("long"), F.lit(-(2**63))), docs[text])
    slim = docs.select(digest.alias("digest"), docs[text].alias("text"))
    bad = hits(slim, items, key="digest", text="text", **options).where("contaminated").select(F.col("digest").alias("bad")).distinct()
    bad = checkpoint(bad)
    return docs.join(bad, digest == bad["bad"], "left_anti")
