"""SimHash near-duplicates: tiled exact comparison of fingerprints and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, join_hot

#: Fingerprints of a block; a task compares two blocks.
BLOCK = 16_384
#: Rows and columns of a tile that is compared at once (4 MB of exclusive-ors).
TILE_ROWS, TILE_COLS = 128, 4096


def fingerprint(text: bytes | None, *, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= width:
        digests = [xxhash.xxh64_digest(buf, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashed = xxhash.xxh64_digest
        digests = [hashed(buf[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65_536):
        raw = np.frombuffer(b"".join(digests[at : at + 65_536]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, width=width, seed=seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked to it here) for two blocks, or one with itself.

    Blocks are sorted by population count, so a tile pair whose counts differ beyond the radius is
    skipped. Links that join nothing new are dropped at once: what is kept is at most one a fingerprint.
    """
    both = left if right is None else np.concatenate((left, right))
    both = both[np.argsort(np.bitwise_count(both), kind="stable")] if right is None else both
    if right is None:
        left = right = both
        shift = 0
    else:
        left = left[np.argsort(np.bitwise_count(left), kind="stable")]
        right = right[np.argsort(np.bitwise_count(right), kind="stable")]
        both, shift = np.concatenate((left, right)), len(left)
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts_l, counts_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for r in range(0, len(left), TILE_ROWS):
        rows, low, high = left[r : r + TILE_ROWS], counts_l[r], counts_l[min(r + TILE_ROWS, len(left)) - 1]
        first = max(np.searchsorted(counts_r, low - radius), 0 if shift else r)
        last = np.searchsorted(counts_r, high + radius, side="right")
        for c in range(first, last, TILE_COLS):
            cols = right[c : min(c + TILE_COLS, last)]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ cols[None, :]) <= radius)
            i, j = i + r, j + c + shift
            new = i != j
            i, j = i[new], j[new]
            while len(i):  # join by the first link of each tree at a time; links inside a tree go
                for a, b in zip(i[:512].tolist(), j[:512].tolist(), strict=True):
                    a, b = root(a), root(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                i, j = i[512:], j[512:]
                if len(i):
                    for _ in range(64):
                        flat = parent[parent]
                        if np.array_equal(flat, parent):
                            break
                        parent[:] = flat
                    apart = parent[i] != parent[j]
                    i, j = i[apart], j[apart]
    roots = np.array([root(k) for k in range(len(both))], dtype=np.int64)
    joined = np.flatnonzero(np.bincount(roots, minlength=len(both))[roots] > 1)
    signed = both.view(np.int64)
    least = pd.Series(signed[joined]).groupby(roots[joined]).transform("min").to_numpy()
    keep = signed[joined] != least
    return signed[joined][keep], least[keep]


def links(distinct: DataFrame, *, radius: int = 4) -> DataFrame:
    """(a, b), b < a: links among distinct fingerprints that leave the components as all links would.

    Fingerprints are dealt by population count, and by hash within a count, into blocks of about
    BLOCK. Two blocks meet in one task if their counts are within the radius; others are never paired.
    """
    counted = distinct.withColumn("ones", F.bit_count("fp"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    spread = {c: -(-n // BLOCK) for c, n in sizes.items()}
    first, total = {}, 0
    for c in sorted(spread):
        first[c], total = total, total + spread[c]
    if not total:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for c in sorted(d) for x in (int(c), int(d[c]))]), F.col("ones"))
    block = of(first) + F.pmod(F.xxhash64("fp"), of(spread))
    # The blocks it meets: all of the counts within the radius; a pair is named by its smaller block first.
    near = {c: (min(first[x] for x in spread if abs(x - c) <= radius), max(first[x] + spread[x] for x in spread if abs(x - c) <= radius) - 1) for c in spread}
    low, high = of({c: v[0] for c, v in near.items()}), of({c: v[1] for c, v in near.items()})
    dealt = counted.withColumn("block", block).withColumn("other", F.explode(F.sequence(low, high)))
    dealt = dealt.select("fp", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).alias("second"))

    def compare(group: pa.Table) -> pa.Table:
        fps, second = group.column("fp").to_numpy().view(np.uint64), group.column("second").to_numpy(zero_copy_only=False)
        a, b = forest(fps[~second], fps[second] if group.column("p")[0] != group.column("q")[0] else None, radius)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("p", "q").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with links.

    Alternates large-star and small-star steps until the edges stop changing; both keep at most one
    row an edge, and every step is a grouped minimum and a join, so a hub is split by the engine.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
        edges = checkpoint(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Each document's fingerprint and the smallest key of the documents linked to it, directly or not.

    Returns ``doc_id``, fingerprint (16 hex digits) and component_id.

    * Null, empty and blank texts have fingerprint zero and link like any other.
    * Rows that repeat a key are documents of their own; an empty table gives an empty result.
    * Equal fingerprints are compared once, whatever their number; other columns are ignored.
    """
    fps = checkpoint(fingerprints(docs, key=key, text=text, width=width, seed=seed))
    return with_components(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_components(fps: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp, component_id) of checkpointed (doc_id, fp)."""
    firsts = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("times")))
    total = firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    roots = components(links(firsts.select("fp"), radius=radius))
    rooted = checkpoint(firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", "times", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpoint(rooted.join(smallest, "root").select("fp", "component_id", "times"))
    # Copies share a fingerprint: hot ones are sent out rather than gathered.
    return join_hot(fps, named, ["fp"], "times", total).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """The documents without near-duplicates of a smaller key: one of each component stays, unchanged.

    Where several rows share the smallest key, the one of them with the smallest fingerprint stays,
    and of rows alike in both, one. Rows with a null key are compared as a key below all others.
    """
    fps = checkpoint(fingerprints(docs, key=key, text=text, width=width, seed=seed).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))))
    named = with_components(fps, radius)
    kept = named.where("doc_id = component_id").groupBy("component_id").agg(F.min("fp").alias("fp")).withColumnRenamed("component_id", "keep_id")
    rows = fps.groupBy(F.col("doc_id").alias("keep_id")).agg(F.count(F.lit(1)).alias("n"))
    kept = checkpoint(kept.join(rows, "keep_id"))
    own = F.coalesce(docs[key].cast("long"), F.lit(-(2**63)))
    alone = kept.where("n = 1").select("keep_id")
    single = docs.join(alone, own == alone["keep_id"], "left_semi")
    repeated = kept.where("n > 1").select("keep_id", F.col("fp").alias("keep_fp"))
    if not repeated.take(1):
        return single
    # Keys that repeat are rare; only their rows are fingerprinted again, with all their columns.
    rest = docs.join(repeated, own == repeated["keep_id"], "left_semi")
    digest = F.xxhash64(own, docs[text])
    slim = rest.select(own.alias("doc_id"), docs[text].cast("binary").alias("text"), digest.alias("digest"))
    marked = slim.mapInArrow(_keyed(width, seed), "doc_id long, digest long, fp long").distinct()
    chosen = marked.join(repeated, (marked["doc_id"] == repeated["keep_id"]) & (marked["fp"] == repeated["keep_fp"])).groupBy("doc_id").agg(F.min("digest").alias("keep_digest"))
    chosen = chosen.withColumnRenamed("doc_id", "chosen_id")
    wanted = rest.join(chosen, (own == chosen["chosen_id"]) & (digest == chosen["keep_digest"]))
    # One whole row of each; partial sums keep one a task, so no task gathers the rows of a key.
    wanted = wanted.select(*[docs[c] for c in docs.columns], chosen["chosen_id"].alias("__chosen")).dropDuplicates(["__chosen"])
    return single.unionByName(wanted.drop("__chosen"))


def _keyed(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() if t.is_valid else None, width=width, seed=seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "fp"])

    return run
