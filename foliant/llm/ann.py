"""Approximate nearest neighbours: an adaptive dimension scan within probed lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint

#: Bounds of the sample that the index is fitted on, of the lists, and of a task's rows.
SAMPLE_ROWS, MAX_LISTS, CHUNK_ROWS, CHUNK_QUERIES = 20_000, 1024, 8192, 2048
#: Columns of a block, and how sure a test must be before it abandons a candidate (in standard deviations).
BLOCK, CONFIDENCE = 16, 2.1
#: The recall that the number of probed lists is chosen for, on queries from the sample.
TARGET_RECALL, TUNING_QUERIES = 0.95, 256
TILE_QUERIES, TILE_ROWS = 64, 512
#: Sample rows that bound each query's k-th distance before any list is scanned.
SEED_ROWS = 4096


class Index:
    """Centres and a random rotation, in a space with one more dimension.

    A vector x gets the component sqrt(bound - |x|^2) and a query 0, with bound the largest |x|^2 of
    all rows: then the largest inner products are the smallest distances.
    """

    def __init__(self, sample: np.ndarray, bound: float, n_rows: int, k: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bound, self.seeds = bound, sample[:SEED_ROWS]
        self.rotation = np.linalg.qr(rng.standard_normal((sample.shape[1] + 1, sample.shape[1] + 1)))[0]
        lists = int(max(1, min(MAX_LISTS, np.sqrt(n_rows), len(sample) // 20)))
        x = self.lift(sample)
        self.centres = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(8):
            near = self.lists_of(x, 1)[:, 0]
            sums, counts = np.zeros_like(self.centres), np.bincount(near, minlength=lists)
            np.add.at(sums, near, x)
            self.centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centres)
        self.probes = self._tuned(sample, x, k)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.bound - (x * x).sum(1)))
        return np.column_stack((x, extra)) @ self.rotation

    def lists_of(self, lifted: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(lifted), min(n, len(self.centres))), np.int64)
        for a in range(0, len(lifted), 4096):
            d = (self.centres**2).sum(1) - 2 * lifted[a : a + 4096] @ self.centres.T
            out[a : a + 4096] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
        return out

    def farthest(self, q: np.ndarray, k: int) -> np.ndarray:
        """A distance that the k-th nearest row cannot exceed: that of the k-th nearest sample row."""
        if len(self.seeds) < k:
            return np.full(len(q), np.inf)
        out = np.empty(len(q))
        for a in range(0, len(q), 1024):
            s = q[a : a + 1024] @ self.seeds.T
            out[a : a + 1024] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.maximum(0, (q * q).sum(1) + self.bound - 2 * out) + 1e-12

    def _tuned(self, sample: np.ndarray, x: np.ndarray, k: int) -> int:
        """The fewest lists that hold TARGET_RECALL of the sample's own neighbours of sample queries."""
        q = sample[:: max(1, len(sample) // TUNING_QUERIES)][:TUNING_QUERIES]
        scores = q @ sample.T
        own = np.arange(0, len(sample), max(1, len(sample) // TUNING_QUERIES))[: len(q)]
        scores[np.arange(len(q)), own] = -np.inf  # a query is no neighbour of its own
        top = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
        of = self.lists_of(x, 1)[:, 0]
        order = self.lists_of(self.lift(q, query=True), len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort(np.take_along_axis(place, of[top], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))]) + 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def adaptive_scan(q: np.ndarray, x: np.ndarray, q_lift: np.ndarray, x_lift: np.ndarray, ids: np.ndarray, bound: float, k: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query, larger inner product first, then smaller id.

    Distances grow block by block of rotated columns. After each block a candidate whose partial
    distance, scaled to all columns, lies significantly beyond the k-th best so far is abandoned.
    """
    width, found_q, found_x, found_s = x_lift.shape[1], [], [], []
    blocks = [(a, width if b + BLOCK > width else b) for a, b in ((a, a + BLOCK) for a in range(0, max(1, width - BLOCK + 1), BLOCK))]
    for a in range(0, len(q), TILE_QUERIES):
        qs, ql = q[a : a + TILE_QUERIES], q_lift[a : a + TILE_QUERIES]
        far = np.full(len(qs), np.inf) if start is None else start[a : a + TILE_QUERIES].copy()
        best_i, best_j, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(x), TILE_ROWS):
            xl = x_lift[b : b + TILE_ROWS]
            lo, hi = blocks[0]
            part = (ql[:, lo:hi] ** 2).sum(1)[:, None] + (xl[:, lo:hi] ** 2).sum(1)[None, :] - 2 * ql[:, lo:hi] @ xl[:, lo:hi].T
            limit = far * (hi / width) * (1 + CONFIDENCE / np.sqrt(hi)) ** 2
            i, j = np.nonzero(part <= limit[:, None] * (1 + 1e-9))
            d = part[i, j]
            for lo, hi in blocks[1:]:
                if 16 * len(i) > part.size:  # many are left: the block's distances of the whole tile are cheaper than gathering
                    a_, b_ = ql[:, lo:hi], xl[:, lo:hi]
                    d = d + ((a_ * a_).sum(1)[:, None] + (b_ * b_).sum(1)[None, :] - 2 * a_ @ b_.T)[i, j]
                else:
                    d = d + ((ql[i, lo:hi] - xl[j, lo:hi]) ** 2).sum(1)
                limit = far * (hi / width) * (1 + (CONFIDENCE / np.sqrt(hi) if hi < width else 0)) ** 2
                near = d <= limit[i] * (1 + 1e-9)
                i, j, d = i[near], j[near], d[near]
            s = np.einsum("ij,ij->i", qs[i], x[j + b])
            best_i, best_j, best_s = np.concatenate((best_i, i)), np.concatenate((best_j, j + b)), np.concatenate((best_s, s))
            order = np.lexsort((ids[best_j], -best_s, best_i))
            best_i, best_j, best_s = best_i[order], best_j[order], best_s[order]
            rank = np.arange(len(best_i)) - np.searchsorted(best_i, best_i)
            top = rank < k
            best_i, best_j, best_s, rank = best_i[top], best_j[top], best_s[top], rank[top]
            last = rank == k - 1
            far[best_i[last]] = np.minimum(far[best_i[last]], np.maximum(0, (qs[best_i[last]] ** 2).sum(1) + bound - 2 * best_s[last]) + 1e-12)
        found_q.append(best_i + a)
        found_x.append(best_j)
        found_s.append(best_s)
    return np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)


def usable(vector: str, width: int | None = None):
    """Vectors without null or non-finite components that are not zero (and, if given, of that width)."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    return fine if width is None else fine & (F.size(v) == width)


def search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product found for each row of ``queries``.

    Returns query_id, rank (from 1), ``key`` and score: nearest first, ties to the smaller key, the row of
    the query's own key left out; fewer only where there are fewer candidates.

    * Vectors that are null, zero, hold null or non-finite components, have a null key, or differ from
      the most frequent width take no part. Empty tables give empty results; other columns are ignored.
    * Rows that repeat a vector are scanned once and listed by their k + 1 smallest keys, which no answer can
      exceed; rows that repeat key and vector are one row.

    Lists are scanned in chunks of bounded rows against chunks of bounded queries, so a hot list is many tasks.
    A query probes lists until they hold four times the rows it asks for.
    """
    spark = vectors.sparkSession
    names = "query_id long, rank int, vec_id long, score double"
    clean = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    widths = clean.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], names)
    width = widths[0]["w"]
    clean = clean.where(F.size("v") == width).withColumn("a", F.xxhash64("v")).withColumn("b", F.hash("v"))
    asked = queries.where(F.col(key).isNotNull() & usable(vector, width)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    asked = asked.select("query_id", F.xxhash64("v").alias("a"), F.hash("v").alias("b"), "v")
    own = Window.partitionBy("a", "b", "v").orderBy("vec_id")
    first = clean.distinct().withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    reps = checkpoint(first.groupBy("a", "b", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n, bound = reps.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    # A share by hash first, so tasks hand on little more than the sample; it holds too few rows with no more than chance.
    share = F.shiftrightunsigned(F.xxhash64("a", F.lit(1)), 1) < F.lit(int(min(2**63 - 1, 2**63 * (1.05 * SAMPLE_ROWS + 200) / max(n, 1))))
    drawn = reps.where(share).orderBy(F.xxhash64("a", F.lit(1)), "a", "b").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    index = Index(matrix(drawn, width), bound * (1 + 1e-12), n, k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = index.lists_of(index.lift(matrix(batch.column("v"), width)), 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["a", "b", "v", "ids", "list"])

    placed = checkpoint(reps.mapInArrow(listed, "a long, b int, v array<double>, ids array<long>, list int"))
    held = np.zeros(len(index.centres), np.int64)
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # MAX_LISTS rows at most
        held[r["list"]] = r["n"]
    wanted = asked.select("a", "b", "v").distinct()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = index.lists_of(index.lift(matrix(batch.column("v"), width), query=True), len(held))
            enough = np.cumsum(held[order], axis=1) - held[order] < 4 * (k + 1)
            take = (np.arange(order.shape[1])[None, :] < index.probes) | enough
            take &= held[order] > 0
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(i)) for c in batch.columns], pa.array(order[i, j].astype(np.int32))], names=["a", "b", "v", "list"])

    asks = checkpoint(wanted.mapInArrow(probed, "a long, b int, v array<double>, list int"))
    asking = np.zeros(len(held), np.int64)
    for r in asks.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        asking[r["list"]] = r["n"]
    chunks = F.array(*[F.lit(int(max(1, -(-x // CHUNK_ROWS)))) for x in held])
    turns = F.array(*[F.lit(int(max(1, -(-x // CHUNK_QUERIES)))) for x in asking])
    n_chunks, n_turns = F.element_at(chunks, F.col("list") + 1), F.element_at(turns, F.col("list") + 1)
    rows = placed.withColumn("c", F.pmod(F.xxhash64("a"), n_chunks).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), n_turns - 1)))
    asks = asks.withColumn("t", F.pmod(F.xxhash64("a"), n_turns).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), n_chunks - 1)))

    def scanned(left: pa.Table, right: pa.Table, bounded: bool) -> pa.Table:
        """left: queries, right: rows of one list. Without the seeds' bound a list gives all of its rows up to k + 1."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "ids": pa.array([], pa.list_(pa.int64())), "first_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        q, x = matrix(left.column("v").combine_chunks(), width), matrix(right.column("v").combine_chunks(), width)
        ids = right.column("ids").combine_chunks()
        smallest = ids.flatten().to_numpy()[(ids.offsets.to_numpy() - ids.offsets[0].as_py())[:-1]]
        i, j, s = adaptive_scan(q, x, index.lift(q, query=True), index.lift(x), smallest, index.bound, k + 1, index.farthest(q, k + 1) if bounded else None)
        return pa.table({"a": left.column("a").take(pa.array(i)), "b": left.column("b").take(pa.array(i)), "ids": ids.take(pa.array(j)), "first_id": pa.array(smallest[j]), "score": pa.array(s)})

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        return scanned(left, right, True)

    def scan_whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return scanned(left, right, False)

    found = "a long, b int, ids array<long>, first_id long, score double"
    met = checkpoint(asks.groupBy("list", "c", "t").cogroup(rows.groupBy("list", "c", "t")).applyInArrow(scan, found))
    # Queries with too few rows: their near seeds lie in lists that were not probed, or a test abandoned true ones.
    short = wanted.join(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], "left").where(F.coalesce("n", F.lit(0)) < k + 1).select("a", "b")
    again = asks.join(short, ["a", "b"], "left_semi")
    whole = again.groupBy("list", "c", "t").cogroup(rows.groupBy("list", "c", "t")).applyInArrow(scan_whole, found)
    met = met.join(short, ["a", "b"], "left_anti").unionByName(whole)
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "first_id"))).where(F.col("r") <= k + 1)
    each = best.select("a", "b", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    mine = asked.select("query_id", "a", "b").join(each, ["a", "b"]).where("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")
