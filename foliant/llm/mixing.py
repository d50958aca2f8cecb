"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, n_bytes, partitions, unit

#: The largest mean that one draw inverts; a larger one is the sum of independent draws of at most DRAW_RATE each.
MAX_RATE, DRAW_RATE = 1000.0, 1000.0
#: Copies that are listed at a time.
LEVEL = 65_536
#: Columns that ``mix`` adds.
ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")
#: Sources, and numbers in all their distributions, that are broadcast at most (32 MB).
MAX_SOURCES, MAX_NUMBERS = 100_000, 1 << 22


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the tail is below 2**-53, as an array.

    Terms are summed from their logarithms, so a large rate does not underflow to nothing.
    """
    last = F.ceil(rate + F.lit(10.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    log_rate = F.ln(F.greatest(rate, F.lit(1e-300)))
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + log_rate - F.ln(k.cast("double"))
        p = acc["p"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), p.alias("p"), F.array_append(acc["cdf"], p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """One row a source: its bytes, target weight and mean number of copies.

    ``weights`` has (source, weight); without it all sources weigh the same. A source without a
    weight gets none. A source without bytes has rate 0. Rates are taken so that the expected
    bytes of all sources together are ``epochs`` times the input's.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(n_bytes(F.col(text))).alias("source_bytes"), F.count(F.lit(1)).alias("source_rows"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(w, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").drop("w_source").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    usable = F.when(F.col("source_bytes") > 0, F.col("weight")).otherwise(F.lit(0.0))
    totals = weighted.agg(F.sum("source_bytes").cast("double").alias("all_bytes"), F.sum(usable).alias("all_weight"))
    target = F.lit(float(epochs)) * F.col("all_bytes") * usable / F.col("all_weight")
    rate = F.when((F.col("source_bytes") > 0) & (F.col("all_weight") > 0), target / F.col("source_bytes")).otherwise(F.lit(0.0))
    # totals is one row
    return weighted.join(F.broadcast(totals), F.lit(True)).withColumn("rate", rate).select("mix_source", "source_bytes", "source_rows", "weight", "rate")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, key: str = "doc_id", source: str = "source", text: str = "text", epochs: float = 1.0, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """Repeat each document a Poisson number of times with its source's mean rate, in a global random order.

    Adds ``mix_rate``, ``mix_copies`` (the document's count), ``mix_copy`` (from 1) and ``mix_key``
    (52 random bits; rows are sorted by it and partitions follow each other in its order).

    * The count inverts the Poisson distribution at a number made from the hash of key and seed, so a
      run again, or on another cluster, gives the same copies. Rows that repeat a key get the same count.
    * No rate is refused: above MAX_RATE the count is the sum of draws at numbers made from key, draw and seed.
    * Null sources are a source of their own; null and empty texts have no bytes and go with their source.
    * Empty tables give empty results. Columns of the input named as the added ones are replaced.

    Sources' sums are partial before they are shuffled, a row a source and task. The rates are computed once; they are
    broadcast when their count and size are within bounds, so documents move once, in the final shuffle. Beyond
    the bounds documents meet their rates in a join whose hot sources adaptive execution splits.
    """
    docs = docs.drop(*ADDED, "mix_source", "mix_cdf", "mix_draws", "mix_u", "mix_block")
    cols = docs.columns
    draws = F.when(F.col("rate") > MAX_RATE, F.ceil(F.col("rate") / DRAW_RATE)).otherwise(F.lit(1)).cast("long")
    rates = source_rates(docs, weights, source=source, text=text, epochs=epochs).select("mix_source", F.col("rate").alias("mix_rate"), draws.alias("mix_draws"), poisson_cdf(F.col("rate") / draws).alias("mix_cdf"))
    rates = checkpoint(rates)
    sources, numbers = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("mix_cdf")), F.lit(0))).first()
    rates = F.broadcast(rates) if sources <= MAX_SOURCES and numbers <= MAX_NUMBERS else rates.hint("merge")
    several = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("mix_draws")), F.lit(0).cast("long"),
        lambda n, i: n + F.aggregate("mix_cdf", F.struct(F.lit(0).cast("long").alias("n"), unit(key, i, seed=seed).alias("u")), lambda a, p: F.struct((a["n"] + (p <= a["u"]).cast("long")).alias("n"), a["u"].alias("u")), lambda a: a["n"]),
    )
    counted = (
        docs.join(rates, docs[source].eqNullSafe(rates["mix_source"]))
        .withColumn("mix_u", unit(key, seed=seed))
        .withColumn("mix_copies", F.when(F.col("mix_rate") <= 0, F.lit(0)).when(F.col("mix_draws") > 1, several).otherwise(F.size(F.filter("mix_cdf", lambda p: p <= F.col("mix_u")))).cast("long"))
        .where("mix_copies > 0")
        .select(*cols, "mix_rate", "mix_copies")
    )
    # Two levels, so no array grows with a document's copies: blocks, then the copies of each.
    out = counted.withColumn("mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("mix_copies") - 1) / LEVEL))))
    first = F.col("mix_block") * LEVEL
    out = out.select(*cols, "mix_rate", "mix_copies", F.explode(F.sequence(first + 1, F.least(first + LEVEL, F.col("mix_copies")))).alias("mix_copy"))
    out = out.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col(key).cast("string"), F.col("mix_copy").cast("string"))), 1, 13), 16, 10).cast("long"))
    if not shuffle:
        return out
    # The key is uniform, so equal ranges of it hold equal shares: no sampling pass is needed.
    n = max(1, partitions(docs.sparkSession))
    width = math.ceil(2**52 / n)
    return out.repartitionById(n, F.floor(F.col("mix_key") / F.lit(width)).cast("int")).sortWithinPartitions("mix_key", key)
