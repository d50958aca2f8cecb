"""Mergeable summaries as ordinary rows: distinct counts, quantiles, item counts, and bottom-k samples.

Each state is a small table that partial aggregation builds, is saved per part of the data (a day, a shard) and merges with others
exactly: the merged state is the state of all the data, whatever the parts. Hashes come from MD5, so any engine gives the same states.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bits(value: Column, seed: int, first: int, digits: int) -> Column:
    """``digits`` hexadecimal digits from place ``first`` of the MD5 of a seeded value, as a number; 12 digits at most."""
    key = F.concat(F.lit(f"{seed}|"), value.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), first, digits), 16, 10).cast("long")


# Distinct values: registers with the longest run of leading zeros

#: Bits of a register's number: 4,096 registers, a standard error of 1.04 / 64.
REGISTER_DIGITS, RANK_DIGITS = 3, 12


def distinct_state(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, register, rank): one row for each register that a key has met, 4,096 at most. Null values are not counted."""
    bucket = hash_bits(F.col(value), 0, 1, REGISTER_DIGITS).cast("int")
    rest = hash_bits(F.col(value), 0, 1 + REGISTER_DIGITS, RANK_DIGITS)
    bits = 4 * RANK_DIGITS
    rank = F.when(rest == 0, bits + 1).otherwise(bits - F.length(F.bin(rest)) + 1)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("register")).agg(F.max(rank.cast("int")).alias("rank"))


def merge_distinct(state: DataFrame, keys: list[str]) -> DataFrame:
    """States of finer keys, or several states united, to one of ``keys``."""
    return state.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def distinct_estimate(state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate): the harmonic mean of the registers; by the empty registers where few values have been met."""
    m = float(16**REGISTER_DIGITS)
    sums = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("_met"), F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))).alias("_mass"))
    empty = m - F.col("_met")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("_mass") + empty)
    return sums.select(*keys, F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("estimate"))


# Quantiles: counts in buckets of a constant ratio


def quantile_state(rows: DataFrame, keys: list[str], value: str, *, error: float = 0.01) -> DataFrame:
    """(keys, sign, bucket, n): counts of values by the power of (1 + error) / (1 - error) that they lie under.

    A quantile read from it is within the relative ``error`` of the exact one. Nulls and not-a-number are left out. Buckets are some 70,000 at most.
    """
    v = F.col(value).cast("double")
    bucket = F.when(v == 0, 0).otherwise(F.ceil(F.log(F.abs(v)) / math.log((1 + error) / (1 - error)))).cast("int")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(state: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """For quantile and item states: counts of the cells add up."""
    return state.groupBy(*keys, *cells).agg(F.sum("n").alias("n"))


def quantiles(state: DataFrame, keys: list[str], shares: list[float], *, error: float = 0.01) -> DataFrame:
    """(keys, share, value): the value at whose rank, from the smallest, ``share`` of all lie at or below it.

    Buckets are a few thousand rows a key, so a window over them is small however many values they count.
    """
    ratio = (1 + error) / (1 - error)
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    ranked = state.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    asked = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_all")))
    found = asked.where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("n") < wanted))
    middle = F.col("sign") * 2 * F.pow(F.lit(ratio), F.col("bucket").cast("double")) / (ratio + 1)
    return found.select(*keys, "share", F.when(F.col("sign") == 0, 0.0).otherwise(middle).alias("value"))


# Counts of items: never too small


def count_state(rows: DataFrame, keys: list[str], item: str, *, depth: int = 4, width: int = 4096) -> DataFrame:
    """(keys, line, cell, n): counts of items by one hashed cell a line. Null items are not counted."""
    counted = rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_times"))
    lines = F.array(*[F.struct(F.lit(d).alias("line"), (hash_bits(F.col(item), d + 1, 1, 8) % width).cast("int").alias("cell")) for d in range(depth)])
    return counted.select(*keys, "_times", F.explode(lines).alias("l")).groupBy(*keys, "l.line", "l.cell").agg(F.sum("_times").alias("n"))


def count_estimate(state: DataFrame, keys: list[str], asked: DataFrame, item: str, *, depth: int = 4, width: int = 4096) -> DataFrame:
    """(keys, item, estimate) of the items asked for, (keys, item): the least of their cells, 0 where one is empty."""
    lines = F.array(*[F.struct(F.lit(d).alias("line"), (hash_bits(F.col(item), d + 1, 1, 8) % width).cast("int").alias("cell")) for d in range(depth)])
    cells = asked.select(*keys, item).distinct().withColumn("l", F.explode(lines)).select(*keys, item, "l.*")
    return cells.join(state, [*keys, "line", "cell"], "left").groupBy(*keys, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


# Samples


def sample_key(identity: list[Column], seed: int = 0) -> Column:
    """A number that orders rows as if by lot, and always alike; nulls count as such."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in identity]
    return hash_bits(F.concat_ws("\x01", *parts), seed, 1, 12)


def bottom_k(rows: DataFrame, k: int, *, strata: list[str], identity: list[str], seed: int = 0) -> DataFrame:
    """The ``k`` rows of each stratum with the least keys: a uniform sample without replacement, the same at any partitioning.

    Adds ``sample_key`` and ``sample_rank`` (from 1). Each task keeps k rows a stratum before anything is shuffled, so a stratum that holds most
    rows costs no more than others and nothing is sorted as a whole. ``identity`` tells rows apart and breaks ties; rows alike in it are one draw each.
    Null strata are strata.
    """
    keyed = rows.withColumn("sample_key", sample_key([F.col(c) for c in identity], seed))
    order = Window.partitionBy(*strata).orderBy("sample_key", *identity)
    return keyed.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= k)


def merge_samples(a: DataFrame, b: DataFrame, k: int, *, strata: list[str], identity: list[str]) -> DataFrame:
    """Two samples of disjoint rows, drawn alike, to the sample of both."""
    both = a.drop("sample_rank").unionByName(b.drop("sample_rank"))
    return both.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("sample_key", *identity))).where(F.col("sample_rank") <= k)
