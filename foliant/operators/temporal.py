"""As-of, interval and range joins: equality joins and windows over buckets, never a comparison of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket with more than this share of all rows is split: fewer than a thousand are, so what is broadcast about them is bounded.
HOT_SHARE = 1000
#: Parts of a split bucket.
PARTS = 32
#: A part of an interval bucket has so many thousandths of all rows, or more where there are PARTS: each part copies the other side.
PART_SHARE = 4
#: Cells in which interval buckets are counted before those of full cells are told apart.
CELLS = 16 * HOT_SHARE
#: One in so many intervals of a side may be longer than the bucket, and is cut into 2**REACH pieces at most or filed by a wider one.
REST, REACH = 16, 10


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a time column; numbers as they are."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def _struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


# As-of


def _cuts(rows: DataFrame, total: int) -> DataFrame:
    """(key, bucket, cuts) of hot buckets, below HOT_SHARE of them: the times at which they are split, about evenly."""
    share = [k / PARTS for k in range(1, PARTS)]
    hot = rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total).select("_key", "_bucket")
    within = rows.join(F.broadcast(hot), ["_key", "_bucket"])
    return within.groupBy("_key", "_bucket").agg(F.array_distinct(F.percentile_approx("_at", share, 1000)).alias("_cuts"))


def as_of(left: DataFrame, right: DataFrame, *, on: dict[str, str], at: tuple[str, str], width: float, ties: list[str] | None = None, tolerance: float | None = None, forward: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key that is not after it (``forward``: the first that is not before it).

    ``on``: left columns to right columns; ``at``: the two time columns (timestamps count in microseconds, numbers as they are);
    ``width``: a bucket's length in those units; ``ties``: right columns whose largest values win among equal times;
    ``tolerance``: matches further away count as none.

    Both sides are united and dealt to buckets of (key, time). In a bucket the last right row so far is carried forward by
    one window; what earlier buckets leave is one row a bucket, carried over by a window of a row a bucket. Buckets of more
    than a thousandth of all rows are split at quantiles of their times, so a hot key is spread over many tasks.

    Returns the left columns and ``match``, a struct of the right row or null.

    * Left rows with a null in their key or time are kept without a match; such right rows match nothing.
    * Repeated left rows stay; among right rows of one time without ``ties`` any one may match.
    * Names that clash do no harm, as the right row is a struct (only ``match`` must be free on the left). Either side may be empty.
    """
    sign = -1 if forward else 1
    rank = F.struct(*[F.col(c) for c in ties or []]) if ties else F.lit(0)
    of_left = left.select(F.struct(*[F.col(c) for c in on]).alias("_key"), (_micros(left, at[0]) * sign).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(rank.alias("t")).schema["t"].dataType).alias("_tie"), _struct(left).alias("_row"), F.lit(None).cast(right.schema).alias("_match"))
    named = [F.col(c).alias(k) for k, c in on.items()]
    of_right = right.select(F.struct(*named).alias("_key"), (_micros(right, at[1]) * sign).alias("_at"), F.lit(0).alias("_side"), rank.alias("_tie"), F.lit(None).cast(left.schema).alias("_row"), _struct(right).alias("_match"))
    whole = " and ".join(f"_key.`{k}` is not null" for k in on) + " and _at is not null"
    rows = of_left.unionByName(of_right.where(whole)).withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)).cast("long"))
    usable = rows.where(whole)
    cuts = F.broadcast(_cuts(usable.select("_key", "_bucket", "_at"), max(1, usable.count())))
    rows = usable.join(cuts, ["_key", "_bucket"], "left").withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0)))
    bucket = ["_key", "_bucket", "_part"]
    last = rows.where("_side = 0").groupBy(*bucket).agg(F.max_by("_match", F.struct("_at", "_tie")).alias("_last"))
    all_buckets = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).join(last, bucket, "left")  # a row a bucket
    before = Window.partitionBy("_key").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_buckets.select(*bucket, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    so_far = Window.partitionBy(*bucket).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_found", F.last("_match", ignorenulls=True).over(so_far)).where("_side = 1")
    met = met.join(carried, bucket, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    if tolerance is not None:
        then = _micros_of_field(right, at[1]) * sign
        met = met.withColumn("_found", F.when(F.col("_at") - then <= tolerance, F.col("_found")))
    out = met.select("_row.*", F.col("_found").alias("match"))
    return out.unionByName(rows_without(left, on, at[0]).withColumn("match", F.lit(None).cast(right.schema)))


def rows_without(df: DataFrame, on: dict[str, str], at: str) -> DataFrame:
    """Rows with a null in their key or time."""
    return df.where(" or ".join(f"`{c}` is null" for c in [*on, at]))


def _micros_of_field(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    field = F.col("_found")[column]
    return F.unix_micros(field.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else field


# Intervals


def _levelled(df: DataFrame, on: list[str], start: str, end: str, finest: int, names: list[str]) -> DataFrame:
    """(_key, _lo, _hi, _level, _row): closed intervals with the power of two that is not below their length."""
    lo, hi = _micros(df, start), _micros(df, end)
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(on, names, strict=True)]) if on else F.struct(F.lit(0).alias("all"))
    length = (F.col("_hi") - F.col("_lo")).cast("double")
    level = F.greatest(F.lit(finest), F.when(length > 0, F.ceil(F.log2(length))).otherwise(finest)).cast("int")
    rows = df.select(key.alias("_key"), lo.alias("_lo"), hi.alias("_hi"), _struct(df).alias("_row")).where("_lo <= _hi")
    if on:
        rows = rows.where(" and ".join(f"_key.`{n}` is not null" for n in names))
    return rows.withColumn("_level", level)


def _widths(sides: list[dict[int, int]]) -> dict[int, int]:
    """The width (a power of two) at which the intervals of each level are filed, from each side's numbers of intervals by level.

    A width is the least that is not below all but a REST of each side's intervals that are left; longer ones are cut there too, shortest
    first, while that makes no more pieces than there are intervals, of REACH doublings at most. What is left then gets a width of its own. So
    there are log(intervals) / log(REST) widths at most, however far lengths lie apart, and one as a rule.
    """
    total, width = sum(sum(s.values()) for s in sides), {}
    left = [dict(s) for s in sides]
    while any(left):
        at = max(next(k for k in sorted(s) if sum(n for m, n in s.items() if m > k) * REST <= sum(s.values())) for s in left if s)
        pieces = 0
        for k in sorted({k for s in left for k in s}):
            pieces += sum(s.get(k, 0) for s in left) * 2 ** (k - at) if k > at else 0
            if k > at + REACH or pieces > total:
                break
            width[k] = at
        left = [{k: n for k, n in s.items() if k not in width} for s in left]
    return width


def _at_width(rows: DataFrame, width: Column) -> DataFrame:
    """A row for each bucket of 2**width that an interval touches."""
    size = F.pow(F.lit(2.0), width.cast("double"))
    first, last = F.floor(F.col("_lo").cast("double") / size), F.floor(F.col("_hi").cast("double") / size)
    return rows.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _hot(asked: DataFrame, held: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Buckets with more than a thousandth of ``total`` rows, and the parts that each side's rows there are dealt to.

    Buckets are counted in CELLS cells first; only those of full cells are told apart, so next to nothing is shuffled.
    """
    rows = asked.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_h")).unionByName(held.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_h")))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(CELLS)))
    full = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT_SHARE > total).select("_cell")
    counted = rows.join(F.broadcast(full), "_cell").groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_h").alias("_h"))
    parts = [F.least(F.lit(PARTS), F.greatest(F.lit(1), F.ceil(F.col(n) * HOT_SHARE / F.lit(PART_SHARE * total)))).cast("int").alias(f"{n}_parts") for n in ("_a", "_h")]
    return counted.where((F.col("_a") + F.col("_h")) * HOT_SHARE > total).select(*keys, *parts)


def _salted(rows: DataFrame, hot: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Rows of hot buckets are dealt to their own side's parts and copied to each of the other side's."""
    parts = {n: F.coalesce(f"{n}_parts", F.lit(1)) for n in (own, other)}
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn(f"{own}_salt", F.pmod(F.xxhash64("_lo", "_hi", "_row"), parts[own]).cast("int"))
    return rows.withColumn(f"{other}_salt", F.explode(F.sequence(F.lit(0), parts[other] - 1))).drop("_a_parts", "_h_parts")


def _met(few: DataFrame, many: DataFrame, widths: list[int], total: int, *, same: bool) -> DataFrame:
    """Pairs of an interval of ``few``, of one of ``widths``, with those of ``many`` of that width (``same``) or smaller ones."""
    held = _at_width(few.where(F.col("_width").isin(widths)), F.col("_width")).select("_key", F.col("_width").alias("_at_width"), "_bucket", "_lo", "_hi", "_row")
    asked = many.withColumn("_at_width", F.explode(F.array(*[F.lit(k) for k in widths])))
    asked = asked.where(F.col("_at_width") >= F.col("_width") if same else F.col("_at_width") > F.col("_width"))
    asked = _at_width(asked, F.col("_at_width")).select("_key", "_at_width", "_bucket", "_lo", "_hi", "_row")
    keys = ["_key", "_at_width", "_bucket"]
    hot = _hot(asked, held, keys, total)  # below HOT_SHARE rows for each copy that an interval has
    asked = _salted(asked, hot, keys, "_a", "_h")
    held = _salted(held, hot, keys, "_h", "_a").withColumnsRenamed({"_lo": "_from", "_hi": "_to", "_row": "_held"})
    pairs = asked.join(held, [*keys, "_a_salt", "_h_salt"]).where((F.col("_lo") <= F.col("_to")) & (F.col("_from") <= F.col("_hi")))
    size = F.pow(F.lit(2.0), F.col("_at_width").cast("double"))
    begins = F.floor(F.greatest("_lo", "_from").cast("double") / size).cast("long")
    return pairs.where(begins == F.col("_bucket"))  # two that share several buckets meet in the one where their overlap begins


def interval_join(left: DataFrame, right: DataFrame, *, on: dict[str, str] | None = None, left_span: tuple[str, str], right_span: tuple[str, str], finest: float = 1.0) -> DataFrame:
    """Pairs of rows of equal keys whose closed intervals [start, end] share a point.

    ``left_span`` and ``right_span`` name start and end columns (the same column twice for points); without ``on`` all rows have one
    key. ``finest``: the shortest bucket, in microseconds for times.

    Intervals are filed in buckets of one width, which all but a few are no longer than; those few are cut into several, or where they are too
    long or too many for it have a wider width, at which the other side's shorter ones look them up. So a row is moved about once, whatever its
    length, and a plan has equality joins only. Buckets with more than four thousandths of all rows on a side are dealt to parts.

    Returns ``left`` and ``right``, structs of the rows.

    * Intervals with a null in them or in their key, and those that end before they start, meet nothing.
    * Repeated rows are pairs of their own; names may clash. An empty side gives no rows.
    """
    base, on = math.floor(math.log2(finest)), on or {}
    a = _levelled(left, list(on), *left_span, base, list(on))
    b = _levelled(right, list(on.values()), *right_span, base, list(on))
    of = [dict(side.groupBy("_level").agg(F.count(F.lit(1))).collect()) for side in (a, b)]  # some sixty numbers at most
    if not of[0] or not of[1]:
        return a.limit(0).select(F.col("_row").alias("left")).join(b.limit(0).select(F.col("_row").alias("right")), F.lit(False))
    width, n = _widths(of), sum(sum(side.values()) for side in of)
    at = F.create_map(*[F.lit(x) for pair in width.items() for x in pair])[F.col("_level")]
    a, b = a.withColumn("_width", at), b.withColumn("_width", at)
    own = [sorted({width[k] for k in side}) for side in of]  # both have the smallest width
    longer = _met(b, a, own[1], n, same=True).select(F.col("_row").alias("left"), F.col("_held").alias("right"))
    if not own[0][1:]:
        return longer
    return longer.unionByName(_met(a, b, own[0][1:], n, same=False).select(F.col("_held").alias("left"), F.col("_row").alias("right")))


def range_join(left: DataFrame, right: DataFrame, *, on: dict[str, str] | None = None, value: tuple[str, str], within: tuple[float, float], finest: float | None = None) -> DataFrame:
    """Pairs of rows of equal keys with ``within[0] <= right value - left value <= within[1]``: an interval join with points.

    Times count in microseconds. Nulls meet nothing. Returns ``left`` and ``right``, structs of the rows.
    """
    at = _micros(left, value[0])
    spans = left.select(_struct(left).alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(on or {})], (at + within[0]).alias("lo"), (at + within[1]).alias("hi"))
    keyed = {f"k{i}": c for i, c in enumerate((on or {}).values())}
    points = right.select(_struct(right).alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate((on or {}).values())], _micros(right, value[1]).alias("at"))
    pairs = interval_join(spans, points, on={k: k for k in keyed}, left_span=("lo", "hi"), right_span=("at", "at"), finest=finest or max(1.0, within[1] - within[0]))
    return pairs.select(F.col("left.row").alias("left"), F.col("right.row").alias("right"))
