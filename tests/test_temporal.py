"""As-of, interval and range joins against plain loops, on ties, nulls, hot keys and random rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import temporal


def plain_as_of(left, right, forward=False, tolerance=None):
    out = []
    for i, k, t in left:
        found = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and (r[2] >= t if forward else r[2] <= t)]
        best = (min(found, key=lambda r: (r[2], -r[0])) if forward else max(found, key=lambda r: (r[2], r[0]))) if found else None
        if best and tolerance is not None and abs(best[2] - t) > tolerance:
            best = None
        out.append((i, best and best[0]))
    return sorted(out)


def frames(spark, left, right):
    return spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "id long, k long, t long")


def met(df):
    return sorted((r["id"], r["match"] and r["match"]["id"]) for r in df.collect())


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("tolerance", [None, 9])
def test_as_of(spark, forward, tolerance):
    rng = random.Random(5)
    one = lambda i, n: (i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(n)]))
    left, right = [one(i, 300) for i in range(400)], [one(i, 300) for i in range(150)]
    a, b = frames(spark, left, right)
    got = temporal.as_of(a, b, on={"k": "k"}, at=("t", "t"), width=40, ties=["id"], forward=forward, tolerance=tolerance)
    assert got.columns == ["id", "k", "t", "match"]
    assert met(got) == plain_as_of(left, right, forward, tolerance)


def test_as_of_hot_key_is_split(spark):
    """A third of all rows has one key and one bucket: no (key, bucket, part) holds more than a tenth of them."""
    left = [(i, 1 if i % 3 == 0 else i, i) for i in range(3000)]
    right = [(i, 1 if i % 2 else i, i * 7 % 3000) for i in range(1000)]
    a, b = frames(spark, left, right)
    got = temporal.as_of(a, b, on={"k": "k"}, at=("t", "t"), width=1_000_000, ties=["id"])
    assert met(got) == plain_as_of(left, right)
    rows = a.unionByName(b).select(F.col("k").alias("_key"), F.lit(0).alias("_bucket"), F.col("t").alias("_at"))
    (cut,) = [r["_cuts"] for r in temporal._cuts(rows, 4000).collect() if r["_key"] == 1]
    sizes = [sum(1 for r in left + right if r[1] == 1 and sum(c <= r[2] for c in cut) == p) for p in range(len(cut) + 1)]
    assert max(sizes) < 400


def test_as_of_awkward(spark):
    a, b = frames(spark, [(1, 1, 5), (1, 1, 5), (2, None, 1), (3, 1, None), (4, 9, 9)], [(7, 1, 5), (8, 1, 5), (9, None, 1), (10, 1, None)])
    both = temporal.as_of(a, b, on={"k": "k"}, at=("t", "t"), width=10, ties=["id"])
    assert met(both) == [(1, 8), (1, 8), (2, None), (3, None), (4, None)]
    assert met(temporal.as_of(a, b.limit(0), on={"k": "k"}, at=("t", "t"), width=10)) == [(1, None), (1, None), (2, None), (3, None), (4, None)]
    assert met(temporal.as_of(a.limit(0), b, on={"k": "k"}, at=("t", "t"), width=10)) == []
    times = a.withColumn("t", F.timestamp_micros("t")), b.withColumn("t", F.timestamp_micros("t"))
    assert met(temporal.as_of(*times, on={"k": "k"}, at=("t", "t"), width=10, ties=["id"])) == met(both)


def pairs(df):
    return sorted((r["left"]["id"], r["right"]["id"]) for r in df.collect())


spans = st.lists(st.tuples(st.sampled_from([None, 1, 1, 2]), st.one_of(st.none(), st.integers(-40, 40)), st.one_of(st.none(), st.integers(-3, 90))), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=spans, b=spans)
def test_intervals(spark, a, b):
    rows = [[(i, k, lo, None if lo is None or n is None else lo + n) for i, (k, lo, n) in enumerate(x)] for x in (a, b)]
    left, right = (spark.createDataFrame(r, "id long, k long, lo long, hi long") for r in rows)
    whole = [[r for r in x if None not in r and r[2] <= r[3]] for x in rows]
    want = sorted((x[0], y[0]) for x in whole[0] for y in whole[1] if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert pairs(temporal.interval_join(left, right, on={"k": "k"}, left_span=("lo", "hi"), right_span=("lo", "hi"))) == want


def test_interval_plan_and_points(spark):
    left = spark.range(500).select("id", F.col("id").cast("double").alias("lo"), (F.col("id") + F.col("id") % 50).cast("double").alias("hi"))
    points = spark.range(600).select("id", (F.col("id") - 20).cast("double").alias("at"))
    out = temporal.interval_join(left, points, left_span=("lo", "hi"), right_span=("at", "at"), finest=8)
    assert pairs(out) == sorted((i, p) for i in range(500) for p in range(600) if i <= p - 20 <= i + i % 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join(spark):
    a, b = spark.createDataFrame([(1, 1, 10.0), (2, 1, None), (3, 2, 11.0)], "id long, k long, v double"), spark.createDataFrame([(7, 1, 12.5), (8, 1, 13.0), (9, 2, 10.5), (10, None, 11.0)], "id long, k long, v double")
    assert pairs(temporal.range_join(a, b, on={"k": "k"}, value=("v", "v"), within=(-0.5, 2.5))) == [(1, 7), (3, 9)]
    assert pairs(temporal.range_join(a, b.limit(0), value=("v", "v"), within=(0, 1))) == []
