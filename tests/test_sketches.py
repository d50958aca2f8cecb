"""States merge to the state of all rows, whatever the parts; estimates lie within their error."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import matrices, sketches


def numbers(spark, n=20_000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7).alias("part"), (F.pow(F.col("id") % 5000, F.lit(2)) - 1000).alias("v"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_distinct(spark):
    n = numbers(spark)
    single = sketches.distinct_state(n, ["g"], "v")
    merged = sketches.merge_distinct(sketches.distinct_state(n, ["g", "part"], "v"), ["g"])
    assert rows(single) == rows(merged)
    got = {r["g"]: r["estimate"] for r in sketches.distinct_estimate(merged, ["g"]).collect()}
    want = {r["g"]: r["n"] for r in n.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    assert got.keys() == want.keys() == {"a", "b", None}
    assert all(abs(got[g] - want[g]) < 0.06 * want[g] for g in want)
    assert single.count() <= 3 * 4096
    few = sketches.distinct_estimate(sketches.distinct_state(n.where("v < -900"), [], "v"), []).first()[0]
    assert round(few) == 10
    assert sketches.distinct_estimate(sketches.distinct_state(n.withColumn("v", F.lit(None)), ["g"], "v"), ["g"]).count() == 0


def test_quantiles(spark):
    n = numbers(spark)
    single = sketches.quantile_state(n, ["g"], "v")
    assert rows(single) == rows(sketches.merge_counts(sketches.quantile_state(n, ["g", "part"], "v"), ["g"], ["sign", "bucket"]).select(*single.columns))
    values = {}
    for r in n.collect():
        values.setdefault(r["g"], []).append(r["v"])
    for r in sketches.quantiles(single, ["g"], [0.0, 0.003, 0.25, 0.5, 0.999, 1.0]).collect():
        own = sorted(values[r["g"]])
        exact = own[max(1, -(-int(r["share"] * len(own) * 1000) // 1000)) - 1]
        assert abs(r["value"] - exact) <= 0.0101 * abs(exact) + 1e-9
    odd = spark.createDataFrame([(0.0,), (float("nan"),), (None,), (-2.0,)], "v double")
    assert [r["value"] for r in sketches.quantiles(sketches.quantile_state(odd, [], "v"), [], [0.5, 1.0]).orderBy("share").collect()] == pytest.approx([-2.0, 0.0], rel=0.01)


def test_counts(spark):
    n = numbers(spark).withColumn("v", F.floor(F.sqrt("id")))
    single = sketches.count_state(n, [], "v", width=64)
    assert rows(single) == rows(sketches.merge_counts(sketches.count_state(n, ["part"], "v", width=64), [], ["line", "cell"]))
    exact = {r["v"]: r["count"] for r in n.groupBy("v").count().collect()}
    asked = spark.range(200).select(F.col("id").alias("v"))
    got = {r["v"]: r["estimate"] for r in sketches.count_estimate(single, [], asked, "v", width=64).collect()}
    assert len(got) == 200 and all(got[v] >= exact.get(v, 0) for v in got)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_bottom_k(spark, parts):
    n = numbers(spark)
    whole = sketches.bottom_k(n, 40, strata=["g"], identity=["id"])
    assert rows(whole) == rows(sketches.bottom_k(n.repartition(parts), 40, strata=["g"], identity=["id"]))
    halves = [sketches.bottom_k(n.where(F.col("part") % 2 == k), 40, strata=["g"], identity=["id"]) for k in range(2)]
    assert rows(whole) == rows(sketches.merge_samples(*halves, 40, strata=["g"], identity=["id"]))
    assert [r["count"] for r in whole.groupBy("g").count().collect()] == [40] * 3
    assert 7000 < whole.agg(F.avg("id")).first()[0] < 13_000
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "rangepartitioning" not in plan
    twice = sketches.bottom_k(n.unionByName(n), 40, strata=["g"], identity=["id"])
    assert twice.where("sample_rank <= 2").select("id").distinct().count() == 3


@pytest.mark.parametrize("tile", [2, 5, 32])
@pytest.mark.parametrize("shape", [(7, 11, 9), (40, 1, 30), (1, 70, 1)])
def test_tiled_product(spark, tile, shape):
    rng = random.Random(tile)
    i, k, j = shape
    a = [(g, x, y, rng.randrange(-3, 4) / 2) for g in ("p", "q") for x in range(i) for y in range(k) if rng.random() < 0.6]
    b = [(g, x, y, rng.randrange(-3, 4) / 2) for g in ("p", "q") for x in range(k) for y in range(j) if rng.random() < 0.6]
    a += a[:2] + [("p", 0, 0, None), (None, 0, 0, 1.0)]
    want = {}
    for g, x, y, v in a:
        for h, z, w, u in b:
            if g == h and y == z and v is not None:
                want[g, x, w] = want.get((g, x, w), 0) + v * u
    left, right = spark.createDataFrame(a, "g string, i int, k long, value double"), spark.createDataFrame(b or [("z", 0, 0, 1.0)], "g string, k long, j int, value float")
    got = {(r["g"], r["i"], r["j"]): r["value"] for r in matrices.multiply(left, right, ["g"], tile=tile).collect()}
    assert got == pytest.approx(want)


def test_tiles_move_fewer_rows(spark):
    """Cells that the final sum gets: one for a tile's k in place of one for each."""
    cells = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).alias("k"), F.lit(1.0).alias("value"))
    right = cells.select("k", F.col("i").alias("j"), "value")

    def moved(tile):
        df = matrices.multiply(cells, right, tile=tile)
        df.collect()
        joined = matrices._tiles(cells, [], "i", "k", tile).count()
        return joined

    assert moved(32) * 32 * 32 == 64 * 64
    assert matrices.multiply(cells, right, tile=32).agg(F.sum("value")).first()[0] == 64**3
    assert matrices.multiply(cells.limit(0), right).count() == 0
