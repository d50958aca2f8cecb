"""Products of matrices in coordinate form, tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile.
TILE = 32


def _tiles(cells: DataFrame, by: list[str], row: str, col: str, tile: int) -> DataFrame:
    """(by, row block, column block, cells): a tile's cells in one row."""
    cell = F.struct(F.pmod(F.col(row), F.lit(tile)).cast("int").alias("r"), F.pmod(F.col(col), F.lit(tile)).cast("int").alias("c"), F.col("value").cast("double").alias("v"))
    block = lambda c: F.floor(F.col(c) / tile).cast("long").alias(f"b{c}")
    return cells.where(F.col("value").isNotNull()).groupBy(*by, block(row), block(col)).agg(F.collect_list(cell).alias(f"{row}{col}"))


def multiply(a: DataFrame, b: DataFrame, by: list[str] | None = None, *, tile: int = TILE) -> DataFrame:
    """(by, i, j, value) of two matrices in coordinates, (by, i, k, value) and (by, k, j, value), in tiles of ``tile`` by ``tile``.

    Tiles that share a block of k meet in a join, so it moves one row a tile in place of one a cell, and each product of two tiles is
    summed within its task before cells are shuffled: one row for a tile's k instead of ``tile``. Where there are fewer blocks of k than
    partitions (wide products of thin matrices), tiles are copied to a grid of row and column blocks, so that work is dealt to all.

    Cells that occur twice add up; null values are no cells; a result cell is there if a k has both its factors, even if its sum is 0.
    """
    by, spark = by or [], a.sparkSession
    blocks = [df.agg(*[F.countDistinct(F.floor(F.col(c) / tile)) for c in cols]).first() for df, cols in ((a, ("i", "k")), (b, ("k", "j")))]
    (n_i, n_k), (_, n_j) = blocks
    spread = math.isqrt(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, n_k)))
    rows, cols = max(1, min(spread, n_i)), max(1, min(spread, n_j))
    left = _tiles(a, by, "i", "k", tile).withColumn("rs", F.pmod("bi", F.lit(rows))).withColumn("cs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    right = _tiles(b, by, "k", "j", tile).withColumn("cs", F.pmod("bj", F.lit(cols))).withColumn("rs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    pairs = left.join(right, [*by, "bk", "rs", "cs"]).select(*by, "bi", "bj", "ik", "kj")
    named = pairs.select(*by, "bi", "bj").schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named) + ", cells array<struct<r:int,c:int,v:double>>"
    cells = pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32()), ("v", pa.float64())]))

    def dense(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = column[k].values
        r, c, v = (own.field(x).to_numpy(zero_copy_only=False) for x in range(3))
        out, there = np.zeros((tile, tile)), np.zeros((tile, tile), np.float32)
        np.add.at(out, (r, c), v)
        there[r, c] = 1
        return out, there

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for k, key in enumerate(zip(*[batch.column(x).to_pylist() for x in range(len(named))], strict=True)):
                (x, x_there), (y, y_there) = dense(batch.column(len(named)), k), dense(batch.column(len(named) + 1), k)
                if (own := sums.get(key)) is None:
                    own = sums[key] = [k, np.zeros((tile, tile)), np.zeros((tile, tile), np.float32)]
                own[1] += x @ y
                own[2] += x_there @ y_there
            firsts, made = pa.array([s[0] for s in sums.values()], pa.int64()), []
            for _, total, there in sums.values():
                r, c = np.nonzero(there)
                made.append([{"r": int(p), "c": int(q), "v": float(v)} for p, q, v in zip(r, c, total[r, c], strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(x).take(firsts) for x in range(len(named))], pa.array(made, cells)], names=[*named.names, "cells"])

    each = pairs.mapInArrow(product, kind).select(*by, "bi", "bj", F.explode("cells").alias("x"))
    return each.groupBy(*by, (F.col("bi") * tile + F.col("x.r")).alias("i"), (F.col("bj") * tile + F.col("x.c")).alias("j")).agg(F.sum("x.v").alias("value"))
