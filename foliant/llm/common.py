"""Shared plumbing: checkpoints in the shared folder, safe table reads, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _once(spark: SparkSession) -> Iterator[None]:
    """For plans that run only once: their shuffle files go as soon as the result is in the shared folder."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    checkpoint_dir(df.sparkSession)
    with _once(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that one run writes, rereads and drops.

    Tables that a returned DataFrame still reads stay; ``sweep`` removes them when the results are used.
    """

    left: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/foliant-{uuid.uuid4().hex}"
        Scratch.left.append(self.root)

    def write(self, df: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        with _once(self.spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        delete(self.spark, f"{self.root}/{name}".rstrip("/"))
        if not name and self.root in Scratch.left:
            Scratch.left.remove(self.root)


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Remove all scratch tables that operators of this process have left; their results cannot be read after that."""
    while Scratch.left:
        delete(spark, Scratch.left.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, the same in any engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Bits of the largest bit map that is broadcast (32 MB); beyond what it holds well it only lets more rows through.
MAX_BITMAP_BITS = 1 << 28


def bitmap(hashes: DataFrame, column: str, n: int) -> bytes:
    """A bit for each long in ``column`` by its lowest bits, in about 16 bits a value, at most MAX_BITMAP_BITS.

    Built by partial aggregation; the driver gets one row of 4 kB for each 32,768 bits.
    """
    bits = 1 << 15
    while bits < min(16 * max(n, 1), MAX_BITMAP_BITS):
        bits *= 2
    out = bytearray(bits // 8)
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    for r in rows.toLocalIterator():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = r["bits"]
    return bytes(out)


#: A key in more than one of so many rows is hot; fewer than so many keys are.
HOT_PARTS = 1000


def join_hot(rows: DataFrame, few: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """Inner join in which no key gathers many rows in one task.

    ``few`` has each key once, with the number of its rows in ``times`` (dropped). Keys in more than a
    thousandth of ``total`` rows are below a thousand and are broadcast; only the others are shuffled.
    """
    is_hot = F.col(times) * HOT_PARTS > total
    hot, cold = few.where(is_hot).drop(times), few.where(~is_hot).drop(times)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
