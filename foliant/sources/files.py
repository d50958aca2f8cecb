"""Files as sources and sinks: listings, size-limited reads, ranges, JSON and binary values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files above this many bytes are read but not cached.
CACHE_LIMIT = 8_000_000


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length) of all files below ``root``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, content) of the PDF files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def blobs(spark: SparkSession, root: str, *, cacheable_only: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= CACHE_LIMIT) if cacheable_only else files


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary."""
    return F.substring(content, start + 1, end - start)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; an empty file has a null text."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("text", F.nullif("text", F.lit("")))


def key_file_presence(key_files: DataFrame, files: DataFrame) -> DataFrame:
    """(path, exists): which of the wanted paths are in the listing."""
    return key_files.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").select("path", F.coalesce("_there", F.lit(False)).alias("exists"))


def write_keyed(df: DataFrame, path: str) -> None:
    """(key, value) binary values as a table keyed by the file name of each key."""
    from foliant.functions.text import encode_key

    df.withColumn("name", encode_key(F.col("key"))).write.mode("append").parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("key") == key)
