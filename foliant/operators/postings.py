"""Posting lists of trigrams: which texts contain a term, from the rarest of its trigrams instead of from all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the characters of which terms consist; trigrams with others are not filed.
TERM_CHARACTERS = "a-z0-9_/.:-"


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text that can be part of a term."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{TERM_CHARACTERS}]{{3,}})"), 1)
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(runs), _parts)))


def _parts(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 2), lambda k: F.substring(word, k, F.lit(3)))


class TermIndex:
    """``postings``: gram, key, sorted by gram. ``frequencies``: gram, n (texts that contain it): about 68,000 rows at most."""

    def __init__(self, postings: DataFrame, frequencies: DataFrame, texts: DataFrame, key: str):
        self.postings, self.frequencies, self.texts, self.key = postings, frequencies, texts, key

    @classmethod
    def build(cls, texts: DataFrame, path: str, *, key: str, text: str = "text") -> TermIndex:
        """File whole texts and save the index with the lower-cased texts, by which terms of more than three characters are verified.

        Null texts contain nothing. Keys must tell texts apart; rows with a null key take no part.
        """
        kept = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("low"))
        kept.write.parquet(f"{path}/texts")
        spark = texts.sparkSession
        kept = spark.read.schema(kept.schema).parquet(f"{path}/texts")
        filed = kept.select(F.explode(trigrams(F.col("low"))).alias("gram"), "key")
        # The key too is part of the range, so that the list of a common gram is spread over several files.
        filed.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/frequencies")
        return cls.open(spark, path, key=key)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, key: str) -> TermIndex:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "frequencies", "texts")], key)

    def rarest(self, terms: DataFrame) -> DataFrame:
        """(term, gram, n) of (term): the trigram of a term that the fewest texts contain; terms with one that none contains are left out."""
        grams = terms.select("term", F.explode(F.array_distinct(_parts(F.col("term")))).alias("gram")).join(self.frequencies, "gram", "left")
        return grams.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")

    def chosen(self, queries: DataFrame, *, above: float) -> DataFrame:
        """(query_id, gram, n): the lists that ``overlaps`` reads."""
        own = queries.select("query_id", F.size("terms").alias("size"), F.explode("terms").alias("term"))
        rare = own.join(self.rarest(own.select("term").distinct()), "term", "left").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "term")))
        needed = rare.where((F.col("nth") <= F.col("size") - F.floor(F.col("size") * above)) & F.col("gram").isNotNull())
        return needed.select("query_id", "gram", "n").distinct()

    def overlaps(self, queries: DataFrame, *, above: float) -> DataFrame:
        """(query_id, key, overlap) of texts that contain more than the share ``above`` of a query's terms: (query_id, terms).

        A text that contains more than this share of n terms contains one at least of any n - floor(n * above), so candidates
        come from the lists of that many terms, those of the rarest trigrams; all other terms are looked for in the
        candidates' texts. Terms have three characters or more, as ``query_terms`` gives them.

        * Queries without terms and texts that are null have no overlap. Repeated query ids are one query.
        """
        q = queries.where(F.size("terms") > 0).select("query_id", "terms").dropDuplicates(["query_id"])
        found = self.chosen(q, above=above).select("query_id", "gram").join(self.postings, "gram").select("query_id", "key").distinct()
        met = found.join(self.texts, "key").join(q, "query_id")
        share = F.size(F.filter("terms", lambda t: F.contains(F.col("low"), t))) / F.size("terms")
        return met.select("query_id", F.col("key").alias(self.key), share.alias("overlap")).where(F.col("overlap") > above)
