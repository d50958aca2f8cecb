"""An index that follows its documents: only what has changed is laid out and embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import embedding
from foliant.operators.store import Store, Transaction, Version, transact
from foliant.plans.api import Engine

INDEX_TABLES = ("chunks", "pages", "titles")


def content_hash(text: Column, title: Column) -> Column:
    """Of all that an index takes from a document; null is told from empty."""
    known = F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (text, title)])
    return F.sha2(known.cast("binary"), 256)


class LiveIndex:
    """Generations of an index in a transactional store.

    Each update is one commit. It adds a generation: tables of the documents that are new or differ from what is indexed, by the hash of
    their contents, and a marker for each document that is gone. Of a document the last generation holds. Readers of
    a version see it whole; ``compact`` writes what holds as one generation.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def states(self, version: Version | None = None) -> DataFrame:
        """(doc_id, generation, hash, deleted): the last word on every document that was ever indexed."""
        rows = self.store.read("changes", version)
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, generation int, hash string, deleted boolean")
        last = F.max_by(F.struct("hash", "deleted"), F.col("generation"))
        return rows.groupBy("doc_id").agg(F.max("generation").alias("generation"), last.alias("s")).select("doc_id", "generation", "s.*")

    def live(self, version: Version | None = None) -> DataFrame:
        return self.states(version).where(~F.col("deleted")).drop("deleted")

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        """Rows of the documents that the version holds, with their generation."""
        v = version or self.store.version()
        return self.store.read(name, v).join(self.live(v).select("doc_id", "generation"), ["doc_id", "generation"], "left_semi")

    def engine(self, version: Version | None = None) -> Engine:
        v = version or self.store.version()
        return Engine(*[self.table(name, v).drop("generation") for name in INDEX_TABLES])

    def update(self, docs: DataFrame, *, whole: bool = True, deleted: DataFrame | None = None, embed: Callable = embedding.embed) -> Version:
        """Bring the index to (doc_id, text, title); returns the version, the present one if nothing has changed.

        With ``whole``, documents that are not among the rows are gone; without it only those of ``deleted`` (doc_id) are.
        Hashes are compared first, so unchanged texts are read but never moved, laid out or embedded.

        * Rows without a doc_id are left out; of rows that repeat one, that with the largest hash is indexed.
        * A document that comes back is indexed anew. Null and empty texts have one page. An empty table empties the index.
        * If another writer commits first, the update is made again on top of that.
        """
        hashed = docs.where("doc_id is not null").select("doc_id", "text", "title", content_hash(F.col("text"), F.col("title")).alias("hash"))
        now = hashed.groupBy("doc_id").agg(F.max("hash").alias("hash"))

        def change(t: Transaction) -> None:
            known = self.live(t.base).select("doc_id", F.col("hash").alias("was"))
            both = now.join(known, "doc_id", "full_outer")
            fresh = both.where("hash is not null and (was is null or hash <> was)").select("doc_id", "hash")
            gone = both.where("hash is null").select("doc_id") if whole else known.select("doc_id").limit(0)
            if deleted is not None:
                gone = gone.unionByName(known.join(deleted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")).distinct()
            self._add(t, hashed, fresh, gone, embed)

        t = self.store.begin()
        change(t)
        if not self._changed(t):
            return t.base
        try:
            return t.commit()
        except Exception as e:
            if type(e).__name__ != "Conflict":
                raise
            return transact(self.store, change)

    @staticmethod
    def _generation(t: Transaction) -> int:
        return 1 + max((e["generation"] for e in t.base.entries.values()), default=0)

    def _changed(self, t: Transaction) -> bool:
        (entry,) = t.put_.values()
        return bool(self.spark.read.parquet(entry["tables"]["changes"]).take(1))

    def _add(self, t: Transaction, hashed: DataFrame, fresh: DataFrame, gone: DataFrame, embed: Callable) -> None:
        number = self._generation(t)
        entry, generation = f"g{number:08d}", F.lit(number).alias("generation")
        changes = fresh.select("doc_id", generation, "hash", F.lit(False).alias("deleted"))
        changes = t.write(entry, "changes", changes.unionByName(gone.select("doc_id", generation, F.lit(None).cast("string").alias("hash"), F.lit(True).alias("deleted"))))
        picked = hashed.join(changes.where("not deleted").select("doc_id", "hash"), ["doc_id", "hash"], "left_semi")
        one = Window.partitionBy("doc_id").orderBy("hash")
        docs = picked.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("doc_id", "text", "title")
        made = Engine.index(docs, embed=embed)
        chunks = t.write(entry, "chunks", made.chunks.withColumn("generation", generation))
        t.write(entry, "pages", Engine.pages_of(chunks).withColumn("generation", generation))
        t.write(entry, "titles", made.titles.withColumn("generation", generation))
        t.put_[entry]["generation"] = number

    def compact(self) -> Version:
        """One generation of what holds; older versions stay readable until ``store.vacuum``."""

        def change(t: Transaction) -> None:
            number = self._generation(t)
            entry, generation = f"g{number:08d}", F.lit(number).alias("generation")
            t.write(entry, "changes", self.live(t.base).select("doc_id", generation, "hash", F.lit(False).alias("deleted")))
            for name in INDEX_TABLES:
                t.write(entry, name, self.table(name, t.base).withColumn("generation", generation))
            t.put_[entry]["generation"] = number
            for old in t.base.entries:
                t.remove(old)

        return transact(self.store, change)
