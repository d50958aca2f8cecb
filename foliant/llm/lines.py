"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, checkpoint, join_hot
from foliant.llm.runs import Levels
from foliant.operators.store import Store, Transaction, Version, transact

#: What is stripped from a line's ends, as a set of bytes.
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _points(key: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(key.decode("utf-8", "replace"))


def line_hashes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, hash): each long enough line key once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {_hash(k) for k in map(line_key, (t.as_py() or b"").split(b"\n")) if len(k) >= min_chars and _points(k) >= min_chars}
                hashes += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "hash"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, hash binary")


def line_runs(scratch: Scratch, *, fanout: int = 4) -> Levels:
    """An index of line hashes: in how many documents a line is found, and the last of them. Documents of different batches are different documents."""
    return Levels(scratch, "lines", ["hash"], {"n_docs": "sum", "last_doc": "max"}, fanout=fanout)


def per_line(batch: DataFrame) -> DataFrame:
    """(hash, n_docs, last_doc) of distinct (doc_id, hash)."""
    return batch.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


#: Rows of a batch, about; a table of up to four of them goes into the runs in four.
BATCH_DOCS = 50_000_000


def lost_lines(pairs: DataFrame, often: DataFrame, total: int) -> DataFrame:
    """(lost_id, hashes): the hashes each document of (doc_id, hash) loses to a later one. ``often``: hash, n_docs, last_doc."""
    met = join_hot(pairs.select("doc_id", "hash"), often, ["hash"], "n_docs", total)
    return met.where("doc_id <> last_doc").groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_list("hash").alias("hashes"))


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """(lost_id, hashes): the line hashes each document loses, for documents that lose any; checkpointed.

    The table goes into the runs in batches by key hash (four, or as many as BATCH_DOCS asks for); each is anti-joined with the runs before
    it. Whether a line is found in ``min_docs`` documents is known only after the last batch, so documents are joined with the lines then.
    """
    batches = batches or max(4, -(-docs.count() // BATCH_DOCS))
    scratch = Scratch(docs.sparkSession)
    pairs = line_hashes(docs, key=key, text=text, min_chars=min_chars).where("doc_id is not null").distinct()
    pairs = scratch.write(pairs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "pairs", by="batch")
    index = line_runs(scratch, fanout=fanout)
    for b in range(batches):
        index.add(per_line(pairs.where(F.col("batch") == b)))
    often = scratch.write(index.all().where(F.col("n_docs") >= min_docs), "often")
    lost = checkpoint(lost_lines(pairs, often, pairs.count()))
    scratch.drop()
    return lost


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None) -> DataFrame:
    """Each whole text without the repeated lines that another, later document keeps.

    Adds to the key: n_lines (before), n_dropped and kept (the text left). A line's key is the line without white space at
    its ends, A-Z lower-cased; keys of ``min_chars`` code points found in ``min_docs`` documents lose all
    their lines except in the largest key's document.

    * Null and empty texts are one empty line. A text with nothing left keeps the empty string.
    * Rows that repeat a key are one document: their lines count once and stay or go together.
      Rows with a null key lose nothing and count for nothing. Empty tables give empty results.
    * Bytes that are not UTF-8 stay as they are. Columns other than key and text are ignored, whatever their names.
    """
    lost = repeated_lines(docs, key=key, text=text, min_chars=min_chars, min_docs=min_docs, batches=batches)
    return drop_lines(docs, lost, key=key, text=text, min_chars=min_chars)


def drop_lines(docs: DataFrame, lost: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """Texts without the lines of ``lost`` (lost_id, hashes): doc_id, n_lines, n_dropped and kept."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n_lines, n_dropped, kept = [], [], []
            for t, gone in zip(batch.column(1), batch.column(2), strict=True):
                lines = (t.as_py() or b"").split(b"\n")
                n_lines.append(len(lines))
                if gone.is_valid:
                    gone = set(gone.as_py())
                    lines = [x for x in lines if len(k := line_key(x)) < min_chars or _hash(k) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    joined = slim.join(lost, slim["doc_id"] == lost["lost_id"], "left").select("doc_id", "text", "hashes")
    out = joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))  # the engine's cast keeps bytes that are not UTF-8


def sql_line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


class _Runs:
    """Writes runs as tables of a transaction; they go with the versions that name them."""

    def __init__(self, transaction: Transaction, entry: str):
        self.transaction, self.entry = transaction, entry

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.transaction.write(self.entry, name, df)

    def drop(self, name: str) -> None:
        pass


class LineIndex:
    """Line runs that are kept between calls, in a transactional store: how many documents hold a line, and the last of them.

    Each call of ``add`` is one commit: the new documents' lines are merge-anti-joined with the stored runs, those that none of them has become a
    run of their own, and a level that is full is compacted into the next. A writer that dies leaves the index as it was.
    Documents must be added once each; those without an id are left out. ``store.vacuum`` removes runs that no version names.
    """

    ENTRY = "lines"

    def __init__(self, spark: SparkSession, path: str, *, min_chars: int = 20, fanout: int = 4):
        self.spark, self.store, self.min_chars, self.fanout = spark, Store(spark, path), min_chars, fanout

    def runs(self, version: Version | None = None, transaction: Transaction | None = None) -> Levels:
        """The levels of a version, each run read from its files."""
        held = (version or self.store.version()).entries.get(self.ENTRY, {"tables": {}, "levels": [], "again": [], "written": 0})
        out = line_runs(_Runs(transaction, self.ENTRY), fanout=self.fanout)
        read = lambda name: (name, self.spark.read.parquet(held["tables"][name]))
        out.levels, out.again, out.written = [[read(n) for n in level] for level in held["levels"]], [read(n) for n in held["again"]], held["written"]
        return out

    def add(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Version:
        rows = per_line(line_hashes(docs, key=key, text=text, min_chars=self.min_chars).where("doc_id is not null").distinct())

        def change(t: Transaction) -> None:
            index = self.runs(t.base, t)
            index.add(rows)
            if len(index.again) >= self.fanout:  # what batches said of known lines, as one
                index.again = [index.written_again()]
            old = t.base.entries.get(self.ENTRY, {"tables": {}})["tables"]
            names = [[n for n, _ in level] for level in index.levels], [n for n, _ in index.again]
            tables = old | t.put_.get(self.ENTRY, {"tables": {}})["tables"]
            kept = {n: tables[n] for level in [*names[0], names[1]] for n in level}
            t.put_[self.ENTRY] = {"tables": kept, "levels": names[0], "again": names[1], "written": index.written}

        return transact(self.store, change)

    def dedup(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = 3, version: Version | None = None) -> DataFrame:
        """``dedup_lines`` of some of the added documents, judged by all that have been added."""
        index = self.runs(version)
        pairs = line_hashes(docs, key=key, text=text, min_chars=self.min_chars).where("doc_id is not null").distinct()
        lost = pairs.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_list("hash").alias("hashes")).limit(0)
        if index.runs():
            lost = lost_lines(pairs, index.all().where(F.col("n_docs") >= min_docs), pairs.count())
        return drop_lines(docs, lost, key=key, text=text, min_chars=self.min_chars)
