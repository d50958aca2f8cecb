"""Document profiles: a bounded summary of a document, and the part of it that helps a question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.quality import chunk_readability, is_formula_heavy, is_noisy, truncate_for_prompt
from foliant.functions.text import collapse, cut, strip

MAX_GROUPS, ENTRY_CHARS = 8, 200


def meta_groups(chunk_rows: DataFrame, most: int = MAX_GROUPS) -> DataFrame:
    """Chunks in up to ``most`` consecutive groups of equal size; unreadable chunks go unless too few would be left."""
    whole = Window.partitionBy("doc_id")
    scored = chunk_rows.withColumn("readability", chunk_readability(F.col("text")))
    prose = F.sum(F.when(F.col("readability") > 0, 1).otherwise(0)).over(whole)
    enough = prose >= F.least(F.lit(4), F.ceil(F.count(F.lit(1)).over(whole) * 0.2))
    pool = scored.withColumn("_enough", enough).where(~F.col("_enough") | (F.col("readability") > 0)).drop("_enough")
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(whole.orderBy("page_number", "chunk_ord"))
    out = pool.withColumn("_n", n).withColumn("_at", at)
    size = F.when(F.col("_n") <= most, 1).otherwise(F.ceil(F.col("_n") / most))
    return out.withColumn("group_ord", F.floor((F.col("_at") - 1) / size).cast("int")).drop("_n", "_at")


def meta_embeddings(grouped: DataFrame) -> DataFrame:
    """The readability-weighted mean of each group's vectors, of unit length. Vectors are of one length.

    Rows of a group that lie side by side are summed where they are, as arrays; a row for each such run is moved, never one a component.
    """
    parts = grouped.where(F.size("vector") > 0).select("doc_id", "group_ord", F.greatest("readability", F.lit(0.05)).cast("double").alias("w"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("doc_id", "group_ord")]
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(own[0]) != 0) | (np.diff(own[1]) != 0))))
            w, v = batch.column("w").to_numpy(zero_copy_only=False), batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            sums = np.empty((len(starts), v.shape[1]))
            for k, (a, z) in enumerate(zip(starts, [*starts[1:], batch.num_rows], strict=True)):
                sums[k] = w[a:z] @ v[a:z].astype(np.float64)
            lists = pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * v.shape[1], sums.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(starts)) for c in ("doc_id", "group_ord")), pa.array(np.add.reduceat(w, starts)), lists], names=["doc_id", "group_ord", "w", "s"])

    kind = {c: grouped.schema[c].dataType.simpleString() for c in ("doc_id", "group_ord")}
    runs = parts.mapInArrow(run, f"doc_id {kind['doc_id']}, group_ord {kind['group_ord']}, w double, s array<double>")
    from foliant.functions.vectors import add, l2_normalize, let

    made = runs.groupBy("doc_id", "group_ord").agg(F.sum("w").alias("w"), F.collect_list("s").alias("s"))
    total = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0)), add)
    mean = let(F.col("w"), lambda w: F.transform(total, lambda x: x / w))
    return made.select("doc_id", "group_ord", mean.alias("raw")).select("doc_id", "group_ord", l2_normalize(F.col("raw")).alias("meta"))


def memory_prompts(grouped: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, num_groups, memory_prompt): a title line and the most readable chunk of each group."""
    best = F.max_by("text", F.struct("readability", -F.col("page_number"), -F.col("chunk_ord")))
    groups = grouped.groupBy("doc_id", "group_ord").agg(collapse(best).alias("text"), F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.concat(F.lit("p."), F.col("a").cast("string"))).otherwise(F.concat(F.lit("p."), F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    line = F.concat(F.lit("["), label, F.lit("] "), cut(F.col("text"), ENTRY_CHARS), F.when(F.length("text") > ENTRY_CHARS, "…").otherwise(""))
    lines = F.array_sort(F.collect_list(F.when(F.length("text") >= 30, F.struct("group_ord", line.alias("line")))))
    made = groups.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_groups"), lines.alias("lines")).join(titles, "doc_id")
    head = F.concat(F.lit('Document: "'), F.col("title"), F.lit('"'))
    return made.select("doc_id", "num_groups", F.array_join(F.concat(F.array(head), F.transform("lines", lambda x: x["line"])), "\n").alias("memory_prompt"))


def parse_profiles(profiles: DataFrame) -> DataFrame:
    """(doc_id, title_line, ord, page_label, page_number, text, raw); the title line has entries after it."""
    lines = F.filter(F.transform(F.split("memory_prompt", "\n"), strip), lambda x: x != "")
    out = profiles.select("doc_id", F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("title_line"), F.posexplode(F.when(F.size(lines) > 1, F.slice(lines, F.lit(2), F.size(lines) - 1)).otherwise(F.array().cast("array<string>"))).alias("ord", "raw"))
    pattern = r"(?i)^\[(p\.[0-9]+(?:–[0-9]+)?)\]\s*(.*)$"
    label = F.nullif(F.regexp_extract("raw", pattern, 1), F.lit(""))
    out = out.withColumn("page_label", label).withColumn("page_number", F.regexp_extract("page_label", r"(?i)p\.([0-9]+)", 1).try_cast("int"))
    return out.withColumn("text", F.when(F.col("page_label").isNotNull(), F.regexp_extract("raw", pattern, 2)).otherwise(F.col("raw"))).where("text <> ''")


def entry_score(text: Column, label: Column, page: Column, terms: Column, pages: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit(" "), text))
    hits = F.aggregate(F.filter(terms, lambda t: F.contains(hay, t)), F.lit(0.0), lambda s, t: s + F.least(F.length(t), F.lit(6)))
    return hits - F.when(F.array_contains(pages, page), 0.75).otherwise(0.0) - F.when(is_noisy(text), 1.5).otherwise(0.0) - F.when(is_formula_heavy(text), 1.25).otherwise(0.0) + F.least(F.length(text) / 180, F.lit(1.0))


def rank_entries(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """Profile entries scored and ranked for each question: (query_id, doc_id, terms, pages) of the question's document."""
    scored = entries.join(questions, "doc_id").withColumn("score", entry_score(F.col("text"), F.col("page_label"), F.col("page_number"), F.col("terms"), F.coalesce(F.col("pages"), F.array().cast("array<int>"))))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("page_number"), "ord")))


def profile_context(ranked: DataFrame) -> DataFrame:
    """The prompt prefix of each question from its ranked entries; needs n_results and broad (the question is summary-like)."""
    broad = F.col("broad") | (F.col("n_results") == 0)
    most = F.when(broad, 4).otherwise(2)
    whole = Window.partitionBy("query_id")
    r = ranked.withColumn("_broad", broad).withColumn("_good", F.max(F.col("score") > 0).over(whole)).withColumn("_all", F.count(F.lit(1)).over(whole))
    chosen = r.where((F.col("rank") <= most) & ((F.col("score") > 0) | ~F.col("_good")))
    line = F.concat(F.when(F.col("page_label").isNotNull(), F.concat(F.lit("["), F.col("page_label"), F.lit("] "))).otherwise(""), F.when(F.col("_broad"), truncate_for_prompt(F.col("text"), 160)).otherwise(truncate_for_prompt(F.col("text"), 130)))
    out = chosen.groupBy("query_id").agg(F.first("title_line").alias("title"), F.first("_broad").alias("b"), F.first("_good").alias("g"), F.first("_all").alias("sections"), F.size(F.first("terms")).alias("n_terms"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("picked"))
    lines = F.concat(F.when(F.col("title") != "", F.array(truncate_for_prompt(F.col("title"), 90))).otherwise(F.array().cast("array<string>")), F.transform("picked", lambda x: x["line"]))
    reason = F.when(~F.col("g"), F.when(F.col("b"), "broad-context").otherwise("fallback")).when(F.col("n_terms") > 0, "query-match").when(F.col("b"), "broad-context").otherwise("global-context")
    return out.select("query_id", F.concat(F.lit("Document profile:\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("prefix"), reason.alias("reason"), F.col("sections").cast("int").alias("sections"), F.size(lines).alias("lines_used"))
