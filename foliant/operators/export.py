"""Layout documents, layout exports and snapshots."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse
from foliant.operators.store import Store, Version, transact


def absolute_box(bbox: Column, width: Column, height: Column) -> Column:
    """[left, bottom, right, top] in page units from the lower left corner, to one digit."""
    one = lambda v: F.round(v, 1)
    return F.array(one(bbox["x"] * width), one(height - (bbox["y"] + bbox["height"]) * height), one((bbox["x"] + bbox["width"]) * width), one(height - bbox["y"] * height))


def kids(chunk_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """One element a chunk, numbered from 1 in document order; which fields it has depends on its type.

    A list has one child with the whole content, since the content is on one line by then.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "chunk_ord")
    c = chunk_rows.join(pages.select("doc_id", "page_number", "width", "height"), ["doc_id", "page_number"], "left").withColumn("kid_id", F.row_number().over(order))
    content, kind = collapse(F.col("text")), F.col("element_type")
    styled = lambda v: F.when(kind != "image", v)
    styled_text = lambda v: F.when(~kind.isin("image", "list"), v)
    where = absolute_box(F.col("bbox"), F.col("width"), F.col("height"))
    child = F.struct(
        F.lit("paragraph").alias("type"), F.concat(F.col("kid_id").cast("string"), F.lit("1")).cast("int").alias("id"), F.col("page_number").alias("page number"), where.alias("bounding box"),
        F.lit("Unknown").alias("font"), F.lit(0).alias("font size"), F.lit("[0,0,0]").alias("text color"), content.alias("content"),
    )
    kid = F.struct(
        kind.alias("type"), F.col("kid_id").alias("id"), F.col("page_number").alias("page number"), where.alias("bounding box"),
        F.when(kind == "heading", F.coalesce("heading_level", F.lit(2))).alias("heading level"), styled_text(F.lit("Unknown")).alias("font"), styled_text(F.lit(0)).alias("font size"),
        styled_text(F.lit("[0,0,0]")).alias("text color"), styled(content).alias("content"), F.when((kind == "list") & (content != ""), F.array(child)).alias("kids"),
        F.when(kind == "image", F.when(content == "", "Image region").otherwise(content)).alias("alt"),
    )
    return c.select("doc_id", "kid_id", kid.alias("kid"))


def layout_documents(kid_rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """(doc_id, document): ``bundles`` has file_name, page_count, author, title, created and modified."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("kid_id", F.to_json("kid").alias("json")))), lambda k: k["json"])
    k = kid_rows.groupBy("doc_id").agg(ordered.alias("kids"))
    head = F.struct(F.col("file_name").alias("file name"), F.col("page_count").alias("number of pages"), "author", "title", F.col("created").alias("creation date"), F.col("modified").alias("modification date"))
    text = F.to_json(head, {"ignoreNullFields": "false"})
    document = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"kids":['), F.array_join(F.coalesce("kids", F.array().cast("array<string>")), ","), F.lit("]}"))
    return bundles.join(k, "doc_id", "left").select("doc_id", document.alias("document"))


def layout_exports(chunk_rows: DataFrame, section_rows: DataFrame, pages: DataFrame, documents: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, file_name, payload): everything about a document as one JSON text."""
    c = chunk_rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "chunk_ord", F.struct("id", F.col("page_number").alias("pageNumber"), "snippet", "text", "bbox", F.col("element_type").alias("elementType"), F.col("heading_level").alias("headingLevel")).alias("chunk")))), lambda x: x["chunk"]).alias("chunks"))
    s = section_rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", F.struct("heading", F.col("page_number").alias("pageNumber"), "text", F.col("chunk_ids").alias("chunkIds")).alias("section")))), lambda x: x["section"]).alias("sections"))
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("pageNumber"), "width", "height", "summary", F.col("layout_source").alias("layoutSource"), F.col("block_count").alias("blockCount")))).alias("pages"))
    j = titles.join(c, "doc_id", "left").join(s, "doc_id", "left").join(p, "doc_id", "left").join(documents, "doc_id", "left")
    payload = F.concat(
        F.lit('{"title":'), F.regexp_replace(F.to_json(F.struct("title")), r'^\{"title":|\}$', ""), F.lit(',"pageCount":'), F.coalesce(F.size("pages"), F.lit(0)).cast("string"),
        F.lit(',"savedAt":"'), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('","sectionChunks":'), F.coalesce(F.to_json("sections"), F.lit("[]")),
        F.lit(',"layoutDocument":'), F.coalesce("document", F.lit("null")), F.lit(',"pages":'), F.coalesce(F.to_json("pages"), F.lit("[]")), F.lit(',"chunks":'), F.coalesce(F.to_json("chunks"), F.lit("[]")), F.lit("}"),
    )
    return j.select("doc_id", F.concat(F.regexp_replace("title", r"(?i)\.pdf$", ""), F.lit(".layout.json")).alias("file_name"), payload.alias("payload"))


def newest(manifest: DataFrame, most: int | None = None) -> DataFrame:
    """Snapshots of a manifest, the last saved first, ties by the larger id."""
    out = manifest.orderBy(F.desc("saved_at"), F.desc("snapshot_id"))
    return out if most is None else out.limit(most)


def snapshot(rows: DataFrame, snapshot_id) -> DataFrame:
    """The rows of one snapshot; partitioned tables are pruned to it."""
    return rows.where(F.col("snapshot_id") == F.lit(snapshot_id))


class SnapshotStore:
    """Snapshots of a session's tables. Each save is one commit of a transactional store: it is there as a whole or not at all,
    readers of a version are not disturbed, and of two writers of one snapshot the second saves on top of the first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def save(self, tables: dict[str, DataFrame], snapshot_id: str, title: str, page_count: int) -> Version:
        """Upsert by id."""
        facts = {"saved_at": time.time_ns() // 1_000_000, "title": title, "page_count": page_count}
        return transact(self.store, lambda t: t.put(snapshot_id, tables, **facts))

    def delete(self, snapshot_id: str) -> Version:
        return transact(self.store, lambda t: t.remove(snapshot_id))

    def load(self, name: str, snapshot_id: str, version: Version | None = None) -> DataFrame:
        """A table of one snapshot, of the last version or of one that was opened before; without rows if there is no such snapshot."""
        v = version or self.store.version()
        if snapshot_id in v.entries:
            return self.store.read(name, v, snapshot_id).withColumn("snapshot_id", F.lit(snapshot_id))
        return self.store.read(name, v).limit(0).withColumn("snapshot_id", F.lit(snapshot_id))

    def list(self, version: Version | None = None) -> DataFrame:
        v = version or self.store.version()
        rows = [(e["saved_at"], e["title"], e["page_count"], k) for k, e in v.entries.items()]
        return newest(self.spark.createDataFrame(rows, "saved_at long, title string, page_count long, snapshot_id string"))
