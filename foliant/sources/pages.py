"""Pages of documents from outside: extracted text items as JSON, PDF files where a parser is at hand, and raw page images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest side of a page image that is analysed.
PAGE_SIDE = 1008
ITEMS = "array<struct<item_ord:int,text:string,bbox:struct<x:double,y:double,width:double,height:double>>>"
BUNDLE = "path string, file_name string, page_count int, author string, title string, created string, modified string, page_number int, text string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_number, items, image) of JSON lines, as ``layout.analyze`` takes them.

    A line without items is a page without text; an unreadable line is skipped. ``image`` (base64 of what a
    renderer made, or null) is only decoded by queries that use it.
    """
    raw = spark.read.schema(f"doc_id long, page_number int, items {ITEMS}, image string").option("mode", "DROPMALFORMED").json(path)
    items = F.filter(F.coalesce("items", F.array().cast(ITEMS)), lambda i: F.coalesce(F.trim(i["text"]), F.lit("")) != "")
    return raw.where("doc_id is not null").select("doc_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), items.alias("items"), F.unbase64("image").alias("image"))


def pdf_reader(content: bytes) -> tuple[dict, list[str]]:
    """(metadata, text of each page) with pypdf, if it is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF parser is installed; pass one as extract=") from e
    reader = PdfReader(io.BytesIO(content))
    try:
        meta = {k: str(v) for k, v in (("author", reader.metadata.author), ("title", reader.metadata.title), ("created", reader.metadata.get("/CreationDate")), ("modified", reader.metadata.get("/ModDate"))) if v}
    except Exception:  # metadata is best effort, as its fields are often broken
        meta = {}
    return meta, [p.extract_text() or "" for p in reader.pages]


def pdf_bundles(files: DataFrame, extract: Callable[[bytes], tuple[dict, list[str]]] = pdf_reader) -> DataFrame:
    """A row a page of (path, file_name, content): the file's metadata (null where unknown), page count, page and text.

    Files are read whole, one at a time in each task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, name, content in zip(part["path"], part["file_name"], part["content"], strict=True):
                meta, pages = extract(bytes(content))
                own = {k: meta.get(k) for k in ("author", "title", "created", "modified")}
                yield pd.DataFrame([{"path": path, "file_name": name, "page_count": len(pages), **own, "page_number": k, "text": t} for k, t in enumerate(pages, 1)], columns=[c.split()[0] for c in BUNDLE.split(", ")])

    return files.select("path", "file_name", "content").mapInPandas(run, BUNDLE)


def page_images(rasters: DataFrame, longest: int = PAGE_SIDE) -> DataFrame:
    """(doc_id, page_number, width, height, data) of RGBA rasters, resized so that the longest side is ``longest``."""
    from foliant.functions.vision import fitted, resized

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                pixels = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, 4)
                w, h = fitted(row.width, row.height, longest)
                data = np.clip(np.floor(resized(pixels, w, h) + 0.5), 0, 255).astype(np.uint8).tobytes()
                yield pd.DataFrame([{"doc_id": row.doc_id, "page_number": row.page_number, "width": w, "height": h, "data": data}])

    return rasters.select("doc_id", "page_number", "width", "height", "data").mapInPandas(run, "doc_id long, page_number int, width int, height int, data binary")
