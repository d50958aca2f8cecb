"""Text items to lines, chunks, typed elements, pages and sections."""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant import schemas
from foliant.functions.text import WS, collapse, count_of, has, snippet, strip, words_of
from foliant.functions.vectors import let

FALLBACK_TEXT = "[Image page — no text layer detected]"
PENDING_TEXT = "[Image-only page pending text recognition]"
# The box of a page without text, and line-sorting tolerances.
FALLBACK_BOX = (0.08, 0.08, 0.84, 0.84)
SAME_ROW, SAME_LINE = 0.012, 0.018


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def fallback_box() -> Column:
    return box(*map(F.lit, FALLBACK_BOX))


def normalized_box(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A box in page units as shares of the page, each clamped to [0, 1]."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return box(clamp(x / page_width), clamp(y / page_height), clamp(width / page_width), clamp(height / page_height))


def item_box(transform: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """The box of a text item from its affine matrix [a, b, c, d, e, f] in view coordinates."""
    font = F.greatest(F.hypot(transform[2], transform[3]), F.coalesce(height, F.lit(0.0)))
    return normalized_box(transform[4], transform[5] - font, F.coalesce(width, font), font, page_width, page_height)


def union_box(b: Column) -> Column:
    """Aggregate: the box around all boxes, null for none."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return F.when(x.isNotNull(), box(x, y, F.max(b["x"] + b["width"]) - x, F.max(b["y"] + b["height"]) - y))


def union_boxes(boxes: Column) -> Column:
    """The box around all boxes of an array, null for none."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, low = F.array_max(F.transform(boxes, lambda b: b["x"] + b["width"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["height"]))
    return F.when(x.isNotNull(), box(x, y, right - x, low - y))


def text_pages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, page_number, items): plain text laid out on pages of 40 lines; blank lines leave gaps.

    Pages stay in their document's row until they are exploded, so nothing is shuffled. A null text has one page without items.
    """
    n = schemas.PAGE_LINES
    paged = lambda lines: F.transform(F.sequence(F.lit(0), F.ceil(F.size(lines) / n).cast("int") - 1), lambda p: F.slice(lines, p * n + 1, n))
    pages = let(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), paged)  # split once a document, not once a page
    out = docs.select(F.col(key).alias("doc_id"), F.posexplode(pages).alias("p", "part"))
    items = F.transform(F.transform("part", collapse), lambda t, i: F.struct(i.cast("int").alias("item_ord"), t.alias("text"), box(F.lit(0.08), i / n, F.least(F.lit(0.84), F.length(t) / 100), F.lit(0.015)).alias("bbox")))
    return out.select("doc_id", (F.col("p") + 1).cast("int").alias("page_number"), F.filter(items, lambda x: x["text"] != "").alias("items"))


def text_items(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_number", F.explode("items").alias("i")).select("doc_id", "page_number", "i.item_ord", "i.text", "i.bbox")


def page_records(items: DataFrame) -> DataFrame:
    """One row a page with items: its raw text and the box around them."""
    ordered = F.array_sort(F.collect_list(F.struct("item_ord", "text")))
    return items.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda i: i["text"]), " ").alias("raw_text"), union_box(F.col("bbox")).alias("aggregate_box"), F.count(F.lit(1)).alias("n_items"))


def recognized(pages: DataFrame, recognizer) -> DataFrame:
    """Pages with items as they are, those without as ``recognizer`` gives them."""
    empty = F.size("items") == 0
    return pages.where(~empty).unionByName(recognizer(pages.where(empty)))


def analyze(pages: DataFrame, recognizer=None) -> DataFrame:
    """Blocks of a page: its items, or one placeholder over most of the page if it has none.

    ``recognizer``, if given, maps the frame of pages without items to one with items (of the same columns).
    """
    empty = F.size("items") == 0
    if recognizer is not None:
        pages = recognized(pages, recognizer)
    placeholder = F.array(F.struct(F.lit(0).alias("item_ord"), F.lit(PENDING_TEXT).alias("text"), fallback_box().alias("bbox")))
    source = F.when(empty, "pdf.js-fallback").otherwise("pdf.js-text-layer")
    pages = pages.withColumn("source", source).withColumn("items", F.when(empty, placeholder).otherwise(F.col("items")))
    return pages.withColumn("document_box", union_boxes(F.transform("items", lambda i: i["bbox"])))


def _in_order(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Places of items (given by item_ord) by row and column. Where rows lie apart, the tolerant order is a total one and two plain sorts say it."""
    by_y = np.argsort(ys, kind="stable")
    row = np.concatenate(([0], np.cumsum(np.diff(ys[by_y]) > SAME_ROW)))
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    lasts = np.concatenate((firsts[1:] - 1, [len(ys) - 1]))
    if (ys[by_y[lasts]] - ys[by_y[firsts]] <= SAME_ROW).all() and not np.isnan(xs).any():
        of = np.empty(len(ys), np.int64)
        of[by_y] = row
        return np.lexsort((xs, of))

    def order(a: int, b: int) -> float:
        dy = ys[a] - ys[b]
        return dy if abs(dy) > SAME_ROW else xs[a] - xs[b]

    return np.array(sorted(range(len(ys)), key=cmp_to_key(order)))


def _lines_of_page(items: pd.DataFrame) -> pd.DataFrame:
    given = np.argsort(items["item_ord"].to_numpy(), kind="stable")
    sides = np.stack([items[c].to_numpy()[given] for c in ("x", "y", "width", "height")], axis=1)
    at = _in_order(sides[:, 0], sides[:, 1])
    lines: list[list] = []  # anchor, texts, box
    texts, boxes = items["text"].to_numpy()[given[at]].tolist(), sides[at].tolist()
    for text, (x, y, w, h) in zip(texts, boxes, strict=True):
        if not lines or abs(y - lines[-1][0]) > SAME_LINE:
            lines.append([y, [text], (x, y, w, h)])
            continue
        own = lines[-1]
        own[1].append(text)
        ax, ay, aw, ah = own[2]
        lx, ly = min(ax, x), min(ay, y)
        own[2] = (lx, ly, max(ax + aw, x + w) - lx, max(ay + ah, y + h) - ly)
    boxed = np.array([line[2] for line in lines])
    own_page = {c: np.repeat(items[c].to_numpy()[:1], len(lines)) for c in ("doc_id", "page_number")}
    own_lines = {"line_ord": np.arange(len(lines)), "text": [" ".join(" ".join(line[1]).split()) for line in lines]}
    return pd.DataFrame(own_page | own_lines | {c: boxed[:, k] for k, c in enumerate(("x", "y", "width", "height"))})


def group_lines(items: DataFrame) -> DataFrame:
    """Items sorted by row and column with tolerances, then joined to lines by the height of a line's first item.

    The order is no total order and a line's anchor is its first item, so neither a sort nor a window says it:
    each page is folded in Arrow batches, with boxes as plain columns.
    """
    sides = ["x", "y", "width", "height"]
    flat = items.select("doc_id", "page_number", "item_ord", "text", *[F.col("bbox")[c].alias(c) for c in sides])
    lines = flat.groupBy("doc_id", "page_number").applyInPandas(_lines_of_page, "doc_id bigint, page_number int, line_ord int, text string, x double, y double, width double, height double")
    return lines.select("doc_id", "page_number", "line_ord", "text", box(*[F.col(c) for c in sides]).alias("bbox"))


def pages_of_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, lines) of exploded lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_ord", "text", "bbox")))
    return lines.groupBy("doc_id", "page_number").agg(F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("lines"))


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, lines) of pages whose items are whole lines already, as those of ``text_pages``."""
    return pages.select("doc_id", "page_number", F.transform("items", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("lines"))


def chunk_of_line(lines: Column, chars: int = schemas.CHUNK_CHARS, gap: float = schemas.CHUNK_GAP) -> Column:
    """The chunk, from 0, of each line: greedy, closed by a gap or by its joined length."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("y"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        size, y = F.length(line["text"]), line["bbox"]["y"]
        joined = F.when(s["chars"] > 0, s["chars"] + 1 + size).otherwise(size)
        close = (s["n"] > 0) & ((F.abs(y - s["y"]) > gap) | (joined > chars))
        chunk = F.when(close, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(close, size).otherwise(joined).alias("chars"), F.when(close, 1).otherwise(s["n"] + 1).alias("n"), y.alias("y"), F.array_append(s["out"], chunk).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def chunks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, lines) to typed chunks; a page without lines gives one fallback chunk. Nothing is shuffled."""
    of = pages.withColumn("of", chunk_of_line(F.col("lines")))
    parts = F.transform(F.sequence(F.lit(0), F.coalesce(F.array_max("of"), F.lit(0))), lambda k: F.filter("lines", lambda _, i: F.get(F.col("of"), i) == k))
    out = of.select("doc_id", "page_number", F.posexplode(parts).alias("chunk_ord", "lines"))
    empty = F.size("lines") == 0
    out = out.select(
        "doc_id", "page_number", "chunk_ord", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-c"), (F.col("chunk_ord") + 1).cast("string")).alias("id"),
        F.when(empty, FALLBACK_TEXT).otherwise(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("text"),
        F.when(empty, fallback_box()).otherwise(union_boxes(F.transform("lines", lambda x: x["bbox"]))).alias("bbox"),
        F.greatest(F.size("lines"), F.lit(1)).alias("block_count"), F.size("lines").alias("line_count"), "lines", empty.alias("is_fallback"),
    )
    kind = element_type(F.col("text"), F.col("lines"), F.col("bbox"), F.col("line_count"), F.col("is_fallback"))
    out = out.withColumn("snippet", snippet(F.col("text"))).withColumn("element_type", kind)
    return out.withColumn("heading_level", F.when(F.col("element_type") == "heading", heading_level(F.col("bbox")["y"])))


def is_list_like(lines: Column) -> Column:
    hits = F.size(F.filter(lines, lambda x: F.regexp_like(x["text"], F.lit(rf"^(?:\x{{2022}}|-|\*|[0-9]+[.)]){WS}+"))))
    return (F.size(lines) >= 2) & (hits >= F.greatest(F.lit(2), F.ceil(F.size(lines) * 0.6)))


def is_heading_like(text: Column, y: Column, line_count: Column) -> Column:
    s = collapse(text)
    ws = words_of(s)
    upper = count_of(s, "[A-Z]") / F.greatest(count_of(s, "[A-Za-z]"), F.lit(1))
    title = (F.size(ws) > 1) & (F.size(F.filter(ws, lambda w: F.regexp_like(w, F.lit("^[A-Z][a-z]")))) >= F.ceil(F.size(ws) * 0.6))
    fits = (s != "") & (F.length(s) <= 120) & (line_count <= 3) & ~has(s, "[.!?:;]$") & (F.size(ws) <= 14)
    return fits & ((upper > 0.24) | (title & (y < 0.28)))


def heading_level(y: Column) -> Column:
    return F.when(y < 0.12, 1).when(y < 0.25, 2).otherwise(3)


def element_type(text: Column, lines: Column, bbox: Column, line_count: Column, is_fallback: Column) -> Column:
    s = collapse(text)
    caption = has(s, rf"(?i)^(?:figure|fig\.?){WS}+[0-9]+[:.\-]?{WS}+") | has(s, rf"(?i)^table{WS}+[0-9]+[:.\-]?{WS}+")
    return F.when(is_fallback, "image").when(caption, "caption").when(is_list_like(lines), "list").when(is_heading_like(text, bbox["y"], line_count), "heading").otherwise("paragraph")


def index_pages(chunk_rows: DataFrame, source: str = "pdf.js-text-layer", raw: DataFrame | None = None) -> DataFrame:
    """One row a page: the snippet of its first chunk (or its raw text), and its number of blocks."""
    first = F.min_by("snippet", "chunk_ord")
    out = chunk_rows.groupBy("doc_id", "page_number").agg(F.nullif(first, F.lit("")).alias("first"), F.sum("block_count").alias("block_count"))
    spare = F.lit(None).cast("string")
    if raw is not None:
        out, spare = out.join(raw.select("doc_id", "page_number", "raw_text"), ["doc_id", "page_number"], "left"), snippet(F.col("raw_text"))
    summary = F.coalesce("first", F.nullif(spare, F.lit("")), F.lit("Image-heavy page"))
    return out.select("doc_id", "page_number", F.lit(schemas.PAGE_WIDTH).alias("width"), F.lit(schemas.PAGE_HEIGHT).alias("height"), summary.alias("summary"), F.lit(source).alias("layout_source"), "block_count")


def sections(chunk_rows: DataFrame) -> DataFrame:
    """A section begins at each heading; chunks before the first form one without a heading."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "chunk_ord")
    at = chunk_rows.withColumn("section_ord", F.sum(F.when(F.col("element_type") == "heading", 1).otherwise(0)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "chunk_ord", "id", strip(F.col("text")).alias("text"))))
    out = at.groupBy("doc_id", "section_ord").agg(F.min_by(F.struct("page_number", "element_type", "text"), F.struct("page_number", "chunk_ord")).alias("first"), parts.alias("parts"))
    return out.select(
        "doc_id", F.col("section_ord").cast("int").alias("section_ord"), F.when(F.col("first.element_type") == "heading", collapse(F.col("first.text"))).alias("heading"), F.col("first.page_number").alias("page_number"),
        strip(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("text"), F.transform("parts", lambda p: p["id"]).alias("chunk_ids"),
    )
