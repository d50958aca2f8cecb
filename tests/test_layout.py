"""Layout operators on inline pages."""

import pytest
from pyspark.sql import functions as F

from foliant import schemas
from foliant.operators import answer, export, layout, profile


def b(x, y, w=0.1, h=0.015):
    return {"x": x, "y": y, "width": w, "height": h}


def test_group_lines(spark):
    items = [(1, 1, 0, "second", b(0.5, 0.105)), (1, 1, 1, "first", b(0.1, 0.10)), (1, 1, 2, "near", b(0.7, 0.116)), (1, 1, 3, "next", b(0.1, 0.13)), (1, 1, 4, "last", b(0.1, 0.5))]
    out = layout.group_lines(spark.createDataFrame(items, schemas.TEXT_ITEMS)).orderBy("line_ord").collect()
    assert [r["text"] for r in out] == ["first second near", "next", "last"]
    assert out[0]["bbox"]["width"] == pytest.approx(0.7)


def pages(spark, *lines):
    rows = [(1, 1, [{"text": t, "bbox": b(0.08, y)} for t, y in lines])]
    return spark.createDataFrame(rows, f"doc_id bigint, page_number int, lines array<{schemas.LINE}>")


def test_chunk_rules(spark):
    near = layout.chunks(pages(spark, ("a", 0.0), ("b", 0.07), ("c", 0.16))).orderBy("chunk_ord").collect()
    assert [r["text"] for r in near] == ["a\nb", "c"]
    fits = layout.chunks(pages(spark, ("x" * 300, 0.0), ("y" * 319, 0.02))).collect()
    assert len(fits) == 1 and len(fits[0]["text"]) == 620
    over = layout.chunks(pages(spark, ("x" * 300, 0.0), ("y" * 320, 0.02))).collect()
    assert len(over) == 2
    whole = layout.chunks(pages(spark, ("z" * 900, 0.0))).collect()
    assert len(whole) == 1 and whole[0]["id"] == "p1-c1"


def test_empty_page(spark):
    (r,) = layout.chunks(pages(spark)).collect()
    assert (r["element_type"], r["line_count"], r["block_count"], r["is_fallback"]) == ("image", 0, 1, True)
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    laid = layout.analyze(layout.text_pages(docs))
    assert {r["source"] for r in laid.collect()} == {"pdf.js-fallback"}


@pytest.mark.parametrize(
    ("lines", "kind", "level"),
    [
        ([("- a", 0.5), ("- b", 0.51), ("- c", 0.52), ("- d", 0.53), ("- e", 0.54), ("f", 0.55)], "list", None),
        ([("1. a", 0.5), ("2) b", 0.51)], "list", None),
        ([("Figure 2: a plan", 0.5)], "caption", None),
        ([("Table 3. Results", 0.5)], "caption", None),
        ([("RESULTS AND MORE", 0.05)], "heading", 1),
        ([("The Main Result", 0.2)], "heading", 2),
        ([("Results In this", 0.4)], "paragraph", None),
        ([("X" * 121, 0.1)], "paragraph", None),
        ([("RESULTS:", 0.1)], "paragraph", None),
    ],
)
def test_element_types(spark, lines, kind, level):
    (r,) = layout.chunks(pages(spark, *lines)).collect()
    assert (r["element_type"], r["heading_level"]) == (kind, level)


def test_sections(spark):
    rows = [(1, 1, k, f"p1-c{k + 1}", t, kind) for k, (t, kind) in enumerate([("intro", "paragraph"), ("H1", "heading"), ("x", "paragraph"), ("y", "paragraph"), ("H2", "heading"), ("H3", "heading")])]
    out = layout.sections(spark.createDataFrame(rows, "doc_id long, page_number int, chunk_ord int, id string, text string, element_type string")).orderBy("section_ord").collect()
    assert [(r["heading"], r["text"], len(r["chunk_ids"])) for r in out] == [(None, "intro", 1), ("H1", "H1\nx\ny", 3), ("H2", "H2", 1), ("H3", "H3", 1)]


def test_item_box(spark):
    t = F.array(*[F.lit(x) for x in (12.0, 0.0, 0.0, 12.0, 61.2, 79.2)])
    r = spark.range(1).select(layout.item_box(t, F.lit(30.6), F.lit(None).cast("double"), F.lit(612.0), F.lit(792.0)).alias("b")).first()["b"]
    assert tuple(r) == pytest.approx((0.1, 67.2 / 792, 0.05, 12 / 792))


def test_chunks_partition_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = layout.lines_of_pages(layout.text_pages(docs))
    assert p.select(F.sum(F.size("lines"))).first()[0] == layout.chunks(p).select(F.sum("line_count")).first()[0]


def hits(spark, *rows):
    return spark.createDataFrame([(1, k + 1, f"c{k}", p, s, s, None, "paragraph") for k, (p, s) in enumerate(rows)], f"query_id long, rank int, id string, page_number int, snippet string, text string, bbox {schemas.BBOX}, element_type string")


GOOD = "This passage is a long readable sentence about one subject."


def test_answers(spark):
    h = hits(spark, (1, "short"), (2, "Another readable text without any verb but of enough length"), (3, GOOD), (3, GOOD + " Twice."))
    refs = answer.region_references(h)
    assert [r["chunk_id"] for r in refs.orderBy("ref_ord").collect()] == ["c1", "c2", "c3"]
    q = spark.createDataFrame([(1, "What is a subject?"), (2, "x")], "query_id long, question string")
    out = {r["query_id"]: r["text"] for r in answer.grounded_answers(q, h, refs).collect()}
    assert out[2] == answer.NOT_FOUND
    assert out[1].startswith('From the document on "subject":\n\n[ref:r2] This passage') or out[1].startswith('From the document on "subject":\n\n[ref:r3] This passage')
    assert "\n\nRelated:\n• [ref:r1] Another" in out[1]


def test_fallback_when_all_noisy(spark):
    h = hits(spark, (1, "short"), (1, "tiny"))
    assert [r["chunk_id"] for r in answer.region_references(h).orderBy("ref_ord").collect()] == ["c0", "c1"]
    assert answer.answer_pool(h).count() == 1  # one a page


def test_prompts(spark):
    rows = [(1, 0, "user", "Tell me about the shuffle in detail"), (1, 1, "assistant", "It moves rows."), (1, 2, "user", "that's wrong"), (2, 0, "user", "try again")]
    out = {(r["conv_id"], r["turn"]): r for r in answer.resolve_prompts(spark.createDataFrame(rows, schemas.MESSAGES)).collect()}
    assert out[1, 2]["question"] == "that's wrong"  # a straight apostrophe is no correction here
    rows[2] = (1, 2, "user", "that’s wrong")
    out = {(r["conv_id"], r["turn"]): r for r in answer.resolve_prompts(spark.createDataFrame(rows, schemas.MESSAGES)).collect()}
    assert out[1, 2]["question"] == rows[0][3]
    assert out[1, 2]["history"] == ["USER: " + rows[0][3], "ASSISTANT: It moves rows."]
    assert out[2, 0]["question"] == "try again"


def chunk_rows(spark, texts):
    return spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], "doc_id long, page_number int, chunk_ord int, text string")


@pytest.mark.parametrize(("n", "groups"), [(3, [1, 1, 1]), (8, [1] * 8), (9, [2, 2, 2, 2, 1]), (17, [3, 3, 3, 3, 3, 2])])
def test_meta_groups(spark, n, groups):
    out = profile.meta_groups(chunk_rows(spark, [GOOD] * n)).groupBy("group_ord").count().orderBy("group_ord").collect()
    assert [r["count"] for r in out] == groups


@pytest.mark.parametrize(("prose", "kept"), [(3, 20), (4, 4)])
def test_meta_groups_pool(spark, prose, kept):
    assert profile.meta_groups(chunk_rows(spark, [GOOD] * prose + ["bad"] * (20 - prose))).count() == kept


def test_profile_parse(spark):
    p = spark.createDataFrame([(1, 'Document: "X"\n[p.2] one\n\n[p.3–4] two\nbare')], "doc_id long, memory_prompt string")
    out = profile.parse_profiles(p).orderBy("ord").collect()
    assert [(r["page_label"], r["page_number"], r["text"]) for r in out] == [("p.2", 2, "one"), ("p.3–4", 3, "two"), (None, None, "bare")]


def test_snapshots(spark, tmp_path):
    store = export.SnapshotStore(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    store.save({"chunks": rows}, "a", "A", 1)
    store.save({"chunks": rows.limit(1)}, "b", "B", 2)
    store.save({"chunks": rows.limit(2)}, "a", "A2", 1)
    assert store.load("chunks", "a").count() == 2
    assert store.load("chunks", "missing").count() == 0
    assert [r["title"] for r in store.list().collect()] == ["A2", "B"]
