"""Tokenizer, tensors, Markdown, vision, adapters, decoder, streams and the engine."""

import json
import os
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import schemas
from foliant.functions import markdown, vision
from foliant.functions.tokenizer import BytePairTokenizer, chat_prompt, encode
from foliant.operators import adapters, answer, decoder, embedding, search
from foliant.sources import files, safetensors
from foliant.streaming import sessions


def test_bpe():
    t = BytePairTokenizer.demo()
    names = {v: k for k, v in t.vocabulary.items()}
    assert [names[i] for i in t.encode("the and")] == ["the", "Ġ", "and"] or [names[i] for i in t.encode("the and")] == ["the", "Ġand"]
    for s in ("", "hello the world", "naïve 😀 123  x", "a\n\n b"):
        assert t.decode(t.encode(s)) == s
    s = BytePairTokenizer(t.vocabulary, t.merges, {"<a>": 900, "<a><b>": 901})
    assert [i for i in s.encode("x<a><b>y<a>") if i >= 900] == [901, 900]
    with pytest.raises(ValueError):
        BytePairTokenizer({"a": 0}, []).encode("b")
    assert BytePairTokenizer.from_bundle(vocab={"a": 0, "b": 1, "ab": 2}, merges_text="#v\na b\n").encode("ab") == [2]


def test_bpe_repeats():
    t = BytePairTokenizer({"a": 0, "aa": 1}, [("a", "a")])
    assert [t.encode("a" * n) for n in (2, 3, 4)] == [[1], [1, 0], [1, 1]]


def test_encode_column(spark):
    r = spark.createDataFrame([("the",), (None,)], "t string").select(encode(BytePairTokenizer.demo(), F.col("t")).alias("v")).collect()
    assert len(r[0]["v"]) == 1 and r[1]["v"] == []
    m = spark.createDataFrame([([("user", "hi")],)], "m array<struct<role:string,content:string>>")
    assert m.select(chat_prompt(F.col("m"))).first()[0] == "<user>\nhi\n</user>"


def test_decode_types():
    half = np.array([0.0, -0.0, 1.0, 65504.0, np.inf, 2**-24], np.float16)
    assert np.array_equal(safetensors.decode("F16", half.tobytes()), half.astype(np.float32))
    assert np.array_equal(safetensors.decode("BF16", b"\x80\x3f\x00\xc0"), np.array([1, -2], np.float32))
    assert list(safetensors.decode("I8", b"\xff\x01")) == [-1, 1]
    with pytest.raises(ValueError):
        safetensors.decode("F64", b"")


def test_safetensors(spark, tmp_path):
    p = str(tmp_path / "a.safetensors")
    safetensors.write(p, {"w": ("F32", [2, 2], np.arange(4, dtype="<f4").tobytes()), "b": ("I32", [1], b"\x01\0\0\0")})
    safetensors.register(spark)
    rows = {r["name"]: r for r in spark.read.format("safetensors").option("paths", p).load().collect()}
    assert rows["w"]["element_count"] == 4 and rows["b"]["byte_length"] == 4
    blobs = spark.read.format("binaryFile").load(p)
    other = safetensors.tensors_of_blobs(blobs)
    assert other.count() == 2 and safetensors.preview_tensor(other).first()["name"] == "w"
    raw = blobs.select(files.byte_range(F.col("content"), F.lit(rows["w"]["byte_start"]).cast("int"), F.lit(rows["w"]["byte_end"]).cast("int")).alias("d"))
    assert raw.select(safetensors.decoded(F.lit("F32"), F.col("d")).alias("v")).first()["v"] == [0, 1, 2, 3]
    index = spark.createDataFrame([("m/model.safetensors.index.json", json.dumps({"weight_map": {"x": "s1", "y": "s1"}}))], "path string, text string")
    assert [r["path"] for r in safetensors.shards_of_index(index).collect()] == ["m/s1"]
    assert files.listing(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        safetensors.read_header(lambda a, b: b"\xff" * (b - a))


MARKDOWN = {
    "# A *b*": "<h1>A <em>b</em></h1>",
    "- a\n- **b**": "<ul><li>a</li><li><strong>b</strong></li></ul>",
    "1. a\n2. b": "<ol><li>a</li><li>b</li></ol>",
    "> a\n> > b": "<blockquote><p>a</p><blockquote><p>b</p></blockquote></blockquote>",
    "```py\na*b*\n```": '<pre><code class="language-py">a*b*</code></pre>',
    "a\nb\n\n---\nc": "<p>a b</p><hr><p>c</p>",
    "[x](javascript:1)": "<p>x</p>",
    "[x](https://a.b)": '<p><a href="https://a.b" target="_blank" rel="noreferrer">x</a></p>',
    "`a*b*c`": "<p><code>a*b*c</code></p>",
    "[p.3]": '<p><button class="page-chip" type="button" data-page-number="3">p.3</button></p>',
    "$x_1^2$": '<p><math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup></mrow></math></p>',
    "": "",
}


@pytest.mark.parametrize("source", MARKDOWN)
def test_markdown(source):
    assert markdown.render(source) == MARKDOWN[source]


def test_markdown_references():
    refs = {"r1": {"id": "r1", "label": "p.2 · r1", "snippet": "s", "page_number": 2, "bbox": None}}
    html = markdown.render("see [ref:R1] and [ref:r9]", refs)
    assert 'data-ref-id="r1" data-page-number="2" title="s">p.2 · r1</button>' in html and "[ref:r9]" in html
    assert markdown.math(r"\frac{a}{\sqrt{2}}") == '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mfrac><mrow><mi>a</mi></mrow><mrow><msqrt><mrow><mn>2</mn></mrow></msqrt></mrow></mfrac></mrow></math>'


def test_vision():
    assert vision.fitted(4, 2, 336) == (336, 168)
    p = np.zeros((2, 4, 4), np.uint8)
    p[:, :, 0] = np.arange(4) * 85
    out = vision.plan(p, size=20)
    assert (out["width"], out["height"], out["rows"], out["cols"], out["tokens"]) == (20, 10, 1, 2, 2)
    red = out["pixels"].reshape(3, 14, 28)[0] * vision.STD[0] + vision.MEAN[0]
    assert red[0, 19] == pytest.approx(red[13, 27]) and np.all(np.diff(red[0, 2:18]) >= 0)


def test_adapters(spark):
    m = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1.0), (2, [3.0, 0.0, 1.0], 3.0)], "doc_id long, meta array<double>, weight double")
    d = adapters.derive(m, layers=1, hidden=8, heads=2, kv_heads=1, rank=2)
    sizes = {(r["proj"], r["mat"]): r["count"] for r in d.where("doc_id = 1").groupBy("proj", "mat").count().collect()}
    assert sizes["q", "B"] == 32 and sizes["k", "B"] == 8 and sizes["o", "A"] == 16
    rows = d.where("doc_id = 1 and proj = 'q' and mat = 'A'").groupBy("i").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1, abs=1e-5) for r in rows)
    one = adapters.combine(d).where("proj = 'q' and mat = 'A' and i = 0 and j = 0").first()["value"]
    a, b = [d.where(f"doc_id = {k} and proj = 'q' and mat = 'A' and i = 0 and j = 0").first()["value"] for k in (1, 2)]
    assert one == pytest.approx((a + 3 * b) / 4)
    y = spark.createDataFrame([([1.0, 1.0], [2.0], [[3.0]], [[1.0], [0.5]])], "y array<double>, x array<double>, a array<array<double>>, b array<array<double>>")
    assert y.select(adapters.apply_delta(*map(F.col, "yxab"), scale=0.1)).first()[0] == pytest.approx([1.6, 1.3])


def tiny_decoder(seed=0):
    r = np.random.default_rng(seed)
    n = lambda *s: r.standard_normal(s) * 0.3
    ff = lambda: {"input_norm": np.ones(8), "post_norm": np.ones(8), "gate": n(12, 8), "up": n(12, 8), "down": n(8, 12)}
    full = ff() | {"q": n(16, 8), "k": n(4, 8), "v": n(4, 8), "o": n(8, 8), "q_norm": np.ones(4), "k_norm": np.ones(4)}
    linear = ff() | {"qkv": n(12, 8), "z": n(4, 8), "a": n(1, 8), "b": n(1, 8), "conv": n(12, 4), "dt_bias": n(1), "a_log": n(1), "norm": np.ones(4), "out": n(8, 4)}
    return decoder.Decoder(n(10, 8), [full, linear], np.ones(8), n(10, 8), decoder.Config(2, 1, 4))


def test_decoder(spark):
    d = tiny_decoder()
    out = d.generate([1, 2, 3], 5)
    assert len(out) == 5 and out == d.generate([1, 2, 3], 5)
    assert tiny_decoder().generate([], 5) == []
    d.stop = frozenset({out[0]})
    assert d.generate([1, 2, 3], 5) == []
    c = d.caches()
    for t in range(6):
        d.forward(t, c)
    assert len(c[0].keys) == 6 and len(c[1].history) == 3
    p = spark.createDataFrame([(1, [1, 2, 3])], "query_id long, tokens array<int>")
    assert decoder.generate(p, tiny_decoder(), 5).first()["generated"] == out


def test_attention_by_hand():
    """One position: the softmax is 1, so the output is the gated value."""
    c = decoder.Config(1, 1, 2)
    w = {"q": np.zeros((4, 2)), "k": np.eye(2), "v": np.eye(2), "o": np.eye(2), "q_norm": np.ones(2), "k_norm": np.ones(2)}
    assert decoder.attention(np.array([2.0, 4.0]), w, c, decoder.Cache()) == pytest.approx([1.0, 2.0])


def test_embedding_model(spark):
    docs = spark.createDataFrame([(1, "Alpha beta table 50% $5\nALPHA again"), (2, "")], "doc_id long, text string")
    from foliant.plans.api import Engine

    e = Engine.index(docs.withColumn("title", F.lit("T")))
    rows = e.chunks.collect()
    for r in rows:
        assert math.sqrt(sum(x * x for x in r["vector"])) == pytest.approx(1, abs=1e-5)
        bits = sum(1 << k for k in range(32) if r["vector"][k] >= 0)
        assert r["signature"][0] == bits and len(r["signature"]) == 12
    sums = {(r["id"], r["bucket"]): r["weight"] for r in embedding.bucket_sums(e.chunks.where("doc_id = 1"), ["id"]).collect()}
    r = next(x for x in rows if x["doc_id"] == 1)
    scale = next(abs(w / 20 / r["vector"][b]) for (i, b), w in sums.items() if w)
    for (i, b), w in sums.items():
        assert w / 20 == pytest.approx(r["vector"][b] * scale, abs=1e-4)


def test_search_ties_and_prefix(spark):
    rows = [(k, [1.0, 0.0] if k < 30 else [0.0, 1.0], [3] if k < 30 else [1]) for k in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, vector array<double>, signature array<long>")
    q = spark.createDataFrame([(7, [1.0, 0.0], [3])], "query_id long, vector array<double>, signature array<long>")
    out = search.search(e, q, limit=3, order=["vec_id"]).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [0, 1, 2]
    assert [r["vec_id"] for r in search.search_one(e, [1.0, 0.0], [3], limit=3, order=["vec_id"]).collect()] == [0, 1, 2]


def test_hybrid_against_model(spark):
    """The batch search against a plain Python one over the same chunks."""
    from foliant.plans import catalog

    d = "/root/testdata/sf0.001"
    c = embedding.embed(catalog.chunks_of(spark, d)).cache()
    q = embedding.embed_queries(catalog.benchmark_queries(spark, d))
    got = [(r["doc_id"], r["id"]) for r in search.search_texts(c, q).where("query_id = 0").orderBy("rank").collect()]
    (query,) = [r for r in q.collect() if r["query_id"] == 0]
    rows = sorted(c.collect(), key=lambda r: (r["doc_id"], r["page_number"], r["chunk_ord"]))
    scored = []
    for k, r in enumerate(rows):
        ham = sum(bin(a ^ b).count("1") for a, b in zip(r["signature"], query["signature"], strict=True))
        boost = sum(t in r["text"].lower() for t in query["terms"]) / len(query["terms"])
        scored.append((ham - 12 * boost, k, boost))
    near = sorted(scored)[:48]
    final = sorted(near, key=lambda s: -(float(np.dot(np.array(rows[s[1]]["vector"], float), np.array(query["vector"], float))) + 0.18 * s[2]))[:6]
    assert got == [(rows[k]["doc_id"], rows[k]["id"]) for _, k, _ in final]


def test_states_batch_and_stream(spark, tmp_path):
    kinds = ["load-start", "load-progress", "load-ready", "generate-start", "generate-chunk", "generate-chunk", "generate-complete", "interrupt-complete"]
    rows = [(1, k, t, json.dumps({"progress": 0.4})) for k, t in enumerate(kinds)] + [(2, 0, "load-start", None), (2, 1, "load-error", json.dumps({"message": "no"})), (2, 2, "interrupt-complete", None)]
    e = spark.createDataFrame(rows, schemas.WORKER_EVENTS)
    batch = {r["request_id"]: (r["status"], r["ready"], r["n_events"]) for r in sessions.reduce_events(e).collect()}
    assert batch == {1: ("ready", True, 8), 2: ("error", False, 3)}
    e.write.parquet(str(tmp_path / "in"))
    out = sessions.stream_states(spark.readStream.schema(schemas.WORKER_EVENTS).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["request_id"]: (r["status"], r["ready"], r["n_events"]) for r in spark.table("states").collect()} == batch


def test_sessions_batch_and_stream(spark, tmp_path):
    rows = [(1, t) for t in (0, 60, 149, 240)]
    e = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["n_events"], r["expires"].timestamp() - r["started"].timestamp()) for r in sessions.inactivity_sessions(e).collect())
    assert got == [(1, 90.0), (3, 239.0)]
    e.coalesce(1).write.parquet(str(tmp_path / "in"))  # one file: a micro-batch each, in the order of their times
    late = spark.createDataFrame([(2, 10_000)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = sessions.stream_sessions(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="0 seconds")
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_events"] for r in spark.table("sessions").where("user_id = 1").collect()) == [1, 3]


def test_engine(spark, tmp_path):
    from foliant.plans.api import Engine

    text = "INTRODUCTION\n" + "The shuffle is a step that moves rows between tasks of a stage.\n" * 3 + "\n\n\n\nAppendix is defined as the last part of a text in this book."
    docs = spark.createDataFrame([(1, text, "Book"), (2, "Nothing here.", "Other")], "doc_id long, text string, title string")
    e = Engine.index(docs).save(str(tmp_path / "i"))
    m = spark.createDataFrame([(1, 0, "user", "What is the shuffle?", 1), (2, 0, "user", "open page 1", 1), (3, 0, "user", "hi", 9), (4, 0, "user", "page 7", 1)], schemas.MESSAGES + ", doc_id long")
    out = {r["conv_id"]: r for r in e.ask(m).collect()}
    assert out[3]["mode"] == "fallback" and out[1]["mode"] == "grounded"
    assert "shuffle is a step" in out[1]["text"] and 'on "shuffle"' in out[1]["text"]
    assert any(t.startswith("openPage(pageNumber: 1, bbox: none") for t in out[2]["trace"])
    assert answer.NOT_FOUND in out[4]["text"]
    made = e.ask(m, generator=lambda r: r.select("query_id", F.lit(0).alias("pass"), F.lit("Made.").alias("text"), F.lit(False).alias("hit_limit")))
    assert {r["conv_id"]: r["mode"] for r in made.collect()}[1] == "webgpu"
    assert e.profiles().count() == 2 and e.sections().count() >= 2


def test_queries_cover_whole_tables(spark):
    from foliant.plans import catalog

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert n > 50 and catalog.vision_patches(spark, sf).count() == n
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    first = catalog.lora_adapters(spark, sf).where("layer = 0 and proj = 'q' and mat = 'A'").first()
    assert first["n"] == vectors * adapters.RANK * 32


def test_continuations_cover_whole_texts(spark):
    from foliant.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    merged = {r["doc_id"]: r["merged"] for r in catalog.merge_continuation(spark, sf).collect()}
    assert merged.keys() == texts.keys()
    letters = lambda s: "".join(s.upper().split())
    assert sum(letters(merged[i]) == letters(t) for i, t in texts.items()) > 0.9 * len(texts)
    folded = {r["query_id"]: r["text"] for r in catalog.continuation_fold(spark, sf).collect()}
    assert folded.keys() == texts.keys()
    assert any(len(t) > 200 and letters(folded[i]) == letters(t) for i, t in texts.items())


TEX = {
    r"\alpha\Gamma": "<mi>&alpha;</mi><mi>Gamma</mi>",
    r"a \le b \ne c": "<mi>a</mi><mo>&#x2264;</mo><mi>b</mi><mo>&#x2260;</mo><mi>c</mi>",
    r"\log BP": '<mi mathvariant="normal">log</mi><mi mathvariant="normal">BP</mi>',
    r"\frac{a}{b}_1": "<msub><mfrac><mrow><mi>a</mi></mrow><mrow><mi>b</mi></mrow></mfrac><mn>1</mn></msub>",
    r"\frac12": "<mfrac><mn>12</mn><mrow></mrow></mfrac>",
    r"\sqrt x^2": "<msup><msqrt><mi>x</mi></msqrt><mn>2</mn></msup>",
    r"\left\{ x \right\}": "<mi>{</mi><mi>x</mi><mi>}</mi>",
    r"\text{for all , x}": "<mtext>for all, x</mtext>",
    r"\mathbf{ W } \mathrm{}": '<mi mathvariant="bold">W</mi><mrow></mrow>',
    r"\mathcal x": "<mrow></mrow><mi>x</mi>",
    r"x_1_2^3": "<msubsup><mi>x</mi><mn>2</mn><mn>3</mn></msubsup>",
    r"x_{i_j}": "<msub><mi>x</mi><mrow><msub><mi>i</mi><mi>j</mi></msub></mrow></msub>",
    r"_a": "<mo>_</mo><mi>a</mi>",
    r"{a": "<mrow><mi>a</mi></mrow>",
    r"a}": "<mi>a</mi><mo>}</mo>",
    r"f'(x) < 1.5": "<mi>f</mi><mo>&#x2032;</mo><mo>(</mo><mi>x</mi><mo>)</mo><mo>&lt;</mo><mn>1.5</mn>",
    r"\frac{a": "<mfrac><mrow><mi>a</mi></mrow><mrow></mrow></mfrac>",
    r"a^": "<msup><mi>a</mi><mrow></mrow></msup>",
    "{" * 5000 + "}" * 5000: "<mrow>" * 5000 + "</mrow>" * 5000,
}


@pytest.mark.parametrize("source", TEX, ids=range(len(TEX)))
def test_tex(source):
    assert markdown.mathml(source) == f"<mrow>{TEX[source]}</mrow>"


def test_golden_matrix_and_norm(spark):
    """A product of two 2 by 2 matrices, and the root-mean-square norm of two rows."""
    from foliant.functions import vectors
    from foliant.operators import weights

    cells = lambda m, names: spark.createDataFrame([(i, j, float(m[i][j])) for i in range(2) for j in range(2)], names)
    out = weights.multiply(cells([[1, 2], [3, 4]], "i int, k int, value double"), cells([[5, 6], [7, 8]], "k int, j int, value double"))
    assert {(r["i"], r["j"]): r["value"] for r in out.collect()} == {(0, 0): 19.0, (0, 1): 22.0, (1, 0): 43.0, (1, 1): 50.0}
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row int, v array<double>")
    normed = rows.select("row", vectors.rms_norm(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))).alias("n")).orderBy("row").collect()
    assert [r["n"] for r in normed] == [pytest.approx([1 / 2.5**0.5, 2 / 2.5**0.5], abs=1e-6), pytest.approx([3 / 12.5**0.5, 4 / 12.5**0.5], abs=1e-6)]


def test_weights_refuse_and_preview(spark):
    from foliant.operators import weights

    m = spark.createDataFrame([(1, "", 2, 2, 4)], "model int, prefix string, num_hidden_layers int, full_attention_interval int, num_experts int")
    with pytest.raises(Exception, match="mixtures of experts"):
        weights.layer_plans(m).collect()
    assert weights.layer_plans(m.withColumn("num_experts", F.lit(0))).count() == 5 + 9 + 5 + 6
    with pytest.raises(Exception, match="no convolution of shape 4"):
        spark.range(1).select(weights.conv_kernel_at(F.array(F.lit(1.0)), F.array(F.lit(4)), F.lit(0), F.lit(0))).collect()
    data = np.arange(100, dtype="<f4").tobytes()
    blob = spark.createDataFrame([("F32", bytearray(data)), ("BF16", bytearray(data))], "dtype string, data binary")
    assert [len(r["p"]) for r in blob.select(safetensors.preview(F.col("dtype"), F.col("data")).alias("p")).collect()] == [64, 64]


def test_adapter_in_the_decoder(spark):
    d = tiny_decoder()
    plain, caches = d.forward(1, d.caches()), None
    rows = [(0, p, mat, i, j, 0.5) for p, mat, n, m in (("q", "A", 1, 8), ("q", "B", 16, 1), ("k", "A", 1, 3), ("k", "B", 2, 1)) for i in range(n) for j in range(m)]
    deltas = adapters.matrices(spark.createDataFrame(rows, "layer int, proj string, mat string, i int, j int, value double"))
    changed = d.with_adapter(deltas).forward(1, d.caches())
    assert not np.allclose(plain, changed)
    assert np.allclose(plain, d.with_adapter({0: {"k": deltas[0]["k"]}}).forward(1, d.caches()))  # sizes that do not fit change nothing
    assert np.allclose(plain, d.with_adapter(deltas).with_adapter(None).forward(1, d.caches())) and caches is None


def test_pages_from_outside(spark, tmp_path):
    from foliant.operators import layout
    from foliant.sources import pages

    lines = ['{"doc_id": 1, "page_number": 2, "items": [{"item_ord": 0, "text": "Hello there", "bbox": {"x": 0.1, "y": 0.1, "width": 0.5, "height": 0.02}}, {"item_ord": 1, "text": " "}], "image": "AAEC"}', '{"doc_id": 1}', "broken"]
    (tmp_path / "p.json").write_text("\n".join(lines))
    got = pages.read_pages(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r["page_number"], len(r["items"]), r["image"]) for r in got] == [(1, 0, None), (2, 1, bytearray(b"\0\1\2"))]
    assert layout.analyze(pages.read_pages(spark, str(tmp_path)).select("doc_id", "page_number", "items")).count() == 2
    files_ = spark.createDataFrame([("x/a.pdf", "a.pdf", bytearray(b"one|two"))], "path string, file_name string, content binary")
    split_ = lambda content: ({"title": "T"}, content.decode().split("|"))
    assert [(r["page_number"], r["page_count"], r["title"], r["author"], r["text"]) for r in pages.pdf_bundles(files_, split_).collect()] == [(1, 2, "T", None, "one"), (2, 2, "T", None, "two")]
    raster = spark.createDataFrame([(1, 1, 2, 1, bytearray([255] * 8))], "doc_id long, page_number int, width int, height int, data binary")
    r = pages.page_images(raster, 8).first()
    assert (r["width"], r["height"], set(r["data"])) == (8, 4, {255})


def test_log_and_observers(spark, tmp_path):
    from foliant.streaming import listeners, sessions

    rows = "conv_id long, ord int, role string, text string"
    sessions.append_log(spark.createDataFrame([(1, 1, "user", "a")], rows), f"{tmp_path}/log")
    seen, watch = [], listeners.Observers(spark)
    stop = watch.subscribe(lambda s: seen.append(s["status"]))
    spark.createDataFrame([(1, 2, "assistant", "b")], rows).write.parquet(f"{tmp_path}/new")
    q = sessions.append_log(spark.readStream.schema(rows).parquet(f"{tmp_path}/new"), f"{tmp_path}/streamed", checkpoint=f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1 and spark.read.parquet(f"{tmp_path}/streamed").count() == 1
    import time

    for _ in range(100):
        if "ended" in seen:
            break
        time.sleep(0.1)
    stop()
    watch.close()
    assert seen[0] == "idle" and "running" in seen and "ended" in seen
    stalled = spark.createDataFrame([(1, 1, None, True)], "conv_id long, turn int, text string, stalled boolean")
    asked = spark.createDataFrame([(1, 1, "q"), (1, 3, "r")], "conv_id long, turn int, text string")
    assert [(r["role"], r["text"]) for r in sessions.chat_log(asked, stalled).orderBy("ord").collect()] == [("user", "q"), ("assistant", sessions.STALLED), ("user", "r"), ("assistant", sessions.FAILED)]


def test_encode(spark):
    from foliant.plans.api import Engine

    text = "\n".join(f"This is sentence number {k} of a document, and it describes something that is defined as thing {k}." for k in range(30))
    engine = Engine.index(spark.createDataFrame([(1, text, "One"), (2, None, "Two")], "doc_id long, text string, title string"))
    profiles, none = engine.encode(compile_weights=False)
    assert none is None and profiles.count() == 2
    assert {r["doc_id"]: r["status"] for r in engine.profile_status().collect()} == {1: "ready", 2: "ready"}
    _, made = engine.encode("unknown")
    assert made.where("doc_id = 1 AND layer = 0 AND proj = 'q' AND mat = 'A'").select("i").distinct().count() == 8
    with pytest.raises(ValueError, match="no chunks"):
        Engine(engine.chunks.where("false"), engine.pages, engine.titles).encode()


def test_embedding_against_bucket_sums(spark):
    """The two ways to the text part agree: sums by a grouped aggregate, and vectors in Arrow batches."""
    from foliant import schemas
    from foliant.operators import layout

    rows = layout.chunks(layout.lines_of_pages(layout.text_pages(spark.createDataFrame([(1, "Some words, some-words and WORDS again\nÄäß ünïcode x 12.5%"), (2, None)], "doc_id long, text string"))))
    sums = {}
    for r in embedding.bucket_sums(rows.select("doc_id", "id", "text"), ["doc_id", "id"]).collect():
        sums.setdefault(r["doc_id"], np.zeros(schemas.TEXT_DIMS))[r["bucket"]] = r["weight"] / 20
    for r in embedding.embed(rows).collect():
        part = np.array(r["vector"][: schemas.TEXT_DIMS], np.float64)
        own = sums[r["doc_id"]]
        k = np.argmax(np.abs(own))
        assert part == pytest.approx(own * part[k] / own[k], abs=1e-6)


def test_tokenizer_against_the_library(spark):
    """With a public vocabulary of 50,257 entries: the ids of every document are the library's, and decode to its text."""
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file here")
    from tokenizers import Tokenizer

    from foliant.functions.tokenizer import BytePairTokenizer
    from foliant.plans import catalog

    theirs, own = Tokenizer.from_file(path), BytePairTokenizer.from_files(path)
    theirs.encode_special_tokens = True
    sf = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    for t in [*texts, "  two  spaces\n\n\nlines\t tabs", "it's we'll I'VE 123abc ünï—x 日本語 🙂👍🏽", " trailing "]:
        ids = own.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids and own.decode(ids) == t
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    for r in catalog.bpe_encode_count(spark, sf, path).collect():
        assert r["n_tokens"] == len(theirs.encode(turns[r["conv_id"], r["turn"]], add_special_tokens=False).ids)
