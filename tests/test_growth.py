"""Steps whose cost must grow no faster than their input."""

import random

import __spark_entry__ as entry
import duckdb
import pytest

from foliant.operators import search, signatures
from tests.harness import connect, rows_of_query, rows_of_sql

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, *names, sf=SF):
    con = connect(sf)
    for name in names:
        assert rows_of_query(entry.queries()[name](spark, sf)) == rows_of_sql(con, entry.oracle_sql()[name]), name


def test_near_rows_keep_a_batch_small(spark):
    """with many ties, null and short signatures, ``n`` rows a query are left of a batch, the right ones."""
    rng = random.Random(3)
    entries = [(i, [rng.getrandbits(3), 0]) for i in range(900)] + [(900, None), (901, [1])]
    queries = [(k, [k, 0]) for k in range(300)] + [(300, None)]
    e = spark.createDataFrame(entries, "vec_id long, signature array<long>").coalesce(1)
    q = spark.createDataFrame(queries, "query_id long, q_signature array<long>")
    got = search.near_rows(e, q, 5, ["vec_id"]).collect()
    assert len(got) == 301 * 5
    for k in (0, 7, 299):
        plain = [(-1, 900), (-1, 901)] + sorted(((k ^ s[0]).bit_count(), i) for i, s in entries[:900])[:3]
        assert sorted((-1 if r["hamming"] is None else r["hamming"], r["vec_id"]) for r in got if r["query_id"] == k) == plain
    assert all(r["hamming"] is None for r in got if r["query_id"] == 300)


@pytest.mark.parametrize("high", [4, 8])
def test_probes_are_rows_not_literals(spark, tmp_path, high):
    """a round's codes were literals of its plan, up to 12,870 of them; lists were broadcast by the size of their packed files."""
    e = spark.createDataFrame([(1, [5, 6]), (2, [7, 8])], "vec_id long, signature array<long>")
    index = signatures.SignatureIndex.build(e, str(tmp_path / "i"), keys=["vec_id"], words=2)
    q = e.selectExpr("vec_id as query_id", "signature as q_signature")
    probes = index._probes(q, range(high, high + 1))
    assert len(probes._jdf.queryExecution().toString()) < 20_000
    want = {(k, b, c) for k, (s, t) in ((1, (5, 6)), (2, (7, 8))) for b, own in enumerate((s, 0, t, 0)) for c, at in ((5, 0), (6, 2), (7, 0), (8, 2), (0, 1), (0, 3)) if at == b and (own ^ c).bit_count() == high}
    assert {(r["query_id"], r["band"], r["code"]) for r in probes.collect()} == want


def test_search_queries(spark):
    same_as_sql(spark, "prefilter_topk", "prefilter_indexed", "batch_search")


def test_images_prepared_once(spark):
    """12 rows of 3 different images, one with the bytes of another and other sizes."""
    from pyspark.sql import functions as F

    from foliant.functions.vision import prepare_once

    rows = [(k, (2, 3, bytes([k % 2 * 9] * 24)) if k % 3 else (3, 2, bytes([0] * 24))) for k in range(12)] + [(12, None)]
    of, prepared = prepare_once(spark.createDataFrame(rows, "k long, image struct<width:int,height:int,data:binary>"), "k", size=14)
    got = {r["k"]: r["image_key"] for r in of.collect()}
    assert got == {k: 0 if k % 3 == 0 else 1 if k % 2 else 2 for k in range(12)}
    assert {(r["image_key"], r["n"]) for r in prepared.select("image_key", F.size("pixels").alias("n")).collect()} == {(k, 3 * 14 * 14) for k in (0, 1, 2)}


def test_group_means_move_runs_only(spark):
    """nothing is exploded by component; groups that a batch boundary cuts are whole."""
    from foliant.operators import profile

    rows = [(k // 5, 0, 0.0 if k % 2 else 1.0, [float(k), 1.0, 0.0]) for k in range(20)] + [(9, 0, 1.0, None), (0, 0, 1.0, [3.0, 4.0, 0.0])]
    grouped = spark.createDataFrame(rows, "doc_id long, group_ord int, readability double, vector array<float>")
    metas = profile.meta_embeddings(grouped)
    assert "Generate" not in metas._jdf.queryExecution().toString()
    got = {r["doc_id"]: r["meta"] for r in metas.collect()}
    assert got.keys() == {0, 1, 2, 3}
    for d in got:
        own = [(max(w, 0.05), v) for i, _, w, v in rows if i == d and v]
        mean = [sum(w * v[j] for w, v in own) for j in range(3)]
        n = sum(x * x for x in mean) ** 0.5
        assert got[d] == pytest.approx([x / n for x in mean])


def test_one_row_group_is_dealt(spark):
    """Documents of one row group were laid out and embedded by one task."""
    from foliant.plans import catalog

    assert catalog.table(spark, SF, "documents").rdd.getNumPartitions() == 1
    assert catalog.pages_of(spark, SF).rdd.getNumPartitions() == 4


def test_merge_binds_values_once(spark):
    """the plan of a merge repeated its texts' expressions; the results at awkward ends stay."""
    from pyspark.sql import functions as F

    from foliant.functions import quality

    df = spark.createDataFrame([("word \u0085", "next", "word \u0085next"), ("word", " \n", "word"), (" \n", "  x", "x"), ("a\r\n", "b", "a\r\nb"), (None, None, "")], "l string, r string, want string")
    out = df.select("want", quality.merge_continuation(F.col("l"), F.col("r")).alias("got"))
    assert all(r["got"] == r["want"] for r in out.collect())
    marked = df.select(quality.merge_continuation(F.concat("l", F.lit("MARK")), F.col("r")).alias("m"))
    assert marked._jdf.queryExecution().analyzed().toString().count("MARK") == 1
    ends = [("x" * 300, True), ("x." + ")" * 300, False), ("x" + ")" * 300, True), ("y. " + " " * 300, False), (" " * 300, False), ("x,\u0085", True)]
    got = spark.createDataFrame(ends, "t string, want boolean").select("want", quality.looks_truncated(F.col("t")).alias("got"))
    assert all(r["got"] == r["want"] for r in got.collect())


def test_line_order_without_rows_apart():
    """the plain sorts give the tolerant order wherever it is a total one."""
    from functools import cmp_to_key

    import numpy as np

    from foliant.operators import layout

    rng = np.random.default_rng(5)
    for spacing in (0.025, 0.01):
        for _ in range(50):
            ys, xs = rng.integers(0, 8, 60) * spacing + rng.integers(-2, 3, 60) * 0.001, rng.integers(0, 20, 60) / 10
            tolerant = lambda a, b: ys[a] - ys[b] if abs(ys[a] - ys[b]) > layout.SAME_ROW else xs[a] - xs[b]  # noqa: B023, E731
            assert layout._in_order(xs, ys).tolist() == sorted(range(60), key=cmp_to_key(tolerant))


def shuffled_rows(spark, action):
    """Rows that the stages of an action write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList()))}
    before = stages()
    out = action()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for at, n in stages().items() if at not in before)


@pytest.mark.parametrize(("long", "most"), [([2**k for k in range(1, 11)], 7), ([2**6, 2**15, 2**15 + 1, 2**30, 2**31], 7)])
def test_intervals_are_moved_about_once(spark, long, most):
    """each row was moved once for each power of two among the lengths, and twice more to count buckets."""
    from foliant.operators import temporal

    rng = random.Random(11)
    side = lambda n: [(i, rng.randrange(40), at, at + (rng.choice(long) if i % 20 == 0 else rng.randrange(2))) for i in range(n) for at in [rng.randrange(100_000)]]
    left, right = side(6000), side(4000)
    by_key = [[r for r in right if r[1] == k] for k in range(40)]
    want = sorted((x[0], y[0]) for x in left for y in by_key[x[1]] if x[2] <= y[3] and y[2] <= x[3])
    a, b = (spark.createDataFrame(r, "id long, k long, lo long, hi long") for r in (left, right))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        join = lambda: [tuple(r) for r in temporal.interval_join(a, b, on={"k": "k"}, left_span=("lo", "hi"), right_span=("lo", "hi")).select("left.id", "right.id").collect()]
        got, moved = shuffled_rows(spark, join)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == want
    assert moved < most * 10_000


def test_interval_widths():
    """few widths, whatever the lengths; cut intervals make no more pieces than there are intervals."""
    from foliant.operators import temporal

    assert temporal._widths([{3: 10}, {5: 1}]) == {3: 5, 5: 5}
    assert temporal._widths([{0: 1000, 4: 10, 8: 2}, {0: 1000}]) == {0: 0, 4: 0, 8: 0}
    assert temporal._widths([{0: 1000, 4: 10, 8: 20, 9: 1}, {0: 1000}]) == {0: 0, 4: 0, 8: 8, 9: 8}
    assert temporal._widths([{0: 10**6, 11: 1}, {}]) == {0: 0, 11: 11}
    every = temporal._widths([{k: 2 ** (50 - k) for k in range(50)}] * 2)
    assert every.keys() == set(range(50)) and len(set(every.values())) <= 8 and all(k - w <= temporal.REACH for k, w in every.items())


def test_hot_intervals_are_dealt(spark):
    """a bucket that is hot on either side goes to several tasks; each pair is met once, repeated rows too."""
    from foliant.operators import temporal

    for few, many in ((20, 3000), (3000, 20), (900, 800)):
        left, right = ([(i % (n - 3), 1, i % 7, 7 + i % 5) for i in range(n)] + [(i, i, 5, 6) for i in range(5000, 6000)] for n in (few, many))
        a, b = (spark.createDataFrame(r, "id long, k long, lo long, hi long") for r in (left, right))
        got = temporal.interval_join(a, b, on={"k": "k"}, left_span=("lo", "hi"), right_span=("lo", "hi"))
        assert got.count() == few * many + 1000
        keyed = [x.selectExpr("struct(k) as _key", "0 as _at_width", "0 as _bucket") for x in (a, b)]
        parts = {r["_key"]["k"]: (r["_a_parts"], r["_h_parts"]) for r in temporal._hot(*keyed, ["_key", "_at_width", "_bucket"], few + many + 2000).collect()}
        assert parts == {1: tuple(min(temporal.PARTS, -(-n * 250 // (few + many + 2000))) for n in (few, many))}


def test_blank_pages_of_an_updated_index(spark, tmp_path):
    """A page without text was indexed under the placeholder of pages pending recognition, as a paragraph."""
    texts = [None, "", " \n\u00a0", "\n" * 50 + "the second page has text\n", "one line\n" + "\n" * 90, "plain text " * 90]
    rows = [(i, texts[i % len(texts)]) for i in range(35)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of_query(entry.queries()["incremental_index"](spark, str(tmp_path))) == rows_of_sql(con, entry.oracle_sql()["incremental_index"])


def test_hybrid_search_reads_all_passages(spark):
    """One passage in fifty was searched for."""
    got = entry.queries()["hybrid_text_search"](spark, SF).select("query_id").distinct().collect()
    assert len(got) == spark.read.parquet(f"{SF}/benchmark.parquet").count() == 40
    same_as_sql(spark, "hybrid_text_search")


ODD_TEXTS = [
    None, "", " \n\u00a0", "\n" * 50 + "the second page\u2003has  text\n", "x" * 700 + "\n" + "y " * 400, "one line\n" + "\n" * 90, "K\u0130 \u212aelvin \u00c4\u00d6 a.b/c_d:e -- ab- 12 $5 100% table Figure figure\r\n\tis a Test.",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f", "We define it so; it refers to what is an end. " * 40, "\n".join(f"Line {k} of prose that is defined as text, number {k * k}." for k in range(130)), "w" * 300 + "-." + " tail of it" * 30, "+ = - \u2211 " * 30,
]


def test_chunks_in_one_pass(spark):
    """Chunks and vectors were made by lambdas, component by component; those of one pass are the same."""
    from foliant.functions.quality import chunk_readability
    from foliant.operators import embedding, layout, packing

    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)) + [(None, "no id")], "doc_id long, text string")
    own = packing.embedded_chunks(docs)
    assert "Generate" not in own._jdf.queryExecution().toString()
    columns = ["doc_id", "page_number", "chunk_ord", "id", "text", "signature", "vector"]
    want = embedding.embed(layout.chunks(layout.lines_of_pages(layout.text_pages(docs.where("doc_id is not null"))))).withColumn("readability", chunk_readability("text"))
    rows = {tuple(r[:3]): r for r in want.select(*columns, "readability").collect()}
    got = own.select(*columns).collect()
    assert len(got) == len(rows) == 28
    for r in got:
        assert tuple(r) == tuple(rows[tuple(r[:3])])[:7]
    for c in (c for i, text in enumerate(ODD_TEXTS) for c in packing.chunks_of_text(i, text)):
        assert packing.readability(c) == rows[c[:3]]["readability"], c


def test_group_vectors_in_one_pass(spark, tmp_path):
    """Texts were sorted through three windows, and every component was exploded and rounded as a decimal."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = entry.queries()["meta_embedding"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert not any(step in plan for step in ("Generate", "Window", "Aggregate"))
    assert rows_of_query(out) == rows_of_sql(con, entry.oracle_sql()["meta_embedding"])
    from foliant.operators import packing

    whole = {(r["group_ord"], r["pos"], r["v"]) for r in packing.group_components(spark.createDataFrame([(7, ODD_TEXTS[9])], "doc_id long, text string")).collect()}
    twice = spark.createDataFrame([(7, ODD_TEXTS[9]), (3, "other"), (7, ODD_TEXTS[8])], "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    merged = packing.group_components(twice).where("doc_id = 7").collect()
    assert len({(r["group_ord"], r["pos"]) for r in merged}) == len(merged) and {(r["group_ord"], r["pos"], r["v"]) for r in merged} != whole  # one document


def test_keywords_are_looked_for_near_the_best(spark):
    """Every pair's terms were looked for. With ties, null and short signatures, null texts and terms of any signs the rows are right."""
    from pyspark.sql import functions as F

    from foliant.operators.search import OVERSAMPLE

    rng = random.Random(5)
    parts = ["alpha", "beta", "alp", "pha", "x-y.z", "\u00e9t\u00e9", "to", "bet", "gamma"]
    entries = [(i, [rng.getrandbits(12), rng.getrandbits(40)], " ".join(rng.choice(parts).upper() for _ in range(rng.randrange(6)))) for i in range(6000)]
    entries += [(6000, None, "alpha"), (6001, [1], "beta"), (6002, [0, 0], None)] + [(6003 + k, [5, 5], "alpha beta") for k in range(30)]
    queries = [(k, [rng.getrandbits(12), rng.getrandbits(40)], rng.sample(parts, rng.randrange(5))) for k in range(12)] + [(12, None, ["alpha"]), (13, [5, 5], ["alpha", "beta", None]), (14, [0, 0], None)]
    e = spark.createDataFrame(entries, "vec_id long, signature array<long>, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, signature array<long>, terms array<string>")
    found = search.first_stage(e, q, limit=1, order=["vec_id"])
    assert "Join" not in found._jdf.queryExecution().toString()
    n = OVERSAMPLE
    got = {}
    for r in found.orderBy("query_id", "candidate").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["hamming"], r["keyword_boost"] if r["hamming"] is not None else 0.0))
    for k, s, terms in queries:
        plain = []
        for i, own, text in entries:
            whole = s is not None and own is not None and len(own) == 2
            far = sum((a ^ b).bit_count() for a, b in zip(s, own, strict=True)) if whole else None
            low = (text or "").lower()
            boost = sum(t is not None and t in low for t in terms) / len(terms) if terms and whole else 0.0
            plain.append((float("-inf") if far is None else far - 12.0 * boost, i, far, boost))
        assert got[k] == [p[1:] for p in sorted(plain)[:n]], k
    near = search.keyword_rows(e.select("vec_id", "signature", "text"), q.select("query_id", F.col("signature").alias("q_signature"), F.col("terms").alias("q_terms")), n, ["vec_id"])
    assert near.count() <= 3 * n * len(queries)  # a task's best
