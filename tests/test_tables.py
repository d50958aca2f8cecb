"""Table functions from SQL, and the tensor source's filters, against the functions they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import embedding, layout, search
from foliant.plans import catalog, tables
from foliant.sources import safetensors

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_search_chunks_equals_batch_search(spark):
    tables.register_tools(spark)
    entries, queries = catalog.vector_entries(spark, SF), catalog.vector_queries(spark, SF)
    tables.candidates_table(entries, queries, order=["vec_id"]).createOrReplaceTempView("found")
    got = spark.sql("SELECT query_id, rank, vec_id, hamming, round(similarity, 6) AS similarity FROM search_chunks(TABLE(found), 6)")
    assert rows(got) == rows(catalog.batch_search(spark, SF))
    two = spark.sql("SELECT query_id, count(*) FROM search_chunks(TABLE(SELECT query_id, candidate, vector, q_vector, 'x' AS more FROM found WHERE candidate <= 9), 2) GROUP BY 1")
    assert {r[1] for r in two.collect()} == {2}
    assert spark.sql("SELECT * FROM search_chunks(TABLE(SELECT * FROM found WHERE false), 2)").collect() == []
    for sql in ("SELECT * FROM search_chunks(TABLE(SELECT query_id FROM found), 2)", "SELECT * FROM search_chunks(TABLE(found), 0)"):
        with pytest.raises(Exception, match="search_chunks needs"):
            spark.sql(sql).collect()


def test_analyze_page_equals_group_lines(spark):
    tables.register_tools(spark)
    items = layout.text_items(catalog.pages_of(spark, SF)).where("doc_id < 20").withColumn("bbox", layout.box(F.col("bbox")["x"], F.col("bbox")["y"] + (F.col("item_ord") % 3) * 0.004, F.col("bbox")["width"], F.col("bbox")["height"]))
    items.createOrReplaceTempView("items_of_pages")
    got = spark.sql("SELECT doc_id, page_number, line_ord, text, bbox FROM analyze_page(TABLE(items_of_pages))")
    assert rows(got) == rows(layout.group_lines(items).select(*got.columns)) and got.count() > 100
    with pytest.raises(Exception, match="analyze_page needs a table with item_ord"):
        spark.sql("SELECT * FROM analyze_page(TABLE(SELECT doc_id, page_number, text, bbox FROM items_of_pages))").collect()


def test_lookups(spark, tmp_path):
    embedding.embed(catalog.chunks_of(spark, SF).where("doc_id < 30")).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    layout.index_pages(chunks).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    chunks.createOrReplaceTempView("index_chunks")
    pages.createOrReplaceTempView("index_pages")
    tables.register_tools(spark, chunks="index_chunks", pages="index_pages")
    wanted = spark.range(35).select(F.col("id").alias("doc_id"), F.lit("p1-c2").alias("id"), (F.col("id") % 4 - 1).cast("int").alias("page_number"))
    wanted.createOrReplaceTempView("wanted")
    got = spark.sql("SELECT w.doc_id, w.id, f.page_number, f.bbox FROM wanted w LEFT JOIN LATERAL open_chunk(w.doc_id, w.id) f")
    assert rows(got) == rows(search.open_chunk(chunks, wanted.select("doc_id", "id")))
    got = spark.sql("SELECT w.doc_id, w.page_number, f.summary FROM wanted w LEFT JOIN LATERAL peek_page(w.doc_id, w.page_number) f")
    assert rows(got) == rows(search.peek_page(pages, wanted.select("doc_id", "page_number")))
    counts = pages.groupBy("doc_id").agg(F.max("page_number").alias("page_count"))
    got = spark.sql("SELECT w.doc_id, f.page_number, f.page_count FROM wanted w, LATERAL open_page(w.doc_id, w.page_number) f")
    assert rows(got) == rows(search.open_page(wanted.select("doc_id", "page_number"), counts))
    assert [r[0] for r in spark.sql("SELECT page_number FROM open_page(1, 999)").collect()] == [r["page_count"] for r in counts.where("doc_id = 1").collect()]


class Counted:
    """Opens files and counts the bytes that are read."""

    def __init__(self):
        self.n = 0

    def __call__(self, path, mode):
        outer, f = self, open(path, mode)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def seek(self, at):
                f.seek(at)

            def read(self, n):
                data = f.read(n)
                outer.n += len(data)
                return data

        return File()


@pytest.fixture
def shard(tmp_path):
    path = str(tmp_path / "model.safetensors")
    made = {f"layers.{k}.{n}": ("F32", [64, 512], np.full(64 * 512, k, "<f4").tobytes()) for k in range(12) for n in ("up.weight", "norm.weight")} | {"flag": ("U8", [3], b"\x01\x02\x03")}
    safetensors.write(path, made)
    return path, made


def test_only_chosen_ranges_are_read(spark, shard):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    path, made = shard
    header = Counted()
    n_all = len(list(safetensors._Reader([path], opener=header).read(safetensors._Part(path))))
    assert n_all == len(made) and header.n < 4000
    for filters, chosen in (([EqualTo(("name",), "layers.3.up.weight")], ["layers.3.up.weight"]), ([In(("name",), ("flag", "none"))], ["flag"]), ([StringStartsWith(("name",), "layers.1"), EqualTo(("dtype",), "F32")], [k for k in made if k.startswith("layers.1")]), ([GreaterThan(("byte_length",), 10**9)], [])):
        count = Counted()
        reader = safetensors._Chooser([path], payload=True, opener=count)
        assert list(reader.pushFilters(filters)) == []
        got = {r[0]: r[-1] for p in reader.partitions() for r in reader.read(p)}
        assert got == {k: made[k][2] for k in chosen}
        assert count.n == header.n + sum(len(made[k][2]) for k in chosen)  # the header and the chosen bytes, no more
    odd = [EqualTo(("shape",), 3), EqualTo(("name",), None)]
    assert list(safetensors._Chooser([path]).pushFilters(odd)) == odd


def test_parts_by_byte_range(shard, monkeypatch):
    path, made = shard
    monkeypatch.setattr(safetensors, "PART_BYTES", 300_000)
    reader = safetensors._Reader([path], payload=True)
    parts = reader.partitions()
    assert len(parts) >= 10 and sorted(d[0] for p in parts for d in p.chosen) == sorted(made)
    assert {r[0]: r[-1] for p in parts for r in reader.read(p)} == {k: v[2] for k, v in made.items()}
    assert [len(g) for g in safetensors.ranges([("a", 0, 0, 0, 0, 0, 10), ("b", 0, 0, 0, 0, 10, 20), ("c", 0, 0, 0, 0, 10**6, 10**6 + 1)])] == [2, 1]


def test_tensor_bytes_from_spark(spark, shard):
    path, made = shard
    safetensors.register(spark)
    (r,) = safetensors.chosen(spark, [path], "name = 'layers.7.norm.weight' and dtype = 'F32'").select("name", safetensors.decoded(F.col("dtype"), F.col("data"))[5].alias("v")).collect()
    assert (r["name"], r["v"]) == ("layers.7.norm.weight", 7.0)
    assert safetensors.chosen(spark, [path], "name like 'layers.1%' and byte_length > 3").count() == 6
    assert safetensors.chosen(spark, [path], "name = 'none'").count() == 0
    some = safetensors.chosen(spark, [path], F.col("name").startswith("layers.1.") & (F.size("shape") == 2))
    assert "PushedFilters" in some._jdf.queryExecution().executedPlan().toString() or some.count() == 2
    assert spark.conf.get(safetensors.PUSHDOWN) == "false"
    df = spark.read.format("safetensors").option("paths", path).option("payload", "true").load()  # without pushdown Spark filters
    assert df.where("name = 'flag'").select("data").collect()[0][0] == b"\x01\x02\x03" and df.count() == len(made)
    assert spark.read.format("safetensors").option("paths", path).load().where("dtype = 'U8'").select("name").collect()[0][0] == "flag"
