"""The signature index and the posting lists give what scans give, from fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import hashing
from foliant.operators import postings, search, signatures
from foliant.plans import catalog

SF = "/root/testdata/sf0.01"


def signed(spark, rows, words=2):
    return spark.createDataFrame([(i, s) for i, s in rows], "vec_id long, signature array<long>")


def nearest(found):
    return sorted((r["query_id"], r["candidate"], r["vec_id"], r["hamming"]) for r in found.nearest.collect())


def plain(entries, queries, limit):
    out = []
    for q, s in queries:
        near = sorted((sum((a ^ b).bit_count() for a, b in zip(s, t)), i) for i, t in entries)[:limit]
        out += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    return sorted(out)


def test_masks():
    assert [len(signatures.masks(r)) for r in (0, 1, 2, 8, 16)] == [1, 16, 120, 12870, 1]
    assert signatures.covered(0, 4) == 3  # with four or more differing bits each of four bands may differ


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_nearest(spark, tmp_path, limit):
    """Clusters of near signatures among far ones, with ties and repeated entries' signatures."""
    rng = random.Random(limit)
    word = lambda: rng.getrandbits(32)
    centres = [[word(), word()] for _ in range(5)]
    entries = [(i, [w ^ (1 << rng.randrange(32)) * rng.randrange(2) ^ (1 << rng.randrange(32)) for w in rng.choice(centres)]) for i in range(200)] + [(1000 + i, [word(), word()]) for i in range(200)]
    queries = [(k, c) for k, c in enumerate(centres)] + [(9, [word(), word()])]
    index = signatures.SignatureIndex.build(signed(spark, entries), str(tmp_path / "i"), keys=["vec_id"], words=2)
    asked = signed(spark, queries).withColumnRenamed("vec_id", "query_id")
    found = index.nearest(asked.unionByName(asked.limit(1)), limit, path=str(tmp_path / "s"))
    assert nearest(found) == plain(entries, queries, limit)
    reads = {r["query_id"]: r for r in found.reads.collect()}
    assert reads.keys() == {q for q, _ in queries}
    if limit == 1:
        assert all(reads[k]["radius"] == signatures.FIRST_RADIUS and reads[k]["rows_read"] < 400 and not reads[k]["scanned"] for k in range(5))


def test_nearest_awkward(spark, tmp_path):
    entries = signed(spark, [(1, [0, 0]), (2, None), (3, [0]), (4, [2**32 - 1, 0])])
    index = signatures.SignatureIndex.build(entries, str(tmp_path / "a"), keys=["vec_id"], words=2)
    asked = signed(spark, [(1, [0, 0]), (2, None), (3, [2**32 - 1] * 2)]).withColumnRenamed("vec_id", "query_id")
    assert nearest(index.nearest(asked, 5, path=str(tmp_path / "b"))) == [(1, 1, 1, 0), (1, 2, 4, 32), (3, 1, 4, 32), (3, 2, 1, 64)]
    assert nearest(index.nearest(asked.limit(0), 5, path=str(tmp_path / "c"))) == []
    none = signatures.SignatureIndex.build(entries.limit(0), str(tmp_path / "d"), keys=["vec_id"], words=2)
    assert nearest(none.nearest(asked, 5, path=str(tmp_path / "e"))) == []


def test_share_of_entries_read(spark, tmp_path):
    """On the vectors the 48 nearest of each query need a part of the entries only."""
    index = signatures.SignatureIndex.build(catalog.vector_entries(spark, SF), str(tmp_path / "i"), keys=["vec_id"], words=2)
    found = index.nearest(catalog.vector_queries(spark, SF), 8, path=str(tmp_path / "s"))
    want = search.candidates(catalog.vector_entries(spark, SF), catalog.vector_queries(spark, SF), limit=1, order=["vec_id"])
    assert nearest(found) == sorted((r["query_id"], r["candidate"], r["vec_id"], r["hamming"]) for r in want.collect())
    reads = found.reads.collect()
    assert all(r["rows_read"] <= 2 * r["entries"] for r in reads)


TEXTS = [(1, "Alpha/beta alphabet soup"), (2, "ALPHABET and beta"), (3, ""), (4, None), (5, "alpha beta gamma delta"), (None, "alpha beta"), (6, "lph abe"), (7, "gamma" * 1000)]


@pytest.mark.parametrize("above", [0.0, 0.3, 0.5, 0.99])
def test_term_index(spark, tmp_path, above):
    index = postings.TermIndex.build(spark.createDataFrame(TEXTS, "doc_id long, text string"), str(tmp_path), key="doc_id")
    asked = {1: ["alpha", "beta", "lph"], 2: ["alphabet", "gamma", "zzz", "bet"], 3: ["zzz"], 4: [], 5: ["alp", "lph", "pha"], 6: ["gammagamma"]}
    q = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    got = sorted((r["query_id"], r["doc_id"], r["overlap"]) for r in index.overlaps(q.unionByName(q), above=above).collect())
    want = [(k, i, sum(t in x.lower() for t in terms) / len(terms)) for k, terms in asked.items() if terms for i, x in TEXTS if i is not None and x is not None]
    assert got == sorted(w for w in want if w[2] > above)


def test_candidates_come_from_rare_terms(spark, tmp_path):
    """Less than a half of the texts' pairs with terms is read as postings."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = postings.TermIndex.build(docs, str(tmp_path), key="doc_id")
    q = catalog.benchmark_queries(spark, SF).select("query_id", hashing.query_terms(F.col("text")).alias("terms"))
    read = index.chosen(q, above=0.5).agg(F.sum("n")).first()[0]
    assert read < 0.5 * docs.count() * q.agg(F.sum(F.size("terms"))).first()[0]
    terms = q.select(F.explode("terms").alias("term")).distinct()
    assert index.rarest(terms).where("n = 0").count() == 0
