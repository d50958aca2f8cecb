"""Column builders on inline rows, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from foliant.functions import hashing, intents, quality, text as tx, vectors as vx


def one(spark, build, *values):
    df = spark.createDataFrame([values], [f"c{k}" for k in range(len(values))])
    return df.select(build(*[F.col(c) for c in df.columns]).alias("v")).first()["v"]


def test_white_space(spark):
    assert one(spark, tx.collapse, " a 　b﻿ c\t\n") == "a b c"
    assert one(spark, tx.strip, "﻿ x y ") == "x y"


@pytest.mark.parametrize(("text", "query", "want"), [("Alpha beta", "beta", "Alpha beta"), ("x" * 100 + " needle " + "y" * 200, "NEEDLE", "..." + "x" * 59 + " needle " + "y" * 89 + "..."), ("abc", "", "abc"), ("z" * 300, "q", "z" * 180)])
def test_snippet_for(spark, text, query, want):
    assert one(spark, tx.snippet_for, text, query) == want


def fnv(s, h=2166136261):
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("token", ["", "a", "foobar", "v1.2", "a-b_c/d:e"])
def test_fnv_and_sign(spark, token):
    assert one(spark, hashing.fnv1a, token) == fnv(token)
    assert one(spark, hashing.is_positive, token) == (fnv(token, 1469598103) % 2 == 0)


def test_tokens(spark):
    assert one(spark, hashing.tokens, "a bc Foo-Bar v1.2 ÄÖ naïve") == ["bc", "foo-bar", "v1.2", "na", "ve", "foo", "oo-", "o-b", "-ba", "bar", "v1.", "1.2"]
    assert one(spark, hashing.tokens, "") == []
    assert one(spark, hashing.query_terms, "bc abc abc") == ["abc"]


@pytest.mark.parametrize(("text", "want"), [("x" * 39, True), ("x" * 40, False), ("Intro ........ 3 and more words go here now", True), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", True)])
def test_noisy(spark, text, want):
    assert one(spark, quality.is_noisy, text) is want


def test_formula(spark):
    assert one(spark, quality.is_formula_heavy, "b k = n k + c") is True
    assert one(spark, quality.is_formula_heavy, "the quick brown fox jumps over the lazy dog") is False


def test_readability(spark):
    s = "A window is defined as a set of rows that is a view."
    assert one(spark, quality.readability, s) == pytest.approx(13 / 20 + 0.3 + 0.2 + 0.5)
    assert one(spark, quality.chunk_readability, "short") == 0


def test_clean_snippet(spark):
    assert one(spark, quality.clean_snippet, "The end  of\nit . 37 ") == "The end of it"


@pytest.mark.parametrize(("text", "want"), [("Done.", False), ("Done.”", False), ("and,", True), ("word", True), ("(so)", True), ("", False), ("  ", False)])
def test_truncated(spark, text, want):
    assert one(spark, quality.looks_truncated, text) is want


def test_merge(spark):
    base = "the quick brown fox jumps over"
    assert one(spark, quality.merge_continuation, base, "FOX JUMPS OVER the dog") == base + " the dog"  # 14 characters overlap
    assert one(spark, quality.merge_continuation, base, "jumps over it") == base + " jumps over it"  # 10 are too few
    assert one(spark, quality.merge_continuation, base, "") == base
    assert one(spark, quality.merge_continuation, "", "  x") == "x"
    assert one(spark, quality.merge_continuation, "word", ", then") == "word, then"
    left = "a" * 81
    assert one(spark, quality.merge_continuation, left, "a" * 81) == left + " a"  # at most 80


@pytest.mark.parametrize(("prompt", "want"), [("Please open page 3", ""), ("What is the window function?", "window function"), ("page 999", ""), ("tell me about joins!!", "about joins"), ("theory of an angle", "theory of angle")])
def test_clean_query(spark, prompt, want):
    assert one(spark, intents.clean_query, prompt) == want


@pytest.mark.parametrize(
    ("build", "yes", "no"),
    [
        (intents.is_correction, "that’s not a summary", "thats it"),
        (intents.is_pointing, "show me where it says so", "show it"),
        (intents.is_summary_like, "the main idea, please", "summary"),
        (intents.is_broad, "why so", "when"),
        (intents.wants_summary, "Give me an Overview", "summary view"),
        (intents.wants_list, "list them", "listing"),
        (intents.wants_definition, "What is a join", "whatever"),
        (intents.is_navigation, "go to the end", "gone"),
    ],
)
def test_intents(spark, build, yes, no):
    assert one(spark, build, yes) is True
    assert one(spark, build, no) is False


def test_page_and_topic(spark):
    assert one(spark, intents.explicit_page, "open Page  12 now") == 12
    assert one(spark, intents.explicit_page, "pages 12") is None
    assert one(spark, intents.topic, "What is the shuffle?") == "shuffle"
    assert one(spark, intents.topic, "why") is None
    assert one(spark, intents.profile_terms, "What about the Shuffle shuffle plan") == ["the", "shuffle", "plan"]


def test_vectors(spark):
    assert one(spark, vx.softmax, [0.0, math.log(3)]) == pytest.approx([0.25, 0.75])
    assert one(spark, vx.rms_norm, [3.0, 4.0]) == pytest.approx([3 / math.sqrt(12.5), 4 / math.sqrt(12.5)], rel=1e-5)
    assert one(spark, vx.argmax, [1.0, 5.0, 5.0]) == 1
    assert one(spark, lambda a: vx.clamp_tail(a, 2), [1, 2, 3]) == [2, 3]
    assert one(spark, vx.mat_vec, [[1.0, 2.0], [3.0, 4.0]], [5.0, 6.0]) == [17.0, 39.0]
    assert one(spark, vx.l2_normalize, [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, lambda a: vx.pack_signature(a, 32), [-1.0, 0.0, 1.0] + [-1.0] * 29) == [6]
    assert one(spark, vx.hamming, [5, 1], [6, 1]) == 2
    assert one(spark, lambda x: vx.softplus(x), 0.0) == pytest.approx(math.log(2))
    assert one(spark, lambda a: vx.rotate_pairs(a, 0), [1.0, 2.0]) == [1.0, 2.0]


def test_strings(spark):
    assert one(spark, tx.encode_key, "aé") == "blob-61c3a9"
    assert one(spark, lambda a: tx.relative_path(a, F.lit("x")), "a/b/c.json") == "a/b/x"
    assert one(spark, lambda a: tx.relative_path(a, F.lit("x")), "c.json") == "x"
    assert one(spark, tx.url_path, "a b/ü(1)!") == "a%20b/%C3%BC(1)!"
    assert one(spark, tx.format_bytes, 1536) == "1.5 KB"
    assert one(spark, tx.format_bytes, 0) == "0 B"
    assert one(spark, tx.format_bytes, 200 * 1024 * 1024) == "200 MB"
    assert one(spark, tx.escape_html, "<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, tx.safe_url, "javascript:alert(1)") is None
    assert one(spark, tx.safe_url, "/rel") == "/rel"
    assert one(spark, tx.sanitize_generated, "<|im|> hi <|end|>") == "hi"
    for line, want in {"": "blank", "```py": "fence", "## x": "heading", " > q": "quote", "- a": "unordered", "1. a": "ordered", "---": "rule", "a": "paragraph"}.items():
        assert one(spark, tx.line_class, line) == want


def test_sql_functions(spark):
    from foliant.plans.api import register_functions

    register_functions(spark)
    row = spark.sql("SELECT fnv1a('foobar') AS h, is_noisy('x') AS n, query_terms('bc abc abc') AS q, hamming(array(5L), array(6L)) AS d, pack_signature(array(-1F, 0F, 1F)) AS s").first()
    assert tuple(row) == (fnv("foobar"), True, ["abc"], 2, [6])
    df = spark.createDataFrame([("foobar",)], ["t"])
    assert df.select(F.expr("fnv1a(t)")).first()[0] == fnv("foobar")
