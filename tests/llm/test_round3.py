"""Merkle manifest, leaderboard and word windows against plain loops, and on awkward tables."""

import hashlib
import math
import random
import zlib
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import common, decontamination, leaderboard, lines, lm, merkle, queries, windows

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree long, idx string, row string, path string, spans string"
TEXTS = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one two three " * 3000, "en"), (5, "Tie Tie", "de"), (5, "Tie Tie", "de"), (5, "Another", "de"), (None, "no id", ""), (None, "no id", ""), (6, "é" * 50, "zz"),
    (7, "a " * 36 + "b", None), (8, "x y\x0bz\x0cw", "en"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, g, None if i == 2 else "s", 5, 9, "i", "r", "p", "s") for i, t, g in rows], DDL)


# 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, arity=8):
    """The root, and the siblings of each leaf level by level."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][k : k + arity])) for k in range(0, len(rows[-1]), arity)])
    proofs = []
    for k in range(len(leaves)):
        proof = ""
        for row in rows[:-1]:
            run = row[k // arity * arity : k // arity * arity + arity]
            proof += "".join(run[: k % arity] + run[k % arity + 1 :])
            k //= arity
        proofs.append(proof)
    return rows[-1][0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], sha("".join(map(enc, r)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [plain_tree([leaf for _, leaf in groups[g]]) for g in order]
    root, over = plain_tree([t[0] for t in trees])
    return sorted(((i, leaf, sub, root, proof + above) for g, (sub, proofs), above in zip(order, trees, over, strict=True) for (i, leaf), proof in zip(groups[g], proofs, strict=True)), key=repr)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize(("levels", "most"), [(3, 1 << 16), (1, 1 << 16), (1, 3)])
def test_manifest(spark, monkeypatch, levels, most):
    """One block a tree; many blocks merged to one forest; blocks of blocks."""
    monkeypatch.setattr(merkle, "MAX_BLOCKS", most)
    rng = random.Random(3)
    rows = [(k, f"text {k}", rng.choice(["en", "en", "en", "de", None, "é", "z"])) for k in range(700)] + TEXTS
    rows += [(1000 + k, "lone", f"g{k:03d}") for k in range(20)]
    df = docs(spark, rows)
    want = plain_manifest([tuple(r[c] for c in COLUMNS) for r in df.collect()])
    out = merkle.manifest(df, columns=COLUMNS, levels=levels).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in out), key=repr) == want
    assert all(r["verified"] and r["folded"] == r["root"] for r in out)


def test_manifest_tells_what_has_changed(spark):
    out = merkle.manifest(docs(spark), columns=COLUMNS, now={"text": F.when(F.col("doc_id") == 5, F.lower("text")).otherwise(F.col("text"))}).collect()
    assert sorted(r["doc_id"] for r in out if not r["verified"]) == [5, 5, 5]
    assert len({r["folded"] for r in out}) == 4  # rows alike fold to different roots, as their places differ


def test_manifest_of_few_rows(spark):
    (r,) = merkle.manifest(docs(spark, TEXTS[:1]), columns=COLUMNS).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded"] and r["proof"] == "" and r["verified"]
    assert merkle.manifest(docs(spark, []), columns=COLUMNS).collect() == []


def test_forest_is_associative():
    rng = random.Random(1)
    leaves = {(t, k): sha(f"{t} {k}").encode() for t, n in ((0, 73), (1, 1), (2, 600)) for k in range(n)}
    sizes, want = {0: 73, 1: 1, 2: 600}, {t: plain_tree([leaves[t, k].decode() for k in range(n)])[0] for t, n in ((0, 73), (1, 1), (2, 600))}
    for _ in range(5):
        keys = list(leaves)
        rng.shuffle(keys)
        parts = [merkle.Forest() for _ in range(7)]
        for t, k in keys:
            parts[rng.randrange(7)].add(t, sizes[t], 0, k, leaves[t, k])
        assert any(p.open for p in parts)
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            parts[rng.randrange(len(parts))].merge(a)
        assert not parts[0].open and {t: r.decode() for t, r in parts[0].roots.items()} == want


def test_a_partition_holds_few_unresolved_nodes():
    own = merkle.Forest()
    for k in range(1000, 5000):
        own.add(0, 100_000, 0, k, b"%064d" % k)
    assert sum(map(len, own.open.values())) <= 2 * 7 * 5


# 12


def plain_changes(lines, items, vendors):
    price = {i["item_id"]: i["price"] for i in items}
    nation = {v["vendor_id"]: v["nation_id"] for v in vendors}
    batches = {}
    for r in lines:
        key = ",".join("" if r[c] is None else str(r[c]) for c in ("sale_id", "item_id", "vendor_id", "line_no"))
        h = zlib.crc32(key.encode())
        s = 19723 + h % 150 if r["shipped_at"] is None else (r["shipped_at"] - datetime(1970, 1, 1)).days
        a = s + h % 7 + 20 * (h % 5 == 0)
        batches.setdefault(min(8, 1 + (a - 19723) * 8 // 180), []).append((a, s, r))
    revenue, boards, latest, out = {}, {}, None, []
    for b in sorted(batches):
        days = {}
        for a, s, r in batches[b]:
            n = nation.get(r["vendor_id"])
            if n is None or r["item_id"] not in price or r["item_id"] is None or (latest is not None and s + 15 < latest):
                continue
            p = price[r["item_id"]]
            cents = math.floor(100 * r["amount"] + 0.5) if r["amount"] is not None else 0 if r["quantity"] is None or p is None else r["quantity"] * math.floor(100 * p + 0.5)
            days.setdefault(a, []).append((n, r["item_id"], -cents if r["flag"] == "swapped" else cents))
        for a in sorted(days):
            for n, i, cents in days[a]:
                revenue.setdefault(n, {})[i] = revenue.get(n, {}).get(i, 0) + cents
            for n in {x[0] for x in days[a]}:
                now = sorted((-r, i) for i, r in revenue[n].items() if r > 0)[:10]
                old, new = boards.get(n, {}), {i: k + 1 for k, (_, i) in enumerate(now)}
                for i in {*old, *new}:
                    if old.get(i) != new.get(i):
                        out.append((n, a, i, b, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue[n][i]))
                boards[n] = new
        latest = max([s for _, s, _ in batches[b]] + ([latest] if latest is not None else []))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r[c] for c in ("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue")) for r in df.collect()), key=repr)


def shop(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sale_lines", "items", "vendors")]


def test_leaderboard_with_many_shards(spark):
    """Small shards, so that each nation's board is merged from those of many."""
    lines, items, vendors = shop(spark)
    vendors = vendors.withColumn("nation_id", F.col("nation_id") % 2)  # fewer, fuller boards
    lines = lines.withColumn("flag", F.when(F.col("line_no") % 2 == 0, "swapped").otherwise("kept")).withColumn("nation_id", F.lit("clash")).withColumn("day", F.lit("clash"))
    want = plain_changes(*[[r.asDict() for r in t.collect()] for t in (lines, items, vendors)])
    assert listed(leaderboard.changes(lines, items, vendors, shard_items=40)) == want
    assert {x[4] for x in want} == {"enter", "exit", "move"}


def test_leaderboard_of_nothing(spark):
    lines, items, vendors = shop(spark)
    assert listed(leaderboard.changes(lines.limit(0), items, vendors)) == []


def test_shard_ledger(monkeypatch):
    monkeypatch.setattr(leaderboard, "RESERVE", 15)
    rng = np.random.default_rng(2)
    items = rng.choice(10_000, 300, replace=False).astype(np.int64)
    items.sort()
    ledger, revenue = leaderboard.ShardLedger(np.zeros(0, np.int64), np.zeros(0, np.int64), items), dict.fromkeys(items.tolist(), 0)
    for _ in range(200):
        own = np.sort(rng.choice(items, rng.integers(1, 60), replace=False))
        cents = rng.integers(-9, 10, len(own)) * rng.integers(1, 4)
        ledger.add(own, cents)
        for i, c in zip(own.tolist(), cents.tolist(), strict=True):
            revenue[i] += c
        assert list(ledger.ranking.board().items()) == [(i, -r) for r, i in sorted((-r, i) for i, r in revenue.items() if r > 0)[:10]]


def test_lines_are_prepared(spark):
    t = datetime(2024, 1, 3, 23, 59)
    rows = [(1, 1, 1, 1, 2, 0.125, "kept", t), (1, 1, 1, 1, 2, 0.125, "kept", t), (1, 2, 1, 1, 3, None, "swapped", t), (1, 3, 2, 1, None, None, "kept", t), (1, 4, 9, 1, 1, 1.0, "kept", None), (1, 5, None, None, 1, 1.0, None, t)]
    lines = spark.createDataFrame(rows, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz")
    items = spark.createDataFrame([(1, 2.5), (1, 2.0), (2, None), (None, 1.0)], "item_id long, price double")
    vendors = spark.createDataFrame([(1, 4), (1, 3), (2, None), (None, 1)], "vendor_id long, nation_id int")
    out = [(r["nation_id"], r["item_id"], r["cents"]) for r in leaderboard.prepared(lines, leaderboard.prices(items), leaderboard.nations(vendors)).collect()]
    assert sorted(out, key=repr) == sorted([(3, 1, 13), (3, 1, 13), (3, 1, -750), (3, 2, 0), (3, None, 100), (None, None, 100)], key=repr)


def test_sums_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("nation_id"), F.lit(19723).alias("day"), (F.col("id") % 3).alias("item_id"), F.lit(1).cast("long").alias("cents")).coalesce(2)
    out = leaderboard.summed(rows, 4).collect()
    assert len(out) <= 6 and sum(r["cents"] for r in out) == 20_000


# 13


def left(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=repr)


def brute(rows, words):
    return sorted(((i, *b) for (i, _), b in zip(rows, windows.brute_force([t for _, t in rows], words), strict=True)), key=repr)


@pytest.mark.parametrize("bits", [None, 8])
@pytest.mark.parametrize("words", [3, 4, 7])
def test_windows(spark, bits, words):
    """Small alphabets, periodic texts and copies; with a sketch that is full, all windows are grouped."""
    rng = random.Random(words)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for k in range(60)]
    rows += [(100, "a " * 50), (101, "a b " * 30), (102, "p q r s t u v w x y z"), (103, "P q r s t u v w x y z"), (103, "n q r s t u v w x y zz"), (104, None), (105, " \t\x0b"), (None, "p q r s t u"), (106, "p\tq\n r  s\x0ct\x0du"), (107, "é ü ß é ü ß")]
    rows += [(200 + k, rows[7][1]) for k in range(20)]
    df = spark.createDataFrame([(i, t, "r", "l") for i, t in rows], "doc_id long, text string, row string, lo string")
    assert left(windows.remove_repeats(df, words=words, bits=bits)) == brute(rows, words)


def test_windows_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows, windows.WORDS)
    assert left(windows.remove_repeats(df)) == want
    assert sum(w[2] for w in want) > 1000


def test_pieces_of_texts():
    """In whatever pieces texts are read, their windows are the same, each once."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (0, 3, 40, 2000, 7, 60, 9, 1)]
    column = pa.array([None, *[t.encode() for t in texts]], pa.binary())

    def listed(**sizes):
        reader, out = windows.Reader(7, **sizes), []
        for p in reader.pieces(column):
            own = np.searchsorted(p.begin, p.windows, side="right") - 1
            hashes = reader.hashes.runs(p.prefix[0], 0, p.windows, p.windows + 7)
            out += zip(p.text[own].tolist(), (p.windows - p.begin[own] + p.skipped[own]).tolist(), hashes.tolist(), p.key[p.anchor].tolist(), strict=True)
        return sorted(out)

    whole = listed()
    assert len(whole) == sum(max(0, len(t.split()) - 6) for t in texts)
    assert listed(piece=100, slice_bytes=50) == listed(piece=64, slice_bytes=300) == whole


def test_windows_of_long_and_odd_texts(spark):
    """A long text, a word of 2 MB, and bytes that are not UTF-8."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(300)}" for _ in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[480:560])), (3, " ".join(words[1990:2040])), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + " b" * 40), (6, " ".join(words[495:505] * 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert left(windows.remove_repeats(df)) == brute(rows, windows.WORDS)
    odd = spark.createDataFrame([(1,), (2,)], "doc_id long").select("doc_id", F.concat(F.unhex(F.lit("ff20fe")), F.encode(F.lit(" a" * 40), "UTF-8")).cast("string").alias("text"))
    out = windows.remove_repeats(odd, words=5).select("n_words", "n_removed", F.octet_length("kept")).collect()
    assert [tuple(r) for r in out] == [(42, 42, 0)] * 2
    assert windows.remove_repeats(df.limit(0)).collect() == []


def test_hot_windows_are_joined_apart(spark, monkeypatch):
    """Every window that repeats is hot, or none is: the same result by broadcast and by shuffle."""
    rows = [(k, f"u{k} " + "the very same passage of eight words here " + f"v{k}") for k in range(30)] + [(99, "alone " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 10**9):
        monkeypatch.setattr(common, "HOT_PARTS", parts)
        assert left(windows.remove_repeats(df, words=5)) == brute(rows, 5)


def test_sketch_overestimates():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    keys = np.concatenate((keys, keys[:500]))
    rng.shuffle(keys)
    bits = 1 << 13
    parts = []
    for part in np.array_split(keys, 5):
        s = windows.Sketch(bits)
        s.add(part)
        parts.append({k: windows.unpacked(p) for k, p in s.slices()})
    whole = windows.Sketch(bits)
    whole.add(keys)
    total = parts[0]
    for p in parts[1:]:
        total = {k: windows.merged(total[k], p[k]) if k in total and k in p else total.get(k, p.get(k)) for k in {*total, *p}}
    assert {k: windows.unpacked(p).tolist() for k, p in whole.slices()} == {k: v.tolist() for k, v in total.items()}  # partition by partition as at once
    values, times = np.unique(keys, return_counts=True)
    twice = np.ones(len(values), bool)
    for plane, at in zip(whole.planes[:, 1], windows.cells(values, bits), strict=True):
        twice &= plane[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    assert twice[times > 1].all() and not twice.all()


def test_anchors_occur_as_often_as_their_windows():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(30)]
    reader, count, of = windows.Reader(9), {}, {}
    for p in reader.pieces(pa.array([t.encode() for t in texts], pa.binary())):
        for place in set(p.anchor.tolist()):
            count[int(p.key[place])] = count.get(int(p.key[place]), 0) + 1
        words = " ".join(texts).split()
        for w, a in zip(p.windows.tolist(), p.anchor.tolist(), strict=True):
            of.setdefault(tuple(words[w : w + 9]), []).append(int(p.key[a]))
    assert all(len(set(keys)) == 1 and count[keys[0]] >= len(keys) for keys in of.values())


def test_new_queries_are_registered():
    assert {"op11_merkle", "op12_leaderboard", "op13_substrings"} <= set(queries.queries()) & set(queries.oracle_sql())


# What earlier operators do with long words and hot windows


def test_long_words_are_told_by_digests(spark):
    """A word of 50 MB, two that differ in their last byte, and none of them sent out whole."""
    big = "z" * 50_000_000
    rows = [(1, big), (3, big + " " + "y" * 100), (4, "y" * 99 + "x y"), (5, "y" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {bytes(r["word"]): r["n"] for r in lm.word_counts(df).collect()}
    assert max(map(len, counts)) <= 64 and sorted(counts.values()) == [1, 1, 1, 1, 2, 4]  # and four ends
    out = {r["doc_id"]: r for r in lm.score(df).collect()}
    known = {k: (zlib.crc32(str(k).encode()) % 7 == 2) for k in out}
    assert all(r["held_out"] == known[k] for k, r in out.items())
    n = sum(len(t.split()) + 1 for k, t in rows if not known[k])
    assert all(r["train_tokens"] == n for r in out.values())


def test_a_held_out_document_many_times(spark):
    """Its words have no counts in training, however many rows repeat it: nothing is gathered, all rows score alike."""
    (held,) = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][:1]
    free = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2]
    df = spark.range(10_000).select(F.lit(held).cast("long").alias("doc_id"), F.lit("unseen words only here").alias("text")).unionByName(spark.createDataFrame([(k, f"some training text {k}") for k in free], "doc_id long, text string"))
    out = lm.score(df).where(F.col("doc_id") == held).groupBy("n_tokens", "n_known", F.round("score", 9).alias("s"), F.round("base_score", 9).alias("b")).count().collect()
    assert [(r["n_tokens"], r["n_known"], r["count"]) for r in out] == [(5, 1, 10_000)]


def test_a_window_in_half_of_all_documents(spark):
    """Occurrences of a hot window are dealt to salts, so no task gets them all; results stay."""
    passage = "a licence passage of thirteen words that stands in very many of the texts"
    rows = [(k, f"text {k} says {passage} and more") if k % 2 else (k, f"clean text {k}") for k in range(2000)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage), (2, passage), (3, "another item")], "item_id long, text string")
    out = decontamination.hits(df, items).groupBy("n_hit", "n_items", "contaminated").count().collect()
    assert sorted(tuple(r) for r in out) == [(0, 0, False, 1000), (14, 2, True, 1000)]
    occurrences = spark.range(2000).select(F.col("id").alias("row"), F.lit(3).cast("long").alias("start"), F.lit(13).cast("long").alias("n"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("wid"))
    owners = spark.createDataFrame([(7, 1), (7, 2), (9, 1)], "wid long, item_id long")
    dealt = decontamination.owned(occurrences, owners, 16)
    assert dealt.count() == dealt.select("row", "item_id").distinct().count() == 2003  # 1001 rows with two items, one with one


def test_line_index_is_kept_between_calls(spark, tmp_path):
    """Batches added one by one, each by an index opened anew, give what one pass over all rows gives; two levels are in use."""
    line = lambda k: f"a line of more than twenty characters number {k}"
    rows = [(k, "\n".join(line(x) for x in {k % 5, k % 3 + 10, 100 + k})) for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lines.dedup_lines(df).collect()))
    assert sum(r[2] for r in want) == 112
    for b in range(7):
        lines.LineIndex(spark, str(tmp_path), fanout=2).add(df.where(F.col("doc_id") % 7 == b))
    index = lines.LineIndex(spark, str(tmp_path), fanout=2)
    assert sum(bool(level) for level in index.runs().levels) >= 2 and len(index.runs().levels) >= 2
    assert sorted(map(tuple, index.dedup(df).collect())) == want
    held = index.runs().all().count()
    assert held == index.runs().all().select("hash").distinct().count() == 68
    before = index.store.version()
    some = spark.createDataFrame([(100 + k, line(999)) for k in range(3)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in index.dedup(some).collect()) == [0, 0, 0]
    index.add(some)
    assert sorted(r["n_dropped"] for r in index.dedup(some).collect()) == [0, 1, 1]
    assert index.runs(before).all().count() == held  # the older version is whole
    assert lines.LineIndex(spark, str(tmp_path / "new")).dedup(some).agg(F.sum("n_dropped")).first()[0] == 0
