"""Repeated passages by a logarithmic family of sparse suffix arrays that are merge-scanned and merged geometrically."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, bitmap
from foliant.llm.runs import Levels

#: Bytes of a passage, and of the head of a suffix. Of each LENGTH - HEAD + 1 heads in a row the least is sampled,
#: so every passage of LENGTH bytes holds a sampled suffix, at the same place wherever the passage stands.
LENGTH, HEAD = 200, 64
#: Windows that are hashed at once; bounds the memory of a task (about 100 bytes each).
PIECE = 1 << 20
PLACE_BITS = 21
#: A suffix with more differing surroundings than this is compared passage by passage; others in buckets of about so many.
HOT_KINDS, KINDS_PER_BUCKET = 2000, 3000

_RNG = np.random.default_rng(977)
_BYTES = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _RNG.integers(2**62, 2**63, 2, dtype=np.uint64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base % 2**64, np.uint64))), dtype=np.uint64)


class Rolling:
    """Hashes of any part of a byte string from prefix sums modulo 2**64; two independent families."""

    def __init__(self, family: int, n: int):
        self.values = _BYTES[family]
        self.powers = _powers(_BASES[family], n)
        self.inverse = _powers(pow(_BASES[family], -1, 2**64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[: len(data)], dtype=np.uint64)))

    def parts(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[at])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Sampler:
    """Sampled suffixes of texts: runs of passages whose sampled suffix is the same."""

    def __init__(self, length: int = LENGTH, head: int = HEAD):
        n = PIECE + 2 * length + 16
        self.length, self.head, self.heads, self.regions = length, head, Rolling(0, n), Rolling(1, n)

    def runs(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """data: texts one after another. For each run: head's hash, hash of all its passages, first passage, their number, suffix's place."""
        width, m = self.length - self.head + 1, len(data) - self.head + 1
        if len(data) < self.length:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        heads = self.heads.parts(self.heads.prefix(data), slice(0, m), slice(self.head, self.head + m), slice(0, m))
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
        keys[:m] = (heads & ~low) | (low - np.arange(m, dtype=np.uint64))  # the last of equal heads
        grid = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
        n = m - width + 1
        place = (low - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low)).astype(np.int64)
        ends = np.repeat(np.cumsum(lengths), lengths)
        s = np.flatnonzero(np.arange(n) + self.length <= ends[:n])
        if not len(s):
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        at = place[s]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1))))
        first, last, at = s[new], s[np.concatenate((new[1:] - 1, [len(s) - 1]))], at[new]
        region = self.regions.parts(self.regions.prefix(data), first, last + self.length, first)
        region = mixed(region + mixed((at - first).astype(np.uint64) * _MIX + (last - first).astype(np.uint64)))
        return heads[at], region, first, last - first + 1, at

    def pieces(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(data, lengths, text's place in the list, its first byte's place in its text); a long text comes in overlapping pieces."""
        own, size = [], 0
        for k, t in enumerate(texts):
            if len(t) < self.length:
                continue
            if size + len(t) > PIECE and own:
                yield self._joined(own)
                own, size = [], 0
            for a in range(0, len(t), PIECE):
                part = t[a : a + PIECE + self.length - 1]
                if len(part) < self.length:
                    break
                own.append((k, a, part))
                size += len(part)
                if len(t) > PIECE:
                    yield self._joined(own)
                    own, size = [], 0
        if own:
            yield self._joined(own)

    @staticmethod
    def _joined(own: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(p for _, _, p in own), np.uint8), np.array([len(p) for _, _, p in own]), np.array([k for k, _, _ in own]), np.array([a for _, a, _ in own])


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as a signed number that sorts as the bytes do."""
    eight = np.ascontiguousarray(data[at[:, None] + np.arange(8)])
    return (eight.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def suffix_rows(texts: DataFrame, length: int, batches: int) -> DataFrame:
    """(batch, prefix, head, region) of every sampled suffix of (text_a, body)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, min(HEAD, length // 2))
        for part in parts:
            of = np.mod(part.column(0).to_numpy(), batches).astype(np.int32)
            for data, lengths, which, _ in sampler.pieces(_texts(part.column(1))):
                head, region, first, _, at = sampler.runs(data, lengths)
                piece = np.searchsorted(np.cumsum(lengths) - lengths, first, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(of[which[piece]]), pa.array(leading(data, at)), pa.array(head.view(np.int64)), pa.array(region.view(np.int64))], names=["batch", "prefix", "head", "region"])

    return texts.select("text_a", "body").mapInArrow(run, "batch int, prefix long, head long, region long")


def suffix_family(scratch: Scratch, *, fanout: int = 4) -> Levels:
    """Levels of sparse suffix arrays: (prefix, head, n, low, high), with the least and greatest region hash.

    Each batch's sampled suffixes are sorted and merge-scanned against the levels' arrays for heads they have; those
    they lack become the batch's own array. Order is by the first eight bytes, then by the hash of the 64 of the head:
    suffixes with a common head, which is what a long match starts from, are neighbours, and the order of those
    that differ behind the eighth byte tells nothing that the scan needs. Arrays lie in hash partitions, so hot text is dealt evenly.
    """
    return Levels(scratch, "suffixes", ["prefix", "head"], {"n": "sum", "low": "min", "high": "max"}, fanout=fanout)


def per_head(suffixes: DataFrame) -> DataFrame:
    return suffixes.groupBy("prefix", "head").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("low"), F.max("region").alias("high"))


def repeated_spans(texts: DataFrame, scratch: Scratch, *, length: int = LENGTH, batches: int = 4, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """(text_a, text_b, spans): for each text, by two hashes, the first and last starts of passages found anywhere else.

    ``texts`` has text_a, text_b and body (binary). Three steps: the family counts sampled suffixes over all texts;
    suffixes found more than once are listed with their text (a bit map of bounded size passes them, exact counts
    decide); where all passages around a suffix are the same everywhere the run counts as a whole, and only where
    they differ are its passages compared one by one, with their bytes.
    """
    family = suffix_family(scratch)
    sampled = scratch.write(suffix_rows(texts, length, batches), "sampled", by="batch")  # texts are read for it once
    for b in range(batches):
        family.add(per_head(sampled.where(F.col("batch") == b)))
    scratch.drop("sampled")
    often = scratch.write(family.all().where("n >= 2"), "often")
    family.drop()
    n_often, n_mixed = often.agg(F.count(F.lit(1)), F.count(F.when(F.col("low") != F.col("high"), 1))).first()
    maps = [np.frombuffer(bitmap(often.where(c).select("head"), "head", n), np.uint8) for c, n in (("true", n_often), ("low <> high", n_mixed))]
    scratch.drop("often")
    sent = texts.sparkSession.sparkContext.broadcast(maps)

    def listed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, min(HEAD, length // 2))
        for batch in batches_:
            a, b, body = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _texts(batch.column(2))
            for data, lengths, which, offset in sampler.pieces(body):
                head, region, first, n, at = sampler.runs(data, lengths)
                passed = []
                for bits in sent.value:
                    h = head & np.uint64(len(bits) * 8 - 1)
                    passed.append((bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0)
                keep = np.flatnonzero(passed[0])
                # One copy of each surrounding a batch is enough to compare.
                once = np.zeros(len(head), bool)
                once[np.unique(region, return_index=True)[1]] = True
                passed[1] &= once
                begins = np.cumsum(lengths) - lengths
                piece = np.searchsorted(begins, first[keep], side="right") - 1
                body_of = [data[f : f + k + length - 1].tobytes() if m else None for f, k, m in zip(first[keep].tolist(), n[keep].tolist(), passed[1][keep].tolist(), strict=True)]
                start = first[keep] - begins[piece] + offset[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[which[piece]]), pa.array(b[which[piece]]), pa.array(head[keep].view(np.int64)), pa.array(region[keep].view(np.int64)), pa.array(start), pa.array(n[keep].astype(np.int32)), pa.array((at - first)[keep].astype(np.int32)), pa.array(body_of, pa.binary())],
                    names=["text_a", "text_b", "head", "region", "start", "n", "lead", "bytes"],
                )

    found = scratch.write(texts.mapInArrow(listed, "text_a long, text_b int, head long, region long, start long, n int, lead int, bytes binary"), "found")
    kinds = scratch.write(found.groupBy("head", "region").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n")), "kinds")
    around = found.where("bytes is not null").select("head", "region", "lead", "bytes")
    hot = around.groupBy("head").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > hot_kinds).select("head", F.lit(True).alias("hot"))
    # A marker without bytes says that a surrounding occurs once.
    rows = around.unionByName(kinds.where("times = 1").select("head", "region", F.lit(None).cast("int").alias("lead"), F.lit(None).cast("binary").alias("bytes")))
    rows = scratch.write(rows.join(hot, "head", "left"), "rows")
    n_rows = rows.where("hot is null").count()
    bucket = F.pmod(F.xxhash64("head"), F.lit(max(1, n_rows // KINDS_PER_BUCKET))).cast("int")
    few = rows.where("hot is null").drop("hot").groupBy(bucket.alias("bucket")).applyInArrow(_compared(length), "head long, region long, lo int, hi int")
    part = few.unionByName(_hot_compared(rows.where("hot").drop("hot"), length))
    verdicts = scratch.write(part.unionByName(kinds.where("times >= 2").select("head", "region", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))), "verdicts")
    places = found.select("text_a", "text_b", "head", "region", "start")
    met = places.join(verdicts, ["head", "region"]).select("text_a", "text_b", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("span"))
    return met.groupBy("text_a", "text_b").agg(F.collect_set("span").alias("spans"))  # copies of a text collapse before the shuffle


def _same_bytes(bodies: list[bytes], which: np.ndarray, nth: np.ndarray, length: int, group: np.ndarray) -> np.ndarray:
    """Whether each passage has another of its group (by hash) with the same bytes; all passages of a group are looked at."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum([0, *map(len, bodies)])[which] + nth
    order = np.argsort(group, kind="stable")
    first = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    same = np.ones(len(order), bool)
    step = max(1, (1 << 22) // length)
    for a in range(0, len(order), step):
        own, at = order[a : a + step], np.arange(length)
        same[a : a + step] = (data[begin[own][:, None] + at] == data[begin[lead[a : a + step]][:, None] + at]).all(1)
    out = np.ones(len(order), bool)
    if not same.all():  # hashes that collide: groups again, by the bytes themselves
        odd = np.isin(group, group[order[~same]])
        seen: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(odd).tolist():
            seen.setdefault((int(group[k]), data[begin[k] : begin[k] + length].tobytes()), []).append(k)
        for ks in seen.values():
            out[ks] = len(ks) > 1
    return out


def _passages(sampler: Sampler, leads: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(surrounding, number of the passage in it, hash) of all passages; the hash holds the suffix's place in the passage."""
    which, nth, hashes = [], [], []
    for at in range(0, len(bodies), 2000):
        part, lead = bodies[at : at + 2000], leads[at : at + 2000]
        data, lengths = np.frombuffer(b"".join(part), np.uint8), np.array([len(p) for p in part])
        count = lengths - sampler.length + 1
        own = np.repeat(np.arange(len(part)), count)
        k = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(lengths) - lengths, count) + k
        found = sampler.regions.parts(sampler.regions.prefix(data), start, start + sampler.length, start)
        which.append(own + at)
        nth.append(k)
        hashes.append(mixed(found + mixed((lead[own] - k).astype(np.uint64) + np.uint64(7))))
    return np.concatenate(which), np.concatenate(nth), np.concatenate(hashes)


def _compared(length: int):
    """Passages that two surroundings of a suffix share, byte by byte, as runs in those surroundings that occur once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        full = pc.is_valid(group.column("bytes")).to_numpy(zero_copy_only=False)
        head, region = group.column("head").to_numpy(), group.column("region").to_numpy()
        places = np.flatnonzero(full)
        places = places[np.unique(region[places], return_index=True)[1]]
        none = pa.table({"head": pa.array([], pa.int64()), "region": pa.array([], pa.int64()), "lo": pa.array([], pa.int32()), "hi": pa.array([], pa.int32())})
        if not len(places):
            return none
        sampler = Sampler(length, min(HEAD, length // 2))
        bodies = [x.as_buffer().to_pybytes() for x in group.column("bytes").take(pa.array(places)).combine_chunks()]
        which, nth, hashes = _passages(sampler, group.column("lead").take(pa.array(places)).to_numpy().astype(np.int64), bodies)
        keys = mixed(hashes + mixed(head[places].view(np.uint64))[which])
        inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        once = np.isin(region[places], region[~full])
        shared = np.flatnonzero(counts[inverse] >= 2)
        if len(shared):
            shared = shared[_same_bytes(bodies, which[shared], nth[shared], length, inverse[shared])]
        hit = shared[once[which[shared]]]
        which, nth = which[hit], nth[hit]
        if not len(which):
            return none
        new = np.concatenate(([True], (which[1:] != which[:-1]) | (nth[1:] != nth[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(which) - 1]))
        own = places[which[first]]
        return pa.table({"head": pa.array(head[own]), "region": pa.array(region[own]), "lo": pa.array(nth[first].astype(np.int32)), "hi": pa.array(nth[last].astype(np.int32))})

    return run


def _hot_compared(rows: DataFrame, length: int) -> DataFrame:
    """The same for suffixes with very many surroundings: passages one by one, without gathering a suffix's in one task."""

    def single(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, min(HEAD, length // 2))
        for batch in parts:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bodies = [x.as_buffer().to_pybytes() for x in part.column(3)]
                which, nth, hashes = _passages(sampler, part.column(2).to_numpy().astype(np.int64), bodies)
                own = pa.array(which)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(hashes.view(np.int64)), pa.array(nth.astype(np.int32))], names=["head", "region", "passage", "nth"])

    distinct = rows.where("bytes is not null").groupBy("head", "region", "lead", "bytes").agg(F.count(F.lit(1)).alias("times")).drop("times")
    passages = distinct.mapInArrow(single, "head long, region long, passage long, nth int")
    shared = passages.groupBy("head", "passage").agg(F.count(F.lit(1)).alias("kinds")).where("kinds >= 2").select("head", "passage")
    once = rows.where("bytes is null").select("head", "region")
    return passages.join(shared, ["head", "passage"]).join(once, ["head", "region"], "left_semi").select("head", "region", F.col("nth").alias("lo"), F.col("nth").alias("hi"))


def union_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes, [lo, hi)."""
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > far[:-1]))
    return lo[new], far[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(lo) - 1]))]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = 4, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """Each whole text, as UTF-8 bytes, without the bytes in any passage of ``length`` that also starts elsewhere.

    Returns the key, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left).

    * Null texts count as empty; texts below ``length`` bytes lose nothing; a text with nothing left keeps no bytes.
    * Overlaps count, matches never cross documents, and passages are judged on the input.
    * Passages in differing surroundings are compared by their bytes. Surroundings that occur again as a whole are told
      by two hashes of 64 bits (in 10**12 sampled suffixes, about 70 TB, a false match is expected 10**-15 times),
      whole texts by hashes of 64 and 32 bits (in 10**11 texts 10**-7 times). Suffixes in more than HOT_KINDS
      surroundings are compared by two hashes of 64 bits.
    * Rows that repeat a text are places of their own, so both lose what is long enough. Null keys are kept as they
      are. Empty tables give empty results; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_a"), F.hash(text).alias("text_b"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    spans = scratch.write(repeated_spans(keyed.select("text_a", "text_b", "body"), scratch, length=length, batches=batches, hot_kinds=hot_kinds), "spans")
    for name in ("found", "kinds", "rows", "verdicts"):
        scratch.drop(name)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n, removed, count, kept = [], [], [], []
            for t, s in zip(_texts(batch.column(1)), batch.column(2), strict=True):
                n.append(len(t))
                if not s.is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.append(t)
                    continue
                pairs = s.values
                lo, hi = union_spans(pairs.field(0).to_numpy(), pairs.field(1).to_numpy() + length)
                removed.append(int((hi - lo).sum()))
                count.append(len(lo))
                edges = np.concatenate(([0], np.column_stack((lo, hi)).ravel(), [len(t)])).tolist()
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(spans, ["text_a", "text_b"], "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: list[bytes | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of what is left) by looking at every window; for tests."""
    count: dict[bytes, int] = {}
    texts = [t or b"" for t in texts]
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] = count.get(t[s : s + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out

