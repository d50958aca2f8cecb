"""Repeated word windows: a count-min sketch names windows that may repeat, a second pass groups those exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, join_hot
from foliant.llm.suffixes import mixed, union_spans
from foliant.llm.words import split

#: Words of a window.
WORDS = 35
#: Bytes of texts, and words of one text, that are hashed at once; bound the memory of a task.
SLICE_BYTES, PIECE = 2 << 20, 1 << 18
#: Rows of the sketch; bits of a row at least and at most (64 MB), and of a slice, the unit in which partial sketches are merged.
DEPTH, MIN_BITS, MAX_BITS, SLICE_BITS = 2, 1 << 18, 1 << 29, 1 << 20
#: Bytes of text for one counted anchor, about: an anchor every nine or ten words.
BYTES_PER_ANCHOR = 60

_SAME = np.arange(256, dtype=np.uint8)
_BASES = (0x9E6C63D0876A9A47, 0xD1B54A32D192ED03)
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0d]+")


class Hashes:
    """Hashes of any run of words, twice 64 bits, from prefix sums modulo 2**64 over 128 bits a word."""

    def __init__(self) -> None:
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def grow(self, n: int) -> None:
        if len(self.powers[0]) <= n:
            n = max(n + n // 4, 1 << 16)
            step = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))), dtype=np.uint64)
            self.powers, self.inverse = [step(b) for b in _BASES], [step(pow(b, -1, 2**64)) for b in _BASES]

    def prefixes(self, lanes: np.ndarray) -> list[np.ndarray]:
        n = lanes.shape[1]
        self.grow(n)
        return [np.concatenate((np.zeros(1, np.uint64), np.cumsum(lanes[k] * self.powers[k][:n], dtype=np.uint64))) for k in range(2)]

    def runs(self, prefix: np.ndarray, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[lane][start])


@dataclass
class Piece:
    """Some texts' words, one after another. text: their places in the batch; begin: where each begins here; skipped: words of the
    text that lie before; windows: the places of all whole windows; anchor: the place of each window's anchor; key: hashes by place."""

    prefix: list[np.ndarray]
    text: np.ndarray
    begin: np.ndarray
    skipped: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


class Reader:
    """Pieces of whole texts with the windows of each and their anchors.

    A window's anchor is that run of half its words within it that has the least hash (of equal ones the last). Equal windows have equal anchors
    at places of their own, so an anchor occurs at least as often as each of its windows; neighbours mostly share one.
    """

    def __init__(self, words: int, *, piece: int = PIECE, slice_bytes: int = SLICE_BYTES):
        self.words, self.part, self.piece, self.slice_bytes = words, words // 2 + 1, piece, slice_bytes
        self.hashes = Hashes()

    def pieces(self, texts: pa.Array) -> Iterator[Piece]:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at = 0
        while at < len(texts):
            end = at + 1
            total = sizes[at]
            while end < len(texts) and total + sizes[end] <= self.slice_bytes:
                total += sizes[end]
                end += 1
            yield from self._slice(texts.slice(at, end - at), at)
            at = end

    def _slice(self, texts: pa.Array, first: int) -> Iterator[Piece]:
        found = split(texts, _SAME)
        lanes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in found.distinct.cast(pa.binary()).to_pylist()), np.uint64).reshape(-1, 2).T
        starts = found.starts
        counts = np.diff(starts)
        if starts[-1] <= self.piece or len(counts) > 1:
            if starts[-1] >= self.words:
                yield self._piece(lanes[:, found.ids], np.arange(len(counts)) + first, starts[:-1], counts, np.zeros(len(counts), np.int64))
            return
        for a in range(0, int(starts[-1]) - self.words + 1, self.piece):  # one long text: each window is in one piece
            own = found.ids[a : a + self.piece + self.words - 1]
            yield self._piece(lanes[:, own], np.array([first]), np.zeros(1, np.int64), np.array([len(own)]), np.array([a]))

    def _piece(self, lanes: np.ndarray, text: np.ndarray, begin: np.ndarray, counts: np.ndarray, skipped: np.ndarray) -> Piece:
        prefix = self.hashes.prefixes(lanes)
        n, width = lanes.shape[1], self.words - self.part + 1
        at = np.arange(n - self.part + 1)
        key = self.hashes.runs(prefix[0], 0, at, at + self.part)
        low = np.uint64((1 << 21) - 1)  # places are below that
        ranked = np.full(-(-len(at) // width) * width, np.uint64(2**64 - 1))
        ranked[: len(at)] = (key & ~low) | (low - at.astype(np.uint64))
        grid = ranked.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
        del at, ranked, grid  # long arrays make way for the next
        ends = np.repeat(begin + counts, counts)
        windows = np.flatnonzero(np.arange(n - self.words + 1) + self.words <= ends[: n - self.words + 1])
        anchor = (low - (np.minimum(behind[windows], ahead[windows + width - 1]) & low)).astype(np.int64)
        return Piece(prefix, text, begin, skipped, windows, anchor, key)


def cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of a sketch."""
    return [(mixed(keys ^ salt) & np.uint64(bits - 1)).astype(np.int64) for salt in _SALTS]


class Sketch:
    """A count-min sketch whose counters stop at 2: per row a bit for cells met once, and one for cells met again."""

    def __init__(self, bits: int):
        self.bits = bits
        self.planes = np.zeros((DEPTH, 2, bits // 8), np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for planes, places in zip(self.planes, cells(keys, self.bits), strict=True):
            places, times = np.unique(places, return_counts=True)
            byte, bit = places >> 3, np.left_shift(1, places & 7).astype(np.uint8)
            again = (times > 1) | (planes[0][byte] & bit > 0)
            np.bitwise_or.at(planes[1], byte[again], bit[again])
            np.bitwise_or.at(planes[0], byte, bit)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """Numbered slices that are not empty, packed."""
        size, pack = SLICE_BITS // 8, zstandard.ZstdCompressor(level=1)
        flat = self.planes.transpose(0, 2, 1).reshape(DEPTH, -1, min(size, self.bits // 8), 2)
        for row in range(DEPTH):
            for k in range(flat.shape[1]):
                if flat[row, k, :, 0].any():
                    yield row * flat.shape[1] + k, pack.compress(np.ascontiguousarray(flat[row, k].T).tobytes())


def unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(2, -1)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counters added, up to 2."""
    return np.stack((a[0] | b[0], a[1] | b[1] | (a[0] & b[0])))


def again_plane(texts: DataFrame, bits: int, words: int) -> np.ndarray:
    """The merged sketch's bits of cells met twice or more, a row each: ``DEPTH * bits / 8`` bytes, 128 MB at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sketch = Reader(words), Sketch(bits)
        for batch in batches:
            for p in reader.pieces(batch.column(0)):
                places = p.anchor[np.concatenate(([True], p.anchor[1:] != p.anchor[:-1]))] if len(p.anchor) else p.anchor
                sketch.add(p.key[places])
            pa.default_memory_pool().release_unused()
        for k, packed in sketch.slices():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "packed"])

    partial = texts.select("text").mapInArrow(count, "slice int, packed binary").rdd.map(lambda r: (r[0], bytes(r[1])))
    whole = partial.combineByKey(unpacked, lambda a, b: merged(a, unpacked(b)), merged).mapValues(lambda planes: planes[1].tobytes())
    size = min(SLICE_BITS, bits) // 8
    out = np.zeros((DEPTH * bits // 8 // size, size), np.uint8)
    for k, plane in whole.toLocalIterator():
        out[k] = np.frombuffer(plane, np.uint8)
    return out.reshape(DEPTH, -1)


RUNS = "text_a long, text_b int, lo long, n int, a long, b long, windows binary"


def candidate_runs(texts: DataFrame, bits: int, words: int) -> DataFrame:
    """Runs of neighbouring windows that the sketch takes for repeated, of (text_a, text_b, text). lo: first word; n: windows;
    a, b: hashes of all words of the run; windows: their hashes, null where the task has given an equal run before."""
    sent = texts.sparkSession.sparkContext.broadcast(again_plane(texts, bits, words))

    def found(reader: Reader, p: Piece, planes: np.ndarray, seen: set) -> list[np.ndarray | list]:
        """(text, lo, n, a, b, windows) of a piece's runs."""
        maybe = np.ones(len(p.windows), bool)
        for plane, at in zip(planes, cells(p.key[p.anchor], bits), strict=True):
            maybe &= plane[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        w = p.windows[maybe]
        if not len(w):
            return []
        own = np.searchsorted(p.begin, w, side="right") - 1
        new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1] + 1) | (own[1:] != own[:-1]))))
        first, last = w[new], w[np.concatenate((new[1:] - 1, [len(w) - 1]))]
        n, own = last - first + 1, own[new]
        a, b = (reader.hashes.runs(p.prefix[k], k, first, last + words).view(np.int64) for k in range(2))
        each = np.stack([reader.hashes.runs(p.prefix[k], k, w, w + words) for k in range(2)], axis=1)
        bodies = []
        for k, at, size in zip(zip(a.tolist(), b.tolist(), strict=True), new.tolist(), n.tolist(), strict=True):
            bodies.append(None if k in seen else each[at : at + size].tobytes())
            seen.add(k)
        return [p.text[own], first - p.begin[own] + p.skipped[own], n, a, b, bodies]

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, planes, seen = Reader(words), sent.value, set()
        for batch in batches:
            for p in reader.pieces(batch.column(2)):
                if not len(p.windows) or not (parts := found(reader, p, planes, seen)):
                    continue
                text, lo, n, a, b, bodies = parts
                at = pa.array(text)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int64()), pa.array(n.astype(np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["text_a", "text_b", "lo", "n", "a", "b", "windows"])
            if len(seen) > 50_000:
                seen.clear()
            pa.default_memory_pool().release_unused()

    return texts.select("text_a", "text_b", "text").mapInArrow(list_runs, RUNS)


def sketch_bits(texts: DataFrame) -> int:
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = MIN_BITS
    while bits < MAX_BITS and bits < 8 * size // BYTES_PER_ANCHOR:
        bits *= 2
    return bits


def repeated_windows(texts: DataFrame, scratch: Scratch, *, words: int, bits: int) -> DataFrame:
    """(text_a, text_b, spans): first and last start of runs of windows whose words also start elsewhere.

    Runs are grouped first: one that occurs again repeats as a whole, so copies cost one row each. The windows of each distinct run
    are grouped by their 128 bits; only runs that occur once need their counts.
    """
    runs = scratch.write(candidate_runs(texts, bits, words), "runs")
    some = F.first("windows", ignorenulls=True).alias("windows")
    kinds = runs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.first("text_a").alias("text_a"), F.first("text_b").alias("text_b"), F.first("lo").alias("lo"), F.max("n").alias("n"), some)
    kinds = scratch.write(kinds, "kinds")
    runs = scratch.write(runs.drop("windows"), "places")
    scratch.drop("runs")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for times, text_a, text_b, lo, body in zip(*[batch.column(k).to_pylist() for k in range(4)], batch.column(4), strict=True):
                each = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, 2)
                for at in range(0, len(each), 100_000):
                    part = each[at : at + 100_000]
                    start = np.arange(at, at + len(part)) + lo if times == 1 else np.full(len(part), -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), text_a)), pa.array(np.full(len(part), text_b, np.int32)), pa.array(start), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["text_a", "text_b", "lo", "g", "h"]
                    )

    each = kinds.select("times", "text_a", "text_b", "lo", "windows").mapInArrow(explode, "text_a long, text_b int, lo long, g long, h long")
    often = scratch.write(each.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "often")
    totals = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("windows"), F.coalesce(F.sum("times"), F.lit(0)).alias("runs")).first()
    single = join_hot(each.where("lo >= 0"), often, ["g", "h"], "n", totals["windows"]).select("text_a", "text_b", "lo", F.col("lo").alias("hi"))
    copied = join_hot(runs, kinds.where("times >= 2").select("a", "b", "times"), ["a", "b"], "times", totals["runs"])
    spans = single.unionByName(copied.select("text_a", "text_b", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")))
    return spans.groupBy("text_a", "text_b").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # copies of a text collapse before the shuffle


def kept_words(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """(words, words removed, the others joined by a space) without the words [lo, hi) of each span; spans ascend and are disjoint."""
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(starts)
    kept = [_GAP.sub(b" ", text[starts[a] : ends[b - 1]]) for a, b in zip([0, *hi.tolist()], [*lo.tolist(), n], strict=True) if a < b]
    return n, int((hi - lo).sum()), b" ".join(kept)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int | None = None) -> DataFrame:
    """Each whole text without the words in any window of ``words`` words that also starts anywhere else.

    Returns the key, n_words, n_removed and kept (the words left, joined by one space).

    Every partition counts windows' anchors in a sketch of fixed size; the merged sketch overestimates how often a window
    occurs, so those it takes for single are, and the others are grouped exactly. Beyond about a billion anchors (60 GB) the sketch fills up
    and lets more through; results stay the same.

    * Null texts have no words, as have texts of white space; texts below ``words`` words lose nothing.
    * Matches never cross documents, overlaps count, and windows are judged on the input.
    * Windows are told by 128 bits: two of 10**13 differing ones (about 70 TB) are taken for equal with odds of 10**-13. Whole texts are told
      by hashes of 64 and 32 bits (in 10**11 texts two meet with odds of 10**-7).
    * Rows that repeat a text or a key are documents of their own. Null keys stay as they are. Bytes that are not UTF-8 are parts of words.
    * Empty tables give empty results; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_a"), F.hash(text).alias("text_b"), F.col(text).cast("binary").alias("text"))
    spans = scratch.write(repeated_windows(texts, scratch, words=words, bits=bits or sketch_bits(texts)), "spans")
    for name in ("kinds", "places", "often"):
        scratch.drop(name)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in parts:
            counts, removed, kept = [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                lo, hi = none, none
                if s.is_valid:
                    lo, hi = union_spans(s.values.field(0).to_numpy(), s.values.field(1).to_numpy() + words)
                n, gone, left = kept_words(t.as_buffer().to_pybytes() if t.is_valid else b"", lo, hi)
                counts.append(n)
                removed.append(gone)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = texts.join(spans, ["text_a", "text_b"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def brute_force(texts: list[str | None], words: int = WORDS) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, what is left) by looking at every window; for tests."""
    split_ = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count: dict[tuple, int] = {}
    for w in split_:
        for k in range(len(w) - words + 1):
            count[tuple(w[k : k + words])] = count.get(tuple(w[k : k + words]), 0) + 1
    out = []
    for w in split_:
        gone = set()
        for k in range(len(w) - words + 1):
            if count[tuple(w[k : k + words])] > 1:
                gone.update(range(k, k + words))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out
