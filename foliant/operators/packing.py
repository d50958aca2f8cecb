"""Plain texts to embedded chunks and group vectors in one Arrow pass: no row is moved, no array is walked by lambdas.

The rows are those of ``layout.chunks`` over ``layout.text_pages``, of ``embedding.embed`` and of ``profile.meta_groups``; the tests compare them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import batched, groupby
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from foliant import schemas
from foliant.functions import hashing
from foliant.functions.quality import CHUNK_VERBS
from foliant.operators.embedding import _fnv, slots_of
from foliant.operators.layout import FALLBACK_BOX, FALLBACK_TEXT
from foliant.operators.profile import MAX_GROUPS

#: Documents that are read at a time, and chunks that are embedded at a time (more if one document has more).
DOCS_AT_A_TIME, CHUNKS_AT_A_TIME = 64, 1024
#: Bytes of texts whose tokens are summed at a time; a longer text is read word by word.
BYTES_AT_A_TIME = 1 << 18
#: ``text.WS``, spelled out. None of these but the space is printable.
WS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_SPACES = re.compile(f"[{WS}]+")
_SIGNS = re.compile(r"[=+\-×÷<>≤≥≈∑∏∫√]")
_ENDS = re.compile("[.!?]")
_ASCII_WORD = re.compile("[a-z0-9_]+")
_DEFINES = re.compile(r"\b(?:is defined as|refers to|we define)\b|\bis an? (?=\w)", re.ASCII | re.IGNORECASE)
_VERBS = frozenset(CHUNK_VERBS)


class Chunk(NamedTuple):
    doc_id: int
    page_number: int
    chunk_ord: int
    text: str
    box: tuple[float, float, float, float]
    line_count: int


def chunks_of_text(doc_id, text: str | None) -> Iterator[Chunk]:
    """Pages of 40 lines; lines go on in a chunk up to a gap or to its most characters; a page without lines gives one fallback chunk."""
    lines = (text or "").split("\n")
    n = schemas.PAGE_LINES
    for page, at in enumerate(range(0, len(lines), n), 1):
        number, own, chars, first, last = 0, [], 0, 0.0, 0.0
        for i, line in enumerate(lines[at : at + n]):
            if "  " in line or not line.isprintable():
                line = _SPACES.sub(" ", line)
            if not (line := line.strip(" ")):
                continue
            y, size = i / n, len(line)
            if own and (abs(y - last) > schemas.CHUNK_GAP or chars + 1 + size > schemas.CHUNK_CHARS):
                yield _chunk(doc_id, page, number, own, first, last)
                number, own = number + 1, []
            chars = chars + 1 + size if own else size
            first = first if own else y
            last = y
            own.append(line)
        if own:
            yield _chunk(doc_id, page, number, own, first, last)
        else:
            yield Chunk(doc_id, page, 0, FALLBACK_TEXT, FALLBACK_BOX, 0)


def _chunk(doc_id, page: int, number: int, lines: list[str], first: float, last: float) -> Chunk:
    right = 0.08 + min(0.84, max(map(len, lines)) / 100)
    return Chunk(doc_id, page, number, "\n".join(lines), (0.08, first, right - 0.08, last + 0.015 - first), len(lines))


def readability(chunk: Chunk) -> float:
    """``quality.chunk_readability`` of a chunk, whose lines have single spaces only."""
    s = chunk.text.replace("\n", " ")
    words = s.split(" ")
    if len(s) < 40 or sum(w.isascii() and w.isalnum() for w in words if len(w) == 1) / len(words) > 0.28 or len(_SIGNS.findall(s)) / len(s) > 0.04:
        return 0.0
    low = s.lower()
    defines = ("is a" in low or "is defined as" in low or "refers to" in low or "we define" in low) and _DEFINES.search(s)
    verbs = not _VERBS.isdisjoint(_ASCII_WORD.findall(low))
    return min(len(words) / 20, 1.0) + (0.3 if verbs else 0.0) + (0.2 if _ENDS.search(s) else 0.0) + (0.5 if defines else 0.0)


#: What a token can have, and each byte's place in it from 1; other bytes have 0.
_SIGNS_OF_TOKENS = b"abcdefghijklmnopqrstuvwxyz0123456789_/.:-"
_PLACE = np.zeros(256, np.uint8)
_PLACE[list(_SIGNS_OF_TOKENS)] = np.arange(1, len(_SIGNS_OF_TOKENS) + 1)
#: A token of more bytes is hashed by itself.
_LONG = 64


def _hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a of parts of at most ``_LONG`` bytes, longest first: a byte of all of them at a time."""
    h = np.full(len(starts), hashing.FNV_SEED, np.uint32)
    upto = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for j, m in enumerate(upto):
        h[:m] = (h[:m] ^ flat[starts[:m] + j]) * np.uint32(hashing.FNV_PRIME)
    return h


@cache
def _trigrams() -> tuple[np.ndarray, np.ndarray]:
    """Bucket and weight of each trigram, by the places of its bytes."""
    signs = np.frombuffer(b"\0" + _SIGNS_OF_TOKENS, np.uint8)
    n = len(signs)
    flat = np.stack(np.meshgrid(signs, signs, signs, indexing="ij"), axis=-1).reshape(-1)
    h = _hashes(flat, np.arange(n**3) * 3, np.full(n**3, 3))
    return (h % schemas.TEXT_DIMS).astype(np.int64), np.where((flat.reshape(-1, 3) & 1).sum(axis=1) & 1, 13.0, -13.0)


def _token_sums(lows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For lower-cased texts the sums of their tokens' weights by bucket, in twentieths, and their numbers of tokens; all texts at once, byte by byte.

    A run of bytes that a token can have holds one word at most: from its first letter or digit to its end.
    """
    n, t = len(lows), schemas.TEXT_DIMS
    flat = np.frombuffer(b"\n".join([*lows, b""]), np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) + 1 for x in lows])
    place = _PLACE[flat]
    turns = np.flatnonzero(np.diff(place > 0, prepend=False))  # the last byte is none of a token
    run_starts, ends = turns[::2], turns[1::2]
    letters = np.flatnonzero((place > 0) & (place <= 36))
    starts = np.append(letters, len(flat))[np.searchsorted(letters, run_starts)]
    words = ends - starts >= 2
    starts, ends = starts[words], ends[words]
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, ends, sizes = starts[order], ends[order], sizes[order]
    long = np.searchsorted(-sizes, -_LONG)
    h = np.concatenate((np.array([_fnv(flat[a:z].tobytes().decode()) for a, z in zip(starts[:long], ends[:long], strict=True)], np.uint32), _hashes(flat, starts[long:], sizes[long:])))
    odd = np.bitwise_xor.accumulate(flat & 1)
    weight = np.where(sizes > 5, 28.0, np.where(sizes > 3, 20.0, 13.0)) * np.where(odd[ends - 1] ^ odd[starts] ^ (flat[starts] & 1), 1, -1)
    edges = np.zeros(len(flat), np.bool_)
    three = sizes > 2
    edges[starts[three]] = edges[ends[three] - 2] = True  # two words lie a byte apart at least
    grams = np.flatnonzero(np.bitwise_xor.accumulate(edges))
    bucket_of, weight_of = _trigrams()
    m = len(_SIGNS_OF_TOKENS) + 1
    wide = place.astype(np.int32)
    code = ((wide[:-2] * m + wide[1:-1]) * m + wide[2:])[grams]
    of_word, of_gram = row[starts], row[grams]
    sums = np.bincount(of_word * np.int64(t) + h % np.uint32(t), weight, n * t) + np.bincount(of_gram * np.int64(t) + bucket_of[code], weight_of[code], n * t)
    return sums.reshape(n, t), np.bincount(of_word, minlength=n) + np.bincount(of_gram, minlength=n)


def token_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_token_sums`` of texts as they are, some at a time. Lower-casing can differ from Spark's beyond ASCII only, where no token is."""
    n, t = len(texts), schemas.TEXT_DIMS
    sums, tokens = np.empty((n, t)), np.empty(n)
    lows = [x.lower().encode() for x in texts]
    a = 0
    while a < n:
        if len(lows[a]) > BYTES_AT_A_TIME:
            at = slots_of(lows[a].decode())
            sums[a], tokens[a] = np.bincount(at[:, 0], at[:, 1], t), len(at)
            a += 1
            continue
        z, size = a, 0
        while z < n and (size := size + len(lows[z])) <= BYTES_AT_A_TIME:
            z += 1
        sums[a:z], tokens[a:z] = _token_sums(lows[a:z])
        a = z
    return sums, tokens


def _counts(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits and capitals of each text."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    out = []
    for low, n in ((48, 10), (65, 26)):
        upto = np.concatenate(([0], np.cumsum(flat - np.uint8(low) < n, dtype=np.int64)))
        out.append(np.diff(upto[ends]))
    return out[0], out[1]


def unit_vectors(chunks: list[Chunk]) -> np.ndarray:
    """The vectors of ``embedding.embed``, without page counts."""
    n, t = len(chunks), schemas.TEXT_DIMS
    raw = np.zeros((n, schemas.EMBEDDING_DIMS))
    raw[:, :t], tokens = token_sums([c.text for c in chunks])
    raw[:, :t] /= 20.0
    size, lines = np.array([len(c.text) for c in chunks], float), np.array([c.line_count for c in chunks])
    digits, capitals = _counts([c.text.encode() for c in chunks])
    share = np.maximum(size, 1)
    raw[:, t : t + 4] = [c.box for c in chunks]
    features = [np.minimum(size / 700, 1.0), digits / share, capitals / share, np.minimum(np.maximum(lines, 1) / 18, 1.0), np.minimum(lines / 32, 1.0), (lines == 0) * 1.0]
    features += [np.array([value if word in c.text else 0.0 for c in chunks]) for word, value in (("table", 0.7), ("figure", 0.6), ("%", 0.3), ("$", 0.3))]
    raw[:, t + 5 :] = np.stack([*features, np.minimum(tokens / 64, 1.0)], axis=1)
    norm = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])  # added from the first to the last
    return np.divide(raw, norm, out=raw, where=norm != 0).astype(np.float32)


def signatures(vectors: np.ndarray) -> np.ndarray:
    """(rows, words) of sign bits, lowest bit first; 0 counts as positive."""
    return np.packbits(vectors >= 0, axis=1, bitorder="little").view("<u4").astype(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    for batch in batches:
        for a in range(0, batch.num_rows, DOCS_AT_A_TIME):
            part = batch.slice(a, DOCS_AT_A_TIME)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)


def embedded_chunks(docs: DataFrame, *, vectors: bool = True) -> DataFrame:
    """(doc_id, page_number, chunk_ord, id, text, signature and, unless left out, vector) of (doc_id, text). Rows without a doc_id are left out."""
    key = docs.schema["doc_id"].dataType
    kind = to_arrow_type(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (c for doc_id, text in _documents(batches) for c in chunks_of_text(doc_id, text))
        for part in batched(found, CHUNKS_AT_A_TIME):
            v = unit_vectors(part)
            columns = {
                "doc_id": pa.array([c.doc_id for c in part], kind), "page_number": pa.array([c.page_number for c in part], pa.int32()), "chunk_ord": pa.array([c.chunk_ord for c in part], pa.int32()),
                "id": pa.array([f"p{c.page_number}-c{c.chunk_ord + 1}" for c in part]), "text": pa.array([c.text for c in part], pa.string()), "signature": _lists(signatures(v)),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"vector": _lists(v)} if vectors else {}))

    schema = f"doc_id {key.simpleString()}, page_number int, chunk_ord int, id string, text string, signature array<bigint>" + (", vector array<float>" if vectors else "")
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def grouped(chunks: list[Chunk], most: int = MAX_GROUPS) -> Iterator[tuple[Chunk, int, float]]:
    """(chunk, group, readability) of one document's chunks, without those that ``profile.meta_groups`` leaves out."""
    scored = [(c, readability(c)) for c in chunks]
    enough = sum(r > 0 for _, r in scored) >= min(4, ceil(len(scored) * 0.2))
    pool = [(c, r) for c, r in scored if r > 0 or not enough]
    size = 1 if len(pool) <= most else ceil(len(pool) / most)
    for k, (c, r) in enumerate(pool):
        yield c, k // size, r


def group_components(docs: DataFrame, digits: int = 6) -> DataFrame:
    """(doc_id, group_ord, pos, v): the components, rounded, but for zeros, of the vectors of ``profile.meta_embeddings``. ``docs``: doc_id, text.

    A document's chunks are scored, grouped, embedded and averaged where its text is. Rows that repeat a doc_id count as one document if
    they lie in one partition and are sorted by it; rows without one are left out.
    """
    key = docs.schema["doc_id"].dataType
    kind, scale = to_arrow_type(key), 10.0**digits

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Chunk, int, float]]]:
        for doc_id, rows in groupby(_documents(batches), key=lambda d: d[0]):
            chunks = [c for _, text in rows for c in chunks_of_text(doc_id, text)]
            yield list(grouped(sorted(chunks, key=lambda c: (c.page_number, c.chunk_ord))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[Chunk, int, float]]]:
        """Whole documents, with so many chunks or a document's."""
        own: list = []
        for rows in documents(batches):
            own += rows
            if len(own) >= CHUNKS_AT_A_TIME:
                yield own
                own = []
        if own:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in some(batches):
            starts = [k for k, (c, g, _) in enumerate(part) if not k or (c.doc_id, g) != (part[k - 1][0].doc_id, part[k - 1][1])]
            w = np.maximum([r for _, _, r in part], 0.05)
            v = unit_vectors([c for c, _, _ in part]) * w[:, None]
            mean = np.add.reduceat(v, starts, axis=0) / np.add.reduceat(w, starts)[:, None]
            norm = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
            unit = np.divide(mean, norm, out=mean, where=norm != 0) * scale
            unit = np.copysign(np.floor(np.abs(unit) + 0.5), unit) / scale
            at, pos = np.nonzero(unit)
            ids, groups = pa.array([part[k][0].doc_id for k in starts], kind), np.array([part[k][1] for k in starts], np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(at)), "group_ord": pa.array(groups[at]), "pos": pa.array(pos.astype(np.int32)), "v": pa.array(unit[at, pos])})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {key.simpleString()}, group_ord int, pos int, v double")
