"""Words of whole Arrow batches as numpy arrays, and hashed features of distinct words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20_240_601)
#: Random numbers by place and byte; a word's hash is the sum of its bytes' numbers.
PLACES = 64
ZOBRIST = _RNG.integers(0, 2**63, (PLACES, 256), dtype=np.uint64)
TRIGRAM = _RNG.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)


@dataclass
class Words:
    """ids: the place in ``distinct`` of each word in turn; starts: the first word of each text, and the end."""

    ids: np.ndarray
    starts: np.ndarray
    distinct: pa.Array


def split(texts: pa.Array, table: np.ndarray) -> Words:
    """Map every byte through ``table``, then split at ASCII white space. Nulls have no words."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[raw])]))
    flat = parts.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    at = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int32)))
    starts = at[parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts.offsets) else 0)].astype(np.int64)
    flat = flat.filter(full)
    del parts, full, at  # all words are held twice at most
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), starts, coded.dictionary)


#: Words of more bytes are named by a digest; see ``short``.
MAX_WORD_BYTES = 64


def short(distinct: pa.Array) -> pa.Array:
    """Words as binaries of bounded length: one of more than MAX_WORD_BYTES becomes a space, which no word holds, and its 128-bit digest."""
    distinct = distinct.cast(pa.binary())
    long = pc.greater(pc.binary_length(distinct), MAX_WORD_BYTES)
    if not len(distinct) or not pc.any(long).as_py():
        return distinct
    return pa.array([b" " + hashlib.blake2b(w, digest_size=16).digest() if len(w) > MAX_WORD_BYTES else w for w in distinct.to_pylist()], pa.binary())


def slices(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of at most ``rows`` texts and ``size`` bytes; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end - at
        at = end


def identity_lower() -> np.ndarray:
    """A-Z to a-z; all else stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letters_only() -> np.ndarray:
    """Like ``identity_lower``, but ASCII signs become spaces."""
    table = identity_lower()
    for b in range(128):
        if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122):
            table[b] = 32
    return table


def features(distinct: pa.Array, word_bits: int, gram_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all its byte trigrams, first trigram of each word).

    A word is padded with one boundary byte at either end, so each has at least one trigram.
    """
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = distinct.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32, n + 1, raw.offset * 4).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    hashed = np.add.reduceat(ZOBRIST[np.minimum(place, PLACES - 1), data], offsets[:-1])
    bucket = (hashed >> np.uint64(63 - word_bits)).astype(np.int64) & ((1 << word_bits) - 1)
    padded = np.zeros(len(data) + 2 * n, np.uint64)
    own = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    padded[own] = data
    firsts = offsets[:-1] + 2 * np.arange(n)
    grams = padded[:-2] * TRIGRAM[0] + padded[1:-1] * TRIGRAM[1] + padded[2:] * TRIGRAM[2]
    inside = np.ones(len(grams), bool)
    ends = np.concatenate((firsts[1:], [len(padded)]))
    inside[ends[:-1] - 1] = inside[ends[:-1] - 2] = False  # trigrams that reach into the next word
    counts = np.diff(offsets)
    gram = ((grams[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - gram_bits)).astype(np.int64)
    return bucket, gram, np.concatenate(([0], np.cumsum(counts)[:-1]))
