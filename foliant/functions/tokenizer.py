"""Byte-pair encoding over UTF-8 bytes, in Arrow batches with a memo a worker."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how text is cut before merging.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO = 100_000


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100."""
    own = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    spare = (chr(c) for c in range(256, 512))
    return {b: own.get(b) or next(spare) for b in range(256)}


ALPHABET = byte_alphabet()
BYTES = {c: b for b, c in ALPHABET.items()}


@dataclass
class BytePairTokenizer:
    vocabulary: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rank = {m: k for k, m in reversed(list(enumerate(self.merges)))}
        self.names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.specials.items()}
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.memo: dict[str, list[str]] = {}

    @classmethod
    def from_bundle(cls, tokenizer_json: dict | None = None, vocab: dict[str, int] | None = None, merges_text: str | None = None, config: dict | None = None) -> BytePairTokenizer:
        """From a tokenizer description, or from a vocabulary and a text of merges (comments and blank lines are skipped)."""
        added: dict[str, int] = {}
        if tokenizer_json and tokenizer_json.get("model", {}).get("vocab"):
            vocab, raw = tokenizer_json["model"]["vocab"], tokenizer_json["model"].get("merges", [])
            added = {t["content"]: t["id"] for t in tokenizer_json.get("added_tokens", []) if isinstance(t.get("id"), int)}
        elif vocab and merges_text:
            raw = [x.strip() for x in merges_text.split("\n") if x.strip() and not x.strip().startswith("#")]
        else:
            raise ValueError("neither a tokenizer description nor a vocabulary with merges")
        config = config or {}
        named = [config.get(k) for k in ("bos_token", "eos_token", "pad_token")] + list(config.get("additional_special_tokens", []))
        added |= {t: vocab[t] for t in named if t and t in vocab}
        return cls(vocab, [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in raw], added)

    @classmethod
    def from_files(cls, tokenizer_path: str) -> BytePairTokenizer:
        with open(tokenizer_path, encoding="utf-8") as f:
            return cls.from_bundle(json.load(f))

    @classmethod
    def demo(cls) -> BytePairTokenizer:
        """All bytes and merges of the most common English pairs; for tests and examples."""
        merges = [("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("a", "n"), ("Ġ", "the"), ("o", "n"), ("in", "g"), ("an", "d"), ("Ġ", "and")]
        names = [*ALPHABET.values(), *[a + b for a, b in merges]]
        return cls({t: k for k, t in enumerate(names)}, merges)

    def pieces(self, word: str) -> list[str]:
        """The byte characters of a word, merged by rank until no known pair is left."""
        if (known := self.memo.get(word)) is not None:
            return known
        parts = list(word)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            out: list[str] = []
            for p in parts:
                # A part joins the one before it only if that one has not been joined in this round.
                if out and out[-1] == best[0] and p == best[1]:
                    out[-1] = best[0] + best[1] + "\0"
                else:
                    out.append(p)
            parts = [p.rstrip("\0") for p in out]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[word] = parts
        return parts

    def _plain(self, text: str) -> list[int]:
        out = []
        for m in PIECES.finditer(text):
            for t in self.pieces("".join(ALPHABET[b] for b in m.group().encode("utf-8", "replace"))):
                if t not in self.vocabulary:
                    raise ValueError(f"unknown token {t!r}")
                out.append(self.vocabulary[t])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.splitter is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return bytes(BYTES[c] for i in ids for c in self.names.get(i, "") if c in BYTES).decode("utf-8", "replace")


def encode(tokenizer: BytePairTokenizer, text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(tokenizer.encode)

    return run(text)


def count_tokens(tokenizer: BytePairTokenizer, text: Column) -> Column:
    return F.size(encode(tokenizer, text))


def decode(tokenizer: BytePairTokenizer, ids: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: tokenizer.decode(list(x)) if x is not None else None)

    return run(ids)


def chat_prompt(messages: Column) -> Column:
    """Messages (role, content) as tagged text, for models without a template."""
    tagged = F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">\n"), m["content"], F.lit("\n</"), m["role"], F.lit(">")))
    return F.array_join(tagged, "\n")
