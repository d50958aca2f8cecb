"""Secret scan: three exact patterns and dictionary-primed zstandard novelty."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

#: Strings that may hide a secret, and words that make the text before them a sensitive context.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|key|cred|auth|bearer|private|signature|session", re.I | re.A)
CONTEXT_BEFORE, CONTEXT_AROUND, LEAST_NOVELTY = 40, 256, 0.75

#: What identifiers and configuration are made of; names like these compress well and are no secrets.
IDENTIFIERS = " ".join(
    f"{a}{s}{b}"
    for s in ("_", "-", "", "/", ".")
    for a in ("access", "account", "api", "auth", "client", "config", "database", "default", "private", "public", "refresh", "secret", "service", "session", "user")
    for b in ("credential", "endpoint", "environment", "identifier", "key", "manager", "name", "password", "provider", "request", "response", "string", "token", "value", "version")
).encode()

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_novel", T.LongType())]
)


class Novelty:
    """Compressed bytes that a candidate adds to its surroundings, per byte of the candidate."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        around = text[max(0, start - CONTEXT_AROUND) : start] + "\n" + text[end : end + CONTEXT_AROUND]
        near, what = around.encode("utf-8", "replace"), text[start:end].encode()
        return (len(self.compressor.compress(near + what)) - len(self.compressor.compress(near))) / len(what)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds, sorted."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Strings of letters and digits in a sensitive context that neither dictionary explains."""
    found, taken, at = [], [(s, e) for s, _, e in base], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        what = m.group()
        if what.isdigit() or not (any(c.isdigit() for c in what) or (what != what.lower() and what != what.upper())):
            continue  # words of one case and plain numbers
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(a < e and s < b for a, b in taken[max(0, at - 2) : at + 3]) or not SENSITIVE.search(text, max(0, s - CONTEXT_BEFORE), s):
            continue
        if novelty(text, s, e) >= LEAST_NOVELTY:
            found.append((s, 3, e))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans that look like secrets in each whole text, one row a document.

    Returns ``doc_id``, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points,
    end exclusive, by start, then kind) and n_novel.

    * Bytes that are not UTF-8 count as replacement characters, as a decoder puts them.
    * A null text counts as empty; empty texts have no spans and the digest of the empty string.
    * Each row is scanned by itself: repeated rows give repeated results, an empty table none, and
      other columns are ignored. Nothing is shuffled; memory is bounded by one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = (t.as_py() or b"").decode("utf-8", "replace")
                base = base_spans(t)
                more = novel_spans(t, base, novelty)
                count = [sum(1 for x in base if x[1] == k) for k in range(3)]
                rows.append((i, *count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=SCHEMA.names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
