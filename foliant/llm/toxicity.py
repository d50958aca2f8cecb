"""Toxicity: a bidirectional gated recurrent network with attention over overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import gru
from foliant.llm.common import checkpoint
from foliant.llm.words import features, letters_only, split

WIDTH, STRIDE = 32, 24
WORD_BITS, GRAM_BITS, WORD_DIMS, GRAM_DIMS, HIDDEN = 15, 13, 8, 8, 8
#: Bounds of the training sample: documents of each class, and the characters of a clean and of a toxic one. A longer
#: text is drawn by a window at a place of its hash's choosing; toxic ones have more, as the label holds for some part only.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 1500, (8000, 64_000)
EPOCHS, BATCH_DOCS, RATE = 5, 32, 0.004
#: The share of words whose word vector is left out in training, so that the characters learn too.
WORD_DROP = 0.15
#: Words of texts that are scored at once; bounds the memory of a task.
CHUNK_WORDS = 150_000
THRESHOLD = 0.3


def held_out(doc_id):
    """Rows that never train: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


class Network:
    """Inputs: a hashed vector of the word and the mean of its hashed byte trigrams' vectors."""

    def __init__(self, seed: int = 0, params: dict[str, np.ndarray] | None = None):
        if params is not None:
            self.p = params
            return
        rng, d = np.random.default_rng(seed), WORD_DIMS + GRAM_DIMS
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": normal(1 << WORD_BITS, WORD_DIMS, scale=0.1), "gram": normal(1 << GRAM_BITS, GRAM_DIMS, scale=0.3)}
        for side in "fb":
            self.p |= {f"w{side}": normal(d, 3 * HIDDEN, scale=0.4), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{side}": np.zeros(HIDDEN, np.float32)}
        self.p |= {"att": normal(2 * HIDDEN, scale=0.3), "out": normal(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1.0, np.float32)}

    def inputs(self, feats: tuple, keep: np.ndarray | None = None) -> np.ndarray:
        """One row a distinct word, and a last row of zeros for padding."""
        bucket, gram, first = feats
        x = np.zeros((len(bucket) + 1, WORD_DIMS + GRAM_DIMS), np.float32)
        if len(bucket):
            count = np.diff(np.concatenate((first, [len(gram)]))).astype(np.float32)
            x[:-1, :WORD_DIMS] = self.p["word"][bucket]
            x[:-1, WORD_DIMS:] = np.add.reduceat(self.p["gram"][gram], first) / count[:, None]
            if keep is not None:
                x[:-1, :WORD_DIMS] *= keep[:, None]
        return x

    def logits(self, x: np.ndarray, at: np.ndarray, train: bool = False) -> tuple[np.ndarray, tuple]:
        """x: inputs of the distinct words; at: (windows, WIDTH) places in x, the last for padding."""
        idx = np.ascontiguousarray(at.T)
        real = (idx < len(x) - 1).astype(np.float32)
        zero = np.zeros((idx.shape[1], HIDDEN), np.float32)
        gates = {s: x @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb"}
        hs, kept = {}, {}
        for s, order in (("f", range(WIDTH)), ("b", range(WIDTH - 1, -1, -1))):
            h, out, saved = zero, np.empty((WIDTH, idx.shape[1], HIDDEN), np.float32), []
            for t in order:
                h, cache = gru.step(gates[s][idx[t]], h, self.p[f"u{s}"], self.p[f"c{s}"])
                out[t] = h
                if train:
                    saved.append(cache)
            hs[s], kept[s] = out, saved
        h = np.concatenate((hs["f"], hs["b"]), axis=2)
        a = np.exp(np.minimum(h @ self.p["att"], 30)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tb,tbk->bk", a, h)
        return pooled @ self.p["out"] + self.p["bias"][0], (x, idx, h, a, pooled, kept)

    def gradients(self, d: np.ndarray, cache: tuple, feats: tuple, keep: np.ndarray) -> dict[str, np.ndarray]:
        x, idx, h, a, pooled, kept = cache
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = d @ pooled, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.p["out"]
        d_a = np.einsum("bk,tbk->tb", d_pooled, h)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att"] = np.einsum("tb,tbk->k", d_e, h)
        d_h = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        d_x = np.zeros_like(x)
        for s, part in (("f", d_h[:, :, :HIDDEN]), ("b", d_h[::-1, :, HIDDEN:])):
            d_gates, g[f"u{s}"], g[f"c{s}"] = gru.backward(part, kept[s], self.p[f"u{s}"])
            flat, where = d_gates.reshape(-1, 3 * HIDDEN), (idx if s == "f" else idx[::-1]).ravel()
            per_word = np.stack([np.bincount(where, flat[:, k], len(x)) for k in range(3 * HIDDEN)], axis=1).astype(np.float32)
            g[f"w{s}"], g[f"b{s}"] = x.T @ per_word, per_word.sum(0)
            d_x += per_word @ self.p[f"w{s}"].T
        bucket, gram, first = feats
        if len(bucket):
            count = np.diff(np.concatenate((first, [len(gram)])))
            np.add.at(g["word"], bucket, d_x[:-1, :WORD_DIMS] * keep[:, None])
            np.add.at(g["gram"], gram, np.repeat(d_x[:-1, WORD_DIMS:] / count[:, None], count, axis=0))
        return g


def window_places(starts: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """((windows, WIDTH) places of words, the text of each window); a text has at least one window."""
    lengths = np.diff(starts)
    count = np.maximum(1, -(-(lengths - (WIDTH - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = (starts[:-1][owner] + nth * STRIDE)[:, None] + np.arange(WIDTH)
    inside = at < starts[1:][owner][:, None]
    padded = np.append(ids, pad)
    return padded[np.where(inside, at, len(ids))], owner


def train(texts: list[str], toxic: np.ndarray, *, seed: int = 0, epochs: int = EPOCHS) -> Network:
    """Fit on whole texts whose label holds for at least one window: the windows share in it by their odds."""
    net, rng = Network(seed), np.random.default_rng(seed)
    order_of_toxic = np.asarray(toxic, np.float32)
    opt = gru.Adam(net.p, RATE)
    for epoch in range(epochs):
        opt.rate = RATE * (1 - 0.8 * epoch / max(1, epochs - 1))
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH_DOCS):
            part = order[b : b + BATCH_DOCS]
            words = split(pa.array([texts[k] for k in part], pa.string()), letters_only())
            feats = features(words.distinct, WORD_BITS, GRAM_BITS)
            keep = (rng.random(len(words.distinct)) >= WORD_DROP).astype(np.float32)
            at, owner = window_places(words.starts, words.ids, len(words.distinct))
            z, cache = net.logits(net.inputs(feats, keep), at, train=True)
            # A document's logit is a soft maximum of its windows'; it sharpens as training goes on.
            sharp = 1.0 + 2.0 * epoch / max(1, epochs - 1)
            top = np.full(len(part), -np.inf)
            np.maximum.at(top, owner, z)
            e = np.exp(sharp * (z - top[owner]))
            total = np.bincount(owner, e, len(part))
            logit = top + np.log(total / np.bincount(owner, minlength=len(part))) / sharp
            d_doc = (1 / (1 + np.exp(-logit)) - order_of_toxic[part]) / len(part)
            opt.update(net.gradients((d_doc[owner] * e / total[owner]).astype(np.float32), cache, feats, keep))
    return net


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """The highest window probability of each text; a text without words is one window of padding."""
    words = split(texts, letters_only())
    x = net.inputs(features(words.distinct, WORD_BITS, GRAM_BITS))
    out = np.full(len(texts), -np.inf, np.float32)
    first = 0
    while first < len(texts):  # whole texts until the chunk is full; a longer text is scored by groups of windows
        last = max(first + 1, int(np.searchsorted(words.starts, words.starts[first] + CHUNK_WORDS, side="right")) - 1)
        at, owner = window_places(words.starts[first : last + 1], words.ids, len(x) - 1)
        for w in range(0, len(at), CHUNK_WORDS // WIDTH):
            z, _ = net.logits(x, at[w : w + CHUNK_WORDS // WIDTH])
            np.maximum.at(out, owner[w : w + CHUNK_WORDS // WIDTH] + first, z)
        first = last
    return 1 / (1 + np.exp(-out.astype(np.float64)))


def sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS, max_chars: tuple[int, int] = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic): a bounded, hash-ordered draw of labelled rows that may train."""
    own = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = own.where("toxic = 1").orderBy(F.xxhash64("label_id"), "label_id").limit(2 * per_class).unionByName(own.where("toxic = 0").orderBy(F.xxhash64("label_id"), "label_id").limit(2 * per_class))
    rows = docs.select(F.col(key).cast("long").alias("label_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    met = rows.join(F.broadcast(drawn), "label_id")  # at most 4 * per_class ids are sent out
    most = F.when(F.col("toxic") == 1, max_chars[1]).otherwise(max_chars[0])
    start = F.pmod(F.xxhash64("label_id", F.length("text")), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int")
    met = met.select("label_id", F.when(F.length("text") > most, F.substring("text", start + 1, most)).otherwise(F.col("text")).alias("text"), "toxic")
    return met.where("toxic = 1").orderBy("label_id", "text").limit(per_class).unionByName(met.where("toxic = 0").orderBy("label_id", "text").limit(per_class))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS, seed: int = 0) -> Network:
    """Train on a balanced sample, then set the odds to those of all labels that may train."""
    rows = sorted(checkpoint(sample(docs, labels, key=key, text=text, per_class=per_class)).collect(), key=lambda r: (r["label_id"], r["text"], r["toxic"]))
    toxic = np.array([r["toxic"] for r in rows], np.float32)
    net = train([r["text"] for r in rows], toxic, seed=seed)
    may = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    ones, zeros = may.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    if ones and zeros and 0 < toxic.sum() < len(toxic):
        net.p["bias"] = net.p["bias"] + np.float32(np.log(ones / zeros) - np.log(toxic.sum() / (len(toxic) - toxic.sum())))
    return net


def score(docs: DataFrame, net: Network, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): narrow, whole texts, one Arrow batch in memory at a time.

    Null, empty and blank texts get the score of a window of padding. Repeated rows score alike;
    an empty table gives an empty result.
    """
    params = net.p  # about a megabyte, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(params=params)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(model, part.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Train on labelled rows that may train, score every whole text.

    Returns ``doc_id``, held_out, score and predicted (1 from ``threshold``).

    * Labels or keys that are null train nothing; a key with several labels is toxic if one says so. Without any
      label all scores are those of the untrained network.
    * Null, empty and blank texts score as a window of padding. Rows that repeat a key or text score alike.
    * Empty documents give an empty result; other columns of both tables are ignored, whatever their names.
    """
    scored = score(docs, fit(docs, labels, key=key, text=text), key=key, text=text)
    return scored.select(F.col("doc_id").alias(key), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, unchanged and in place: texts pass through the scorer once.

    Null and empty texts are judged by the score of padding, repeated rows alike, and all columns stay, whatever their
    names. An empty table gives an empty result.
    """
    net = fit(docs, labels, key=key, text=text)
    params, at, schema = net.p, docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(params=params)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield part.filter(pa.array(scores(model, part.column(at)) < threshold))

    return docs.mapInArrow(run, schema)
