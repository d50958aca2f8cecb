"""Language-model scores: corpus-wide word counts and a gated recurrent network with class-factored output."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import gru
from foliant.llm.common import Scratch
from foliant.llm.words import identity_lower, short, slices, split

#: The network's words; all others share one class. Words whose counts go to all tasks (bounded, a few megabytes).
VOCABULARY, FREQUENT = 2047, 131_072
DIMS, HIDDEN, CLASSES = 16, 16, 16
STREAMS, STEPS, EPOCHS, RATE = 64, 20, 2, 0.01
#: The pass over all training rows: rounds, buckets wanted in each, words of a bucket (least, most), streams and steps.
ROUNDS, BUCKETS, BUCKET_WORDS, WIDE_STREAMS, WIDE_STEPS = 3, 240, (500_000, 4_000_000), 512, 10
#: Texts and bytes of texts that run side by side, and states that wait for the output layer at most (window of carried state).
SLICE_DOCS, SLICE_BYTES, PENDING = 5000, 8 << 20, 150_000
END = b""


def held_out(doc_id):
    """Rows that never train: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n) over all given documents; the end of a text counts as the empty word. Long words are named as ``short`` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = identity_lower()
        for batch in batches:
            for at, rows in slices(batch.column(0), SLICE_DOCS, SLICE_BYTES):
                part = batch.slice(at, rows)
                words = split(part.column(0), table)
                counts = np.bincount(words.ids, minlength=len(words.distinct))
                names = pa.concat_arrays([short(words.distinct), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(counts, part.num_rows), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Word vectors, a gated recurrent unit, classes, and words within their class.

    Words are numbered class by class; 0 is the class of all words outside the vocabulary. The first
    state is zero; the state after each word predicts the next, and after the last the end.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, seed: int = 0):
        """words by falling count, END among them; counts[0] is for all other words together."""
        mass = np.sqrt(np.maximum(counts[1:], 1).astype(np.float64))
        cls = np.minimum((np.cumsum(mass) - mass) / mass.sum() * CLASSES, CLASSES - 1).astype(int) if len(words) else np.zeros(0, int)
        cls = np.unique(cls, return_inverse=True)[1] + 1
        self.words, self.cls = words, np.concatenate(([0], cls)).astype(np.int16)  # short integers are sorted by digits
        self.first = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        self.ids = {w: k + 1 for k, w in enumerate(words)}
        rng, v, c = np.random.default_rng(seed), len(words) + 1, self.cls[-1] + 1
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        log = np.log(np.maximum(counts, 0.5) / max(counts.sum(), 1)).astype(np.float32)
        class_log = np.log(np.maximum(np.bincount(self.cls, counts, c), 0.5) / max(counts.sum(), 1)).astype(np.float32)
        self.p = {
            "emb": normal(v, DIMS, scale=0.3), "w": normal(DIMS, 3 * HIDDEN, scale=0.3), "b": np.zeros(3 * HIDDEN, np.float32),
            "u": normal(HIDDEN, 3 * HIDDEN, scale=0.3), "c": np.zeros(HIDDEN, np.float32),
            "class_w": normal(c, HIDDEN, scale=0.1), "class_b": class_log, "word_w": normal(v, HIDDEN, scale=0.1), "word_b": log,
        }

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(id | h) = ln P(class | h) + ln P(word | class, h); with grads also the gradient of the mean loss by h."""
        p, rows, cls = self.p, np.arange(len(ids)), self.cls[ids]
        a = p["class_w"] @ h.T + p["class_b"][:, None]  # a column a word: maxima and sums run over whole rows
        a -= a.max(0)
        out = a[cls, rows]
        e = np.exp(a, out=a)
        total = e.sum(0)
        out = out - np.log(total)
        scale, d_h = np.float32(1 / max(1, len(ids))), None
        if grads is not None:
            d = np.multiply(e, scale / total, out=e)
            d[cls, rows] -= scale
            grads["class_w"] += d @ h
            grads["class_b"] += d.sum(1)
            d_h = d.T @ p["class_w"]
        order = np.argsort(cls, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(self.first) - 1))))
        for k in range(len(self.first) - 1):
            own, (a0, a1) = order[edges[k] : edges[k + 1]], self.first[k : k + 2]
            if a1 - a0 < 2 or not len(own):
                continue
            x, t, r = h[own], ids[own] - a0, np.arange(len(own))
            s = p["word_w"][a0:a1] @ x.T + p["word_b"][a0:a1, None]
            s -= s.max(0)
            own_s = s[t, r]
            es = np.exp(s, out=s)
            st = es.sum(0)
            out[own] += own_s - np.log(st)
            if grads is not None:
                d = np.multiply(es, scale / st, out=es)
                d[t, r] -= scale
                grads["word_w"][a0:a1] += d @ x
                grads["word_b"][a0:a1] += d.sum(1)
                d_h[own] += d.T @ p["word_w"][a0:a1]
        return out, d_h

    def gates(self) -> np.ndarray:
        return self.p["emb"] @ self.p["w"] + self.p["b"]

    def fit(self, texts: list[np.ndarray], epochs: int = EPOCHS, seed: int = 0, streams: int = STREAMS, steps: int = STEPS, rates: tuple[float, float] = (RATE, 0.1 * RATE)) -> float:
        """Truncated backpropagation over parallel streams of whole texts; returns the last mean loss.

        Every word trains once an epoch; those that do not fill all streams are a stream of their own.
        """
        rng, opt, loss = np.random.default_rng(seed), gru.Adam(self.p, rates[0]), 0.0
        end = self.ids.get(END, 0)
        for epoch in range(epochs):
            line = np.concatenate([np.append(texts[k], end) for k in rng.permutation(len(texts))]) if texts else np.zeros(0, int)
            wide = max(1, min(streams, len(line) // 2))
            full = len(line) // wide * wide
            losses, sizes = [], []
            for part, width in ((line[:full], wide), (line[full:], 1)):
                grid = part.reshape(width, -1).T
                h, before = np.zeros((width, HIDDEN), np.float32), np.full(width, end)
                for t in range(0, len(grid), steps):
                    opt.rate = rates[0] + (rates[1] - rates[0]) * (epoch + (t / len(grid) if width == wide else 1)) / epochs
                    want = grid[t : t + steps]
                    g, lp, h = self._gradients(want, before, h, end)
                    losses.append(-lp.mean())
                    sizes.append(want.size)
                    opt.update(g)
                    before = want[-1]
            loss = float(np.average(losses, weights=sizes)) if losses else loss
        return loss

    def _gradients(self, want: np.ndarray, before: np.ndarray, h: np.ndarray, end: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean loss over ``want`` (time, stream), its ln P, and the last states."""
        n = want.shape[1]
        read = np.concatenate((before[None], want[:-1]))
        table = self.gates()
        states, kept, start = np.empty((len(want), n, HIDDEN), np.float32), [], []
        for k in range(len(want)):
            fresh = read[k] == end
            h_new, cache = gru.step(table[read[k]], h, self.p["u"], self.p["c"])
            h = np.where(fresh[:, None], np.float32(0), h_new)  # a text starts from the zero state
            states[k] = h
            kept.append(cache)
            start.append(fresh)
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        lp, d_h = self.log_probs(states.reshape(-1, HIDDEN), want.ravel(), g)
        d_states, carry = d_h.reshape(states.shape), np.zeros((n, HIDDEN), np.float32)
        d_gates = np.empty((len(want), n, table.shape[1]), np.float32)
        for k in range(len(want) - 1, -1, -1):
            d = np.where(start[k][:, None], np.float32(0), d_states[k] + carry)
            d_gates[k], d_u, d_c, carry = _back(d, kept[k], self.p["u"])
            g["u"] += d_u
            g["c"] += d_c
        word = read.ravel().astype(np.uint16 if len(table) <= 65_536 else np.int64)
        order = np.argsort(word, kind="stable")  # sums by word: equal words side by side
        word = word[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        d_table = np.zeros_like(table)
        d_table[word[first]] = np.add.reduceat(d_gates.reshape(-1, table.shape[1])[order], first)
        g["emb"], g["w"], g["b"] = d_table @ self.p["w"].T, self.p["emb"].T @ d_table, d_table.sum(0)
        return g, lp, h

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, v in self.p.items():
            self.p[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """ln P of each whole text; its state is carried from its first word to its end, however long it is."""
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        begin, length = starts[:-1][order], lengths[order]
        h, out, table = np.zeros((len(order), HIDDEN), np.float32), np.zeros(len(order)), self.gates()
        end, waiting, size = self.ids.get(END, 0), [], 0
        padded = np.append(ids, ids.dtype.type(end))
        active = np.searchsorted(-length, -np.arange(length[0] + 1 if len(length) else 0), side="right")  # texts of at least t words
        for t in range(len(active)):
            n = active[t]
            word = np.where(length[:n] > t, padded[np.minimum(begin[:n] + t, len(ids))], end)
            waiting.append((h[:n], word))
            size += n
            if size >= PENDING or t == len(active) - 1:
                counts = [len(w) for _, w in waiting]
                lp, _ = self.log_probs(np.concatenate([x for x, _ in waiting]), np.concatenate([w for _, w in waiting]))
                out += np.bincount(np.concatenate([np.arange(c) for c in counts]), lp, len(order))
                waiting, size = [], 0
            if t < len(active) - 1:
                n = active[t + 1]
                h, _ = gru.step(table[word[:n]], h[:n], self.p["u"], self.p["c"])
        back = np.empty_like(out)
        back[order] = out
        return back


def _back(d: np.ndarray, cache: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, z, r, inner, n = cache
    d_n = d * (1 - z) * (1 - n * n)
    d_r, d_z, d_inner = d_n * inner * r * (1 - r), d * (h - n) * z * (1 - z), d_n * r
    d_a = np.concatenate((d_z, d_r, d_inner), axis=1)
    return np.concatenate((d_z, d_r, d_n), axis=1), h.T @ d_a, d_inner.sum(0), d * z + d_a @ u.T


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The words above the least count that at most ``most`` words reach, by falling count."""
    level = F.floor(F.log2("n") * 16)
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # at most 16 rows a power of two
    total, least = 0, None
    for at, words in levels:
        if total + words > most:
            break
        total, least = total + words, at
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of parameters, each weighted by its words, and the words."""
    total, mass = None, 0
    for batch in batches:
        for w, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            part = w * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            total, mass = part if total is None else total + part, mass + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([mass], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["words", "params"])


def fit_all(model: Model, training: DataFrame, n_words: int, *, key: str = "doc_id", text: str = "text", seed: int = 0) -> int:
    """Fit ``model`` on each whole text of ``training`` once; returns how many words and ends were read.

    Rows fall by hash into ROUNDS rounds of buckets. The buckets of a round start from the same parameters and train
    side by side; the mean of theirs, weighted by words, starts the next round. The number of buckets follows the
    number of words only, and rows are sorted within one, so the result does not depend on the cluster.
    """
    spark, seen = training.sparkSession, 0
    size = min(max(n_words / (ROUNDS * BUCKETS), BUCKET_WORDS[0]), BUCKET_WORDS[1])
    n = max(1, int(np.ceil(n_words / ROUNDS / size)))
    h = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    rows = training.select(h.alias("h"), F.col(text).alias("text"))
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        rates = tuple(0.5 * RATE * (1 - 0.9 * x / ROUNDS) for x in (k, k + 1))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rates=rates) -> Iterator[pa.RecordBatch]:
            net, table, texts = sent.value, identity_lower(), []
            vocab = pa.array(net.words, pa.binary())
            for batch in batches:
                for at, n_rows in slices(batch.column(0), SLICE_DOCS, SLICE_BYTES):
                    ws = split(batch.column(0).slice(at, n_rows), table)
                    own = pc.fill_null(pc.index_in(short(ws.distinct), value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
                    ids = own[ws.ids] if len(own) else np.zeros(0, np.int32)
                    texts += [ids[a:b] for a, b in zip(ws.starts, ws.starts[1:], strict=False)]
            if texts:
                new = copy.deepcopy(net)  # the worker's next bucket starts from the same parameters
                words = sum(map(len, texts)) + len(texts)
                new.fit(texts, 1, seed, int(min(WIDE_STREAMS, max(STREAMS, words // 1000))), WIDE_STEPS, rates)
                bucket = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([words], pa.int64()), pa.array([new.flat().tobytes()], pa.binary())], names=["bucket", "words", "params"])

        turn = rows.where(F.pmod("h", F.lit(ROUNDS)) == k)
        dealt = turn.repartitionById(n, F.pmod(F.shiftrightunsigned("h", 20), F.lit(n)).cast("int")).sortWithinPartitions("h", "text").select("text")
        fitted = dealt.mapInArrow(run, "bucket int, words long, params binary")
        groups = int(np.ceil(np.sqrt(n)))
        summed = fitted.repartitionById(groups, F.pmod("bucket", F.lit(groups))).sortWithinPartitions("bucket").mapInArrow(_summed, "words long, params binary")
        total, mass = np.zeros(model.flat().size), 0
        for r in summed.collect():  # as many as the root of the buckets, a few hundred kB each
            total += np.frombuffer(r["params"], np.float64)
            mass += r["words"]
        if mass:
            model.load(total / mass)
        seen += mass
        sent.unpersist()
    return seen


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, frequent: int = FREQUENT, seed: int = 0) -> DataFrame:
    """log10 probabilities of whole texts by smoothed word counts (base_score) and by the network (score).

    Returns the key, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score.
    Training rows are those not held out. A word outside the network's vocabulary has the probability of their common
    class times its smoothed share of it, (c + 1) / (their tokens + their words + 1), so the model is a distribution.

    * Null, empty and blank texts are one end. A null key trains. Repeated rows count and are scored each.
    * Without training rows all counts are 0 and the network stays as initialised. Empty tables give empty results.

    * A word of more than 64 bytes is told by its 128-bit digest, so what is sent and joined is short whatever the texts hold.

    Counts and the network's fit cover all training rows, and no text goes to the driver. The most frequent words' counts
    are sent to all tasks (131,072 words of 64 bytes at most), the other words of each text meet their counts in a join. In it a word
    is frequent only if it occurs in held-out rows alone; adaptive execution splits those.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    training = docs.where(~held_out(F.col(key)))
    counts = scratch.write(word_counts(training, text=text), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(counts, frequent)
    least = min((n for _, n in top), default=None)
    names = [w for w, _ in top]
    known = [(w, n) for w, n in top if w != END][:vocabulary]
    ends = counts.where(F.length("word") == 0).select("n").collect()
    known = sorted([*known, (END, ends[0]["n"] if ends else 0)], key=lambda x: (-x[1], x[0]))
    n_rest, v_rest = n_all - sum(n for _, n in known), v_all - sum(1 for _, n in known if n)
    model = Model([w for w, _ in known], np.array([n_rest] + [n for _, n in known], np.float64), seed)
    fit_all(model, training, n_all, key=key, text=text, seed=seed)

    sent = spark.sparkContext.broadcast((pa.array(names, pa.binary()), np.array([n for _, n in top], np.float64), model))
    rest_log = float(np.log10(n_rest + v_rest + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, often, net = sent.value
        log_often = np.log10(np.append(often, 0) + 1)
        to_id = np.array([net.ids.get(w, 0) for w in vocab.to_pylist()] + [0], np.int32)
        table = identity_lower()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.argsort(sizes, kind="stable")))  # texts of like length side by side: few steps with few texts
            for at, n_rows in slices(batch.column(2), SLICE_DOCS, SLICE_BYTES):
                part = batch.slice(at, n_rows)
                ws = split(part.column(2), table)
                names = short(ws.distinct)
                place = pc.fill_null(pc.index_in(names, value_set=vocab), len(vocab)).to_numpy(zero_copy_only=False).astype(np.int32) if len(ws.distinct) else np.zeros(0, np.int32)
                owner = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(ws.starts))
                of = place[ws.ids]
                ids, rare = to_id[of], of == len(vocab)
                log_c, n = log_often[of], part.num_rows
                base = np.bincount(owner, log_c, n)
                outside = np.bincount(owner, np.where(ids == 0, log_c - rest_log, 0.0), n)
                del log_c, of  # long arrays make way for the states
                head = net.score(ids, ws.starts) / np.log(10) + outside
                pairs, tf = np.unique(owner[rare].astype(np.int64) * (len(ws.distinct) + 1) + ws.ids[rare], return_counts=True)
                whose, word = np.divmod(pairs, len(ws.distinct) + 1)
                offsets = pa.array(np.searchsorted(whose, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (names.take(pa.array(word)), pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(ws.starts) + 1), pa.array(np.bincount(owner, ~rare, n).astype(np.int64)), pa.array(base), pa.array(head), *lists],
                    names=["row", "doc_id", "n_tokens", "known", "base", "head", "words", "times"],
                )

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.write(slim.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, head double, words array<binary>, times array<int>"), "rows")
    few = counts.where(F.length("word") > 0) if least is None else counts.where((F.col("n") < least) & (F.length("word") > 0))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # Words that no training row has count 0 and add log10(1), so an inner join does; both its sides come straight from a
    # shuffle, so a hot one of them is split like any skewed key.
    met = each.join(few, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"), F.sum("times").alias("rare_known"))
    out = rows.select("row", "doc_id", "n_tokens", "known", "base", "head").join(met, "row", "left")
    rare, end_log, end_known = F.coalesce("rare", F.lit(0.0)), float(np.log10((ends[0]["n"] if ends else 0) + 1)), int(bool(ends))
    return out.select(
        F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + rare + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"), (F.col("head") + rare).alias("score"),
    )
