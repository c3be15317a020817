"""Toxicity by a bidirectional gated recurrent network with attention pooling over characters and words.

A step's input is the vector of its word (known words of the sample, or one for all others) plus the
mean vector of its character trigrams (hashed), both learned. Longer runs than `LONGEST` bytes are cut at
characters into steps of that length, so every byte is read. The network reads windows of `WINDOW` words from both
ends; attention pools its states to one logit a window. All windows of the whole text, each overlapping
the next by half, are scored; the document's score is the calibrated largest logit.

It is trained in numpy by backpropagation through time, on the driver, from at most `per_class` labelled
documents of each class (those of least hash) and at most `LESSONS` windows of each (drawn by hash from all of its text; both
bounds are documented parameters). First every window has its document's label; then toxic documents teach by their highest windows,
others by their highest and by random ones. A logistic fit on the sample's largest logits, over all windows of
their whole texts and weighted to the true share of labels, gives the score.

Null, empty or wordless texts: score 0. With labels of one class only, all scores are that class's; without labels, 0. A document with
several labels is toxic if one says so; labels that are null or neither 0 nor 1 count for nothing. Repeated rows teach and are scored
each. Very long texts are scored whole. Other columns are kept by `drop_toxic` and not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import gru
from quire.llm.common import drop_staged, held, staged
from quire.llm.langid import RUNS, chunks

THRESHOLD = 0.3
WINDOW, STRIDE = 32, 16
HIDDEN, INPUT, GRAMS, WORDS, LONGEST = 8, 12, 4096, 20_000, 64
STEPS, MORE_STEPS, BATCH, RATE = 300, 300, 256, 1e-2
#: Windows of a document that teach at most.
LESSONS = 96
MEMORY, AT_ONCE, TEXTS = 150_000, 4096, 512
#: Decay of weights a step, and the most passes over the windows of a small sample.
DECAY, PASSES = 1e-3, 12
#: Windows of a batch that are made to repeat their first words: clean texts of few words are rare in a sample.
ECHOES = 16
#: Update-gate input of padding: the state stays as it is.
STAY = 40.0


@dataclass
class Model:
    params: dict[str, np.ndarray] = field(default_factory=dict)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def key(self) -> str:
        return hashlib.sha256(b"".join(self.params[k].tobytes() for k in sorted(self.params)) + f"{self.scale} {self.shift} {self.constant}".encode()).hexdigest()

    def score(self, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * largest + self.shift, -30, 30)))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters; longer ones (texts without spaces) in parts of `LONGEST` bytes, each a step of its own."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(RUNS).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [part for w in words for part in chunks(w, LONGEST)]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of <word> for all words in a row, and where each word's begin; a word has as many as bytes."""
    joined = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + 2 * np.repeat(np.arange(len(words)), lengths)
    code = joined[at] * 65599 + joined[at + 1] * 257 * 31 + joined[at + 2] * 8191
    return (code ^ (code >> 11)) % GRAMS, starts


def inputs(p: dict[str, np.ndarray], words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """[words, INPUT] and what backpropagation needs."""
    grams, starts = grams_of(words)
    counts = np.diff(np.append(starts, len(grams))).astype(np.float32)[:, None]
    return p["words"][ids] + np.add.reduceat(p["grams"][grams], starts, axis=0) / counts, (grams, counts)


def windows_of(n: int) -> np.ndarray:
    """Start of every window over n words; the last covers the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def laid_out(words: np.ndarray, pad: int) -> np.ndarray:
    """[WINDOW, windows] of word numbers."""
    starts = windows_of(len(words))
    padded = np.append(words, np.full(int(starts[-1]) + WINDOW - len(words), pad, words.dtype))
    return padded[starts[None, :] + np.arange(WINDOW)[:, None]]


def new_params(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    return {"words": gru.init(rng, n_words, INPUT, scale=0.2), "grams": gru.init(rng, GRAMS, INPUT, scale=0.3), "if": gru.init(rng, INPUT, 3 * h), "ib": gru.init(rng, INPUT, 3 * h), "uf": gru.init(rng, h, 3 * h), "ub": gru.init(rng, h, 3 * h),
            "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32), "att": gru.init(rng, 2 * h, scale=0.5), "out": gru.init(rng, 2 * h, scale=0.5), "b": np.zeros(1, np.float32)}


def pool(both: np.ndarray, real: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, attention and pooled states of [T, B, 2H]; real marks words that aren't padding."""
    a = np.where(real, both @ p["att"], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, both)
    return pooled @ p["out"] + p["b"], a, pooled


def step(p: dict[str, np.ndarray], seen: list[bytes], ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the logistic loss of a batch of windows x [T, B] (word numbers; len(seen): padding)."""
    h = HIDDEN
    used, where = np.unique(x, return_inverse=True)
    where = where.reshape(x.shape)
    has_pad = used[-1] == len(seen)
    own = used[:-1] if has_pad else used
    words = [seen[i] for i in own]
    e, (grams, counts) = inputs(p, words, ids[own])
    e_all = np.concatenate([e, np.zeros((1, INPUT), np.float32)])
    real = (x != len(seen)).astype(np.float32)[..., None]
    gf, gb = (e_all @ p["if"] + p["bf"])[where], (e_all @ p["ib"] + p["bb"])[where[::-1]]
    hf, cf = gru.forward(gf, p["uf"], real, keep=True)
    hb, cb = gru.forward(gb, p["ub"], real[::-1], keep=True)
    both = np.concatenate([hf, hb[::-1]], axis=2)
    logit, a, pooled = pool(both, real[..., 0] > 0, p)
    d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    d_pooled = d_logit[:, None] * p["out"]
    d_a = np.einsum("bh,tbh->tb", d_pooled, both)
    d_s = a * (d_a - (a * d_a).sum(axis=0))
    d_both = a[..., None] * d_pooled[None] + d_s[..., None] * p["att"]
    grads = {"out": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True), "att": np.einsum("tb,tbh->h", d_s, both)}
    d_gf, grads["uf"] = gru.backward(d_both[:, :, :h], p["uf"], real, cf)
    d_gb, grads["ub"] = gru.backward(d_both[::-1, :, h:], p["ub"], real[::-1], cb)
    d_e = np.zeros_like(e_all)
    for name, d_g, at in (("f", d_gf, where), ("b", d_gb, where[::-1])):
        flat = d_g.reshape(-1, 3 * h)
        d_word = gru.scattered(at.reshape(-1), flat, len(e_all))
        grads["b" + name], grads["i" + name] = flat.sum(axis=0), e_all.T @ d_word
        d_e += d_word @ p["i" + name].T
    d_e = d_e[: len(words)]
    grads["words"] = gru.scattered(ids[own], d_e, len(p["words"]))
    grads["grams"] = gru.scattered(grams, np.repeat(d_e / counts, counts[:, 0].astype(np.int64), axis=0), len(p["grams"]))
    return grads


class Scorer:
    """Largest window logit of texts; a worker remembers the projected inputs of words that it has met."""

    def __init__(self, model: Model):
        self.model, p = model, model.params
        self.known: dict[bytes, int] = {}
        if p:
            self.uf, self.ub = gru.halved(p["uf"]), gru.halved(p["ub"])
            self.project = np.concatenate([gru.halved(p["if"]), gru.halved(p["ib"])], axis=1)
            self.bias = np.concatenate([gru.halved(p["bf"][None]), gru.halved(p["bb"][None])], axis=1)
            self.empty()

    def empty(self) -> None:
        """Row 0 is padding."""
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = STAY
        self.known, self.gates = {}, pad

    def logits(self, x: np.ndarray) -> np.ndarray:
        """One logit for each window of x [WINDOW, windows] (rows of gates; 0: padding)."""
        out = np.empty(x.shape[1], np.float32)
        n = 3 * HIDDEN
        for at in range(0, x.shape[1], AT_ONCE):
            some = x[:, at : at + AT_ONCE]
            rows = [self.gates[t] for t in some]
            hf = gru.states([g[:, :n] for g in rows], self.uf)
            hb = gru.states([g[:, n:] for g in reversed(rows)], self.ub)
            out[at : at + AT_ONCE] = pool(np.concatenate([hf, hb[::-1]], axis=2), some != 0, self.model.params)[0]
        return out

    def largest(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text; -inf without words."""
        return np.concatenate([self._largest(texts[at : at + TEXTS]) for at in range(0, max(1, len(texts)), TEXTS)])

    def _largest(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.empty()
            new = list(set().union(*split))
        if new:
            find = self.model.vocabulary.get
            e, _ = inputs(self.model.params, new, np.array([find(w, 0) for w in new]))
            self.known.update(zip(new, range(len(self.gates), len(self.gates) + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, e @ self.project + self.bias])
        out, held, owners = np.full(len(texts), -np.inf, np.float32), [], []

        def flush() -> None:
            if held:
                np.maximum.at(out, np.repeat(owners, [h.shape[1] for h in held]), self.logits(np.concatenate(held, axis=1)))
                held.clear()
                owners.clear()

        have = 0
        for i, words in enumerate(split):
            if words:
                held.append(laid_out(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), 0))
                owners.append(i)
                have += held[-1].shape[1]
                if have >= 8 * AT_ONCE:
                    flush()
                    have = 0
        flush()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.array([self.model.constant if words_of(t) else 0.0 for t in texts])
        largest = self.largest(texts)
        return np.where(np.isinf(largest), 0.0, self.model.score(largest.astype(float)))


def calibrated(largest: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit by Newton steps, with a little shrinkage."""
    scale, shift = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(scale * largest + shift, -30, 30)))
        w = weight * q * (1 - q) + 1e-6
        g = np.array([(weight * (q - y) * largest).sum() + 0.1 * (scale - 1), (weight * (q - y)).sum()])
        hess = np.array([[(w * largest**2).sum() + 0.1, (w * largest).sum()], [(w * largest).sum(), w.sum()]])
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        scale, shift = scale - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(0.05, float(scale)), float(shift)


def lessons_of(text: str | None, seed: int, most: int | None = None) -> tuple[list[list[bytes]], bool]:
    """Windows of the text, `most` (LESSONS) at most, drawn by the seed from all of them; whether these are all."""
    words, most = words_of(text), most or LESSONS
    if not words:
        return [], True
    starts = windows_of(len(words))
    whole = len(starts) <= most
    if not whole:
        starts = np.sort(np.random.default_rng(seed & (1 << 63) - 1).choice(starts, most, replace=False))
    return [words[s : s + WINDOW] for s in starts.tolist()], whole


def train(texts: list[str], y: np.ndarray, share: float, seed: int = 3) -> Model:
    """Learn from whole texts; share: the toxic part of all labels."""
    return train_on([lessons_of(t, i)[0] for i, t in enumerate(texts)], y, share, seed)


def train_on(lessons: list[list[list[bytes]]], y: np.ndarray, share: float, seed: int = 3) -> Model:
    """Learn from the windows (lists of words) of documents."""
    rng = np.random.default_rng(seed)
    kept = np.array([bool(w) for w in lessons], bool) if lessons else np.zeros(0, bool)
    lessons, y = [w for w in lessons if w], y[kept]
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y[0]) if len(y) else 0.0)
    counts = Counter(w for windows in lessons for w in set().union(*windows))
    common = sorted((w for w, n in counts.items() if n >= 3), key=lambda w: (-counts[w], w))[:WORDS]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    seen = sorted(counts)
    number, ids = {w: i for i, w in enumerate(seen)}, np.array([vocabulary.get(w, 0) for w in seen], np.int32)
    doc = np.repeat(np.arange(len(lessons)), [len(w) for w in lessons])
    x = np.full((WINDOW, len(doc)), len(seen), np.int32)
    for lane, window in enumerate(w for windows in lessons for w in windows):
        x[: len(window), lane] = [number[w] for w in window]
    del lessons, number, counts
    p = new_params(len(vocabulary) + 1, rng)
    adam = gru.Adam(p, RATE)
    model = Model(p, vocabulary)
    pools = [np.flatnonzero(y[doc] == 0), np.flatnonzero(y[doc] == 1)]
    # documents count alike, however many windows they have
    per_doc = 1 / np.bincount(doc, minlength=len(y))[doc]
    chance = [per_doc[q] / per_doc[q].sum() for q in pools]
    first_steps = min(STEPS, PASSES * x.shape[1] // BATCH + 20)
    all_steps = first_steps + min(MORE_STEPS, first_steps)
    for k in range(all_steps):
        if k >= first_steps and (k - first_steps) % 100 == 0:
            logit = _window_logits(Model(p, vocabulary), seen, ids, x)
            order = np.lexsort((-logit, doc))
            rank = np.empty(len(doc), np.int64)
            first = np.flatnonzero(np.diff(np.append(-1, doc[order])))
            rank[order] = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
            hard = rank < 2
            pools = [np.flatnonzero((y[doc] == 0)), np.flatnonzero((y[doc] == 1) & (rank < 1))]
            chance = [np.where(hard[pools[0]], 1.0, 0.05), np.ones(len(pools[1]))]
            chance = [c / c.sum() for c in chance]
        adam.rate = RATE * (1 - k / all_steps) + 5e-4
        chosen = np.concatenate([rng.choice(q, BATCH // 2, p=c) for q, c in zip(pools, chance, strict=True)])
        lanes, target = x[:, chosen].copy(), y[doc[chosen]].astype(np.float32)
        for i in rng.choice(BATCH // 2, ECHOES, replace=False):  # windows that repeat a few clean words are clean
            span = int(rng.integers(1, 5))
            lanes[:, i] = np.resize(lanes[:span, i], WINDOW)
        adam.step(step(p, seen, ids, lanes, target))
        for name in ("words", "grams", "out", "att"):
            p[name] *= np.float32(1 - DECAY)
    largest = np.full(len(y), -np.inf)
    np.maximum.at(largest, doc, _window_logits(model, seen, ids, x).astype(float))
    return recalibrated(model, largest, y, share)


def recalibrated(model: Model, largest: np.ndarray, y: np.ndarray, share: float) -> Model:
    mine = float(y.mean())
    model.scale, model.shift = calibrated(largest, y.astype(float), np.where(y == 1, share / mine, (1 - share) / (1 - mine)))
    return model


def _window_logits(model: Model, seen: list[bytes], ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    scorer, step = Scorer(model), 32_768
    parts = [inputs(model.params, seen[at : at + step], ids[at : at + step])[0] @ scorer.project + scorer.bias for at in range(0, len(seen), step)]
    scorer.gates = np.concatenate([scorer.gates, *parts])
    del parts
    return np.concatenate([scorer.logits(np.where(y == len(seen), 0, y + 1)) for y in (x[:, at : at + step] for at in range(0, x.shape[1], step))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Learn toxic (0 or 1) of `labels` (doc_id, toxic) from the text of `docs`. The sample is drawn from
    the labels, and its ids (2 * per_class at most) are broadcast: no text but the sample's is shuffled."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # more than enough ids are drawn, since some have no text
    part = [known.where(f"toxic = {k}").where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.lit(min(1.0, 6.0 * per_class / n.get(k, 1)) * 1_000_000)) for k in (0, 1)]
    drawn = [q.orderBy(F.xxhash64("doc_id", F.lit(18)), "doc_id").limit(2 * per_class) for q in part]
    ids = drawn[0].unionAll(drawn[1]).withColumnRenamed("doc_id", "_labelled")
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(ids), F.col("doc_id") == F.col("_labelled"))
    place = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(18)), "doc_id", "text")
    sample = staged(texts.withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_class).select("toxic", "n", "text"), "toxic-sample")

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lessons_of(t.as_py(), 2 * n + y) for t, n, y in zip(batch["text"], batch["n"].to_pylist(), batch["toxic"].to_pylist(), strict=True)]
            windows = pa.array([[b" ".join(w) for w in ws] for ws, _ in found], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["n"], windows, pa.array([whole for _, whole in found], pa.bool_())], names=["toxic", "n", "windows", "whole"])

    kinds = ", ".join(f"{c} {t}" for c, t in sample.select("toxic", "n").dtypes)
    rows = sorted(sample.mapInArrow(lessons, f"{kinds}, windows array<binary>, whole boolean").collect(), key=lambda r: (r.toxic, r.n))
    y, share = np.array([r.toxic for r in rows], np.int64), n.get(1, 0) / max(1, sum(n.values()))
    model = train_on([[bytes(w).split(b" ") for w in r.windows] for r in rows], y, share)
    if model.constant is None and not all(r.whole for r in rows):
        # long documents taught by some of their windows: the calibration sees the largest logit of all of them
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(Scorer(shared.value).largest(batch["text"].to_pylist()).astype(float))], names=["toxic", "largest"])

        found = [r for r in sample.mapInArrow(logits, f"{kinds.split(',')[0]}, largest double").collect() if r.largest > -np.inf]
        model = recalibrated(model, np.array([r.largest for r in found]), np.array([r.toxic for r in found], np.int64), share)
    drop_staged(sample)
    return model


def scorer(model: Model) -> Scorer:
    return held(f"toxicity {model.key()}", lambda: Scorer(model))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + GRAMS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scorer(shared.value).scores(batch["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, with their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(shared.value).scores(batch["text"].to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
