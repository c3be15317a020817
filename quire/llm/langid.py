"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads runs of letters as bytes, A-Z as a-z (a-z and all bytes above 127; longer runs in chunks of
`SPAN` bytes, cut between characters), from both ends, and gives every byte position a distribution over the
languages; digits, punctuation and white space only part the runs. A document's probabilities are the mean over all its positions; the language is the largest (ties: the first by code
point), the score its probability. The state starts anew with each run, so the sum over a run's positions is the
same wherever it occurs: a worker remembers these sums for runs that it has met. Every position of the
whole text counts.

It is trained in numpy by backpropagation through time, on the driver, from at most `per_lang` documents of each
language (those of least hash) and at most `per_doc` runs of each of these, drawn by hash from its whole text, in `STEPS` batches.
These bounds are parameters, as is `max_langs`: more languages raise an error, none is dropped.

Null or letterless texts: `und` with score 0. Null languages teach nothing; with no language at all, or an empty table, all is
`und`. Very long texts are read whole. Repeated rows teach and are predicted each. Other columns stay as they are, but `lang_pred` and
`score` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import gru
from quire.llm.common import held

SPAN, HIDDEN, STEPS, BATCH, RATE = 24, 12, 600, 384, 1e-2
#: Runs that a worker remembers, runs that go through the network at once, texts that are split at once.
MEMORY, AT_ONCE, TEXTS = 300_000, 2048, 512
#: Documents rejected by the pipeline's filter: `und`, or a language hardly likelier than the others.
LEAST_SCORE = 0.35


@dataclass
class Model:
    langs: list[str]
    params: dict[str, np.ndarray]

    def key(self) -> str:
        """A digest of the weights; a worker's memory belongs to one model."""
        return hashlib.sha256(b"".join(self.params[k].tobytes() for k in sorted(self.params)) + repr(self.langs).encode()).hexdigest()


def new_params(n_langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    return {"ef": gru.init(rng, 256, 3 * h, scale=0.3), "eb": gru.init(rng, 256, 3 * h, scale=0.3), "uf": gru.init(rng, h, 3 * h), "ub": gru.init(rng, h, 3 * h),
            "w": gru.init(rng, 2 * h, n_langs), "b": np.zeros(n_langs, np.float32)}


def as_matrix(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [T, B] (padded with 0) and lengths."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    width = int(lengths.max())
    return np.frombuffer(b"".join([r.ljust(width, b"\0") for r in runs]), np.uint8).reshape(len(runs), width).T, lengths


def mirrored(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[T, B, ...] with each lane's own steps reversed, padding left in place."""
    steps = np.arange(x.shape[0])[:, None]
    at = np.where(steps < lengths[None, :], lengths[None, :] - 1 - steps, steps)
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), axis=0)


def positions(p: dict[str, np.ndarray], runs: list[bytes], keep: bool = False):
    """Language probabilities [T, B, langs] of every position, the mask [T, B, 1], and what backpropagation needs."""
    x, lengths = as_matrix(runs)
    mask = (np.arange(x.shape[0])[:, None] < lengths[None, :]).astype(np.float32)[..., None]
    back = mirrored(x, lengths)
    hf, cf = gru.forward(p["ef"][x], p["uf"], mask if keep else None, keep)
    hb, cb = gru.forward(p["eb"][back], p["ub"], mask if keep else None, keep)
    both = np.concatenate([hf, mirrored(hb, lengths)], axis=2)
    logits = both @ p["w"] + p["b"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True), mask, (x, back, lengths, both, cf, cb)


def train(runs: list[bytes], y: np.ndarray, n_langs: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Cross-entropy of every position's language, by backpropagation through time."""
    rng = np.random.default_rng(seed)
    p = new_params(n_langs, rng)
    adam, by_lang = gru.Adam(p, RATE), [np.flatnonzero(y == k) for k in range(n_langs)]
    for step in range(STEPS):
        adam.rate = RATE * (1 - step / STEPS) + 1e-4
        chosen = np.concatenate([rng.choice(own, BATCH // n_langs + 1) for own in by_lang if len(own)])
        prob, mask, (x, back, lengths, both, cf, cb) = positions(p, [runs[i] for i in chosen], keep=True)
        d = prob.copy()
        d[:, np.arange(len(chosen)), y[chosen]] -= 1
        d *= mask / mask.sum()
        flat = d.reshape(-1, d.shape[2])
        grads = {"w": both.reshape(-1, both.shape[2]).T @ flat, "b": flat.sum(axis=0)}
        d_both = d @ p["w"].T
        h = HIDDEN
        for name, bytes_, d_h, cache in (("f", x, d_both[:, :, :h], cf), ("b", back, mirrored(d_both[:, :, h:], lengths), cb)):
            d_gates, grads["u" + name] = gru.backward(d_h, p["u" + name], mask, cache)
            grads["e" + name] = gru.scattered(bytes_.reshape(-1), d_gates.reshape(-1, 3 * h), 256)
        adam.step(grads)
    return p


#: A-Z as a-z; other ASCII bytes that are no letters part runs.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The text's runs of letters; empty if it has no letters."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return text.encode("utf-8", "surrogatepass").translate(RUNS).split()


def pooled(p: dict[str, np.ndarray], runs: list[bytes]) -> np.ndarray:
    """[runs, langs], from halved gates: sums over the positions of runs of one length, which need no padding."""
    x = np.frombuffer(b"".join(runs), np.uint8).reshape(len(runs), -1).T
    n = HIDDEN
    hf = gru.states([p["ef"][row] for row in x], p["uf"])
    hb = gru.states([p["eb"][row] for row in x[::-1]], p["ub"])
    logits = hf.reshape(-1, n) @ p["w"][:n] + hb[::-1].reshape(-1, n) @ p["w"][n:] + p["b"]
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(len(x), len(runs), -1).sum(axis=0)


def chunks(run: bytes, span: int = SPAN) -> list[bytes]:
    """A run in parts of `span` bytes at most, cut in front of a character's first byte."""
    out, at = [], 0
    while at < len(run):
        end = min(at + span, len(run))
        while end < len(run) and end > at + 1 and run[end] & 0xC0 == 0x80:
            end -= 1
        out.append(run[at:end])
        at = end
    return out


def _lessons(per_doc: int):
    """Streams (lang, _h, doc_id, text): lang and `per_doc` of the text's runs, drawn by the hash from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taught = []
            for text, h in zip(batch["text"], batch["_h"].to_pylist(), strict=True):
                parts = [c for r in runs_of(text.as_py()) for c in chunks(r)]
                if len(parts) > per_doc:
                    parts = [parts[i] for i in np.sort(np.random.default_rng(h & (1 << 63) - 1).choice(len(parts), per_doc, replace=False))]
                taught.append(parts)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(taught, pa.list_(pa.binary()))], names=["lang", "runs"])

    return run


def fit(docs: DataFrame, per_lang: int = 400, per_doc: int = 200, max_langs: int = 1000) -> Model:
    """Learn from text and lang of `docs`; languages come in order of code point."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", F.lit(9)).alias("_h"), "doc_id")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], new_params(1, np.random.default_rng(0)))
    # the hash picks before the window sorts: a language's rows are thinned, never gathered
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, 3.0 * per_lang / counts[k])))])
    thin = known.where(F.pmod("_h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    drawn = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))).where(F.col("n") <= per_lang)
    rows = drawn.select("lang", "_h", "text").mapInArrow(_lessons(per_doc), "lang string, runs array<binary>").collect()
    rows.sort(key=lambda r: (r.lang, r.runs))
    at = {k: i for i, k in enumerate(langs)}
    runs, y = [bytes(c) for r in rows for c in r.runs], np.repeat([at[r.lang] for r in rows], [len(r.runs) for r in rows]).astype(np.int64)
    return Model(langs, train(runs, y, len(langs)))


class Scorer:
    """Sums of position probabilities by run, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.params = {k: gru.halved(v) if k[0] in "eu" else v for k, v in model.params.items()}
        self.sums = np.zeros((0, len(model.langs)), np.float32)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        parts, owner = [], []
        for i, run in enumerate(new):
            for c in [run] if len(run) <= SPAN else chunks(run):
                parts.append(c)
                owner.append(i)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        owner, out = np.array(owner), np.zeros((len(new), len(self.model.langs)), np.float32)
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            for at in range(0, len(same), AT_ONCE):
                some = same[at : at + AT_ONCE]
                np.add.at(out, owner[some], pooled(self.params, [parts[i] for i in some]))
        return out

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """[texts, langs]; rows of zeros where there are no letters."""
        parts = [self._probabilities(texts[at : at + TEXTS]) for at in range(0, len(texts), TEXTS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.model.langs)))

    def _probabilities(self, texts: list[str | None]) -> np.ndarray:
        split = [runs_of(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known, self.sums = {}, self.sums[:0]
            new = list(set().union(*split))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.sums = np.concatenate([self.sums, self._learn(new)])
        out = np.zeros((len(texts), len(self.model.langs)))
        for i, words in enumerate(split):
            if words:
                out[i] = self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def scorer(model: Model) -> Scorer:
    return held(f"langid {model.key()}", lambda: Scorer(model))


def _labels(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    langs = model.langs
    if not langs or not texts:
        return ["und"] * len(texts), [0.0] * len(texts)
    prob = scorer(model).probabilities(texts)
    best = prob.argmax(axis=1)
    return ["und" if not row.any() else langs[k] for row, k in zip(prob, best, strict=True)], prob.max(axis=1).clip(0, 1).tolist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score. Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _labels(batch["text"].to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in extra), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*extra, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*extra).dtypes)
    return docs.select(*extra).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of `docs`, with their columns, whose language is known with at least that score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _labels(batch["text"].to_pylist(), shared.value)
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
