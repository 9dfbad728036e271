"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (shares of character and word classes,
repetition inside the passage and of earlier parts of the text, then a learnt layer); gated attention

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )

weighs the passages, and a logistic layer scores the weighted representation. All of it is learnt from document labels.

Training uses at most ``SAMPLE`` labelled documents, those first in the order of a hash of their id; the sample's
passages are the only thing that reaches the driver. Scoring is one pass over the documents without a shuffle.

Defined cases: null and empty texts are one empty passage and get a score like any other; conflicting labels of one
document count as the lower; without labelled training rows every score is 0.5; all passages of a text are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.common import U, crc_fold, joined, mix64, text_blocks, word_hashes, word_spans

PASSAGE = 64
SAMPLE = 6000
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE = 24, 12, 25, 256, 0.01
STEPS = 300  # at least, however few documents there are

# Byte classes: small letters, capitals, digits, line ends, other white space, symbols, ! and ?, other ASCII marks, non-ASCII, controls.
_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[33:127] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[10] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>{}=~^\\_@"]] = 5
_CLASS[[33, 63]] = 6
_CLASS[128:] = 8
N_CLASSES = 10
N_FEATURES = N_CLASSES + 9


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and how many passages each text has (one at least)."""
    buf, at = joined(texts)
    starts, ends = word_spans(buf)
    doc = np.searchsorted(at, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_pass)))
    total = int(first[-1])
    before = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    cell = first[doc] + (np.arange(len(doc)) - before[doc]) // PASSAGE
    # a byte belongs to the passage of the last word begun before it in its text
    new = np.flatnonzero((cell[1:] != cell[:-1]) & (doc[1:] == doc[:-1])) + 1
    base = np.repeat(first[:-1], np.diff(at))
    inner = np.zeros(len(buf), dtype=np.int64)
    inner[starts[new]] = 1
    inner = np.cumsum(inner)
    owner = base + inner - np.repeat(inner[at[:-1]], np.diff(at))
    counts = np.bincount(owner * N_CLASSES + _CLASS[buf], minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(np.float64)
    size = np.maximum(1.0, counts.sum(axis=1))
    words = np.bincount(cell, minlength=total).astype(np.float64)
    per = np.maximum(1.0, words)
    share = lambda flag: np.bincount(cell[flag], minlength=total) / per
    h = word_hashes(buf, starts, ends)
    length = ends - starts
    lead, last = _CLASS[buf[starts]], _CLASS[buf[ends - 1]]
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = _seen_before(mix64(h ^ mix64(cell.astype(U) + U(7))))
    run = np.zeros(len(h), dtype=bool)
    if len(h) >= 4:
        key = ((h[:-3] * U(3) + h[1:-2]) * U(5) + h[2:-1]) * U(7) + h[3:]
        run[: len(key)] = _seen_before(mix64(key ^ mix64(doc[:-3].astype(U) + U(1)))) & (doc[:-3] == doc[3:])
    extra = [np.log1p(words) / np.log(PASSAGE + 1), np.bincount(cell, weights=length, minlength=total) / per / 10, share(length > 12), share(length < 4),
             share(lead == 1), share((last == 5) | (last == 6)), share(again), share(twin), share(run)]
    return np.column_stack([counts / size[:, None], *extra]).astype(np.float32), n_pass


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over bags; parameters in a dict, gradients written out."""

    def __init__(self, n_features: int, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(b), (a, b))
        self.p = {"W": init(HIDDEN, n_features), "b": np.zeros(HIDDEN), "V": init(GATE, HIDDEN), "U": init(GATE, HIDDEN),
                  "w": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.1, HIDDEN), "c0": np.zeros(1)}
        self.mean, self.std = np.zeros(n_features), np.ones(n_features)

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, at = self.p, np.concatenate(([0], np.cumsum(n)))[:-1]
        x = np.clip((x - self.mean) / self.std, -8, 8)
        h = np.tanh(x @ p["W"].T + p["b"])
        t, g = np.tanh(h @ p["V"].T), _sigmoid(h @ p["U"].T)
        a = (t * g) @ p["w"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
        alpha = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(alpha[:, None] * h, at, axis=0)
        return x, h, t, g, alpha, z, _sigmoid(z @ p["c"] + p["c0"])

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
        p, at = self.p, np.concatenate(([0], np.cumsum(n)))[:-1]
        x, h, t, g, alpha, z, out = self.forward(x, n)
        d = (out - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        d_alpha = (h * dz).sum(axis=1)
        da = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, at), n))
        dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
        dh = (alpha[:, None] * dz + dt @ p["V"] + dg @ p["U"]) * (1 - h * h)
        return {"W": dh.T @ x, "b": dh.sum(axis=0), "V": dt.T @ h, "U": dg.T @ h, "w": (t * g).T @ da, "c": z.T @ d, "c0": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(axis=0), every.std(axis=0) + 1e-3
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        share = np.clip(y.mean(), 0.02, 0.98)  # start from the share of good documents
        self.p["c0"][0] = np.log(share / (1 - share))
        epochs = max(EPOCHS, -(-STEPS // -(-len(bags) // BATCH)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = r.permutation(len(bags))
            for lo in range(0, len(bags), BATCH):
                pick = order[lo : lo + BATCH]
                grad = self.gradients(np.concatenate([bags[i] for i in pick]), np.array([len(bags[i]) for i in pick]), y[pick])
                step += 1
                for k, gk in grad.items():  # Adam with a little weight decay
                    m[k] = 0.9 * m.get(k, 0.0) + 0.1 * gk
                    v[k] = 0.999 * v.get(k, 0.0) + 0.001 * gk * gk
                    self.p[k] = self.p[k] * (1 - 1e-4) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)[-1]


def training_ids(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int, sample: int) -> DataFrame:
    """doc_id, y of at most ``sample`` labelled documents outside the held-out fold, by the order of a hash."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.min(target).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> AttentionModel | None:
    """The model learnt from the sample, or None without a labelled document."""
    ids = training_ids(docs, labels, "quality", folds, held, sample)
    chosen = docs.select(docs["doc_id"].cast("long"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(2)):
                x, n = passages(texts)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n * x.shape[1]))), type=pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), flat], names=["doc_id", "y", "x"])

    rows = chosen.select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "doc_id long, y int, x array<float>").toArrow()
    if not rows.num_rows:
        return None
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), (np.array(v, dtype=np.float32) for v in rows["x"].to_pylist())), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    return AttentionModel(N_FEATURES).fit([v.reshape(-1, N_FEATURES).astype(np.float64) for _, _, v in found], np.array([y for _, y, _ in found], dtype=np.float64))


def score_batches(model: AttentionModel | None, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) of consecutive rows of a text column."""
    for first, texts in text_blocks(column):
        yield first, np.full(len(texts), 0.5) if model is None else model.score(*passages(texts))


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, folds, held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in score_batches(model, b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(s)), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents predicted to be good, all columns as they are."""
    model, text_at = fit(docs, labels, sample=sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in score_batches(model, b.column(text_at)):
                yield b.slice(first, len(s)).filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
