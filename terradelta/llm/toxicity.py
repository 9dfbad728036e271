"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon (words, and word beginnings of ``STEM`` letters) with its weights, the share of
lexicon hits near a second-person pronoun, capitals, punctuation, and obfuscation (digits and marks inside words, masked
letters, stretched letters, hits that only show after undoing such spelling).

All is learnt from at most ``SAMPLE`` labelled documents (the first in the order of a hash of their id, outside the
held-out fold), in ``PARTS`` parts: a part's features come from the lexicon of the other parts, so the trees see hits as new
texts have them, and the calibration is learnt from every part's scores by trees of the other parts. The scoring lexicon
and trees are then learnt from all parts. Terms are counted by Spark; only the lexicon (at most ``TERMS`` rows) reaches the
driver. Scoring is one pass over the documents without a shuffle.

Defined cases: null and empty texts have zero features and get the score of such a text; texts are read whole, whatever
their length; repeated rows get equal scores; conflicting labels of one document count as the lower; where the other parts
of a part do not have both labels, every score is the share of toxic labels (0 without labels); an empty table gives no row.
Only id and text are read, other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.common import crc_fold, joined, stored, text_blocks, word_hashes, word_spans
from terradelta.llm.mil import training_ids

SAMPLE = 20_000
PARTS = 3
TERMS = 400
STEM = 5
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
NEAR = 5  # words between a pronoun and a hit

# Second-person words of the corpus languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "youre", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "du", "dich", "dir",
                 "dein", "deine", "ihr", "euch", "usted", "ustedes", "ti", "tus", "vosotros")
# Letters that look-alikes stand for.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

FEATURES = ("log_words", "word_hits", "word_weight", "stem_hits", "stem_weight", "any_word", "any_stem", "top_weight", "near_second_person", "second_person",
            "capitals", "shouted_words", "bang", "question", "punctuation", "symbols", "mixed_words", "masked_words", "stretched_words", "hidden_hits")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_PLAIN = _SMALL.copy()
_MARK = np.zeros(256, dtype=bool)
for _c, _l in LOOK_ALIKE.items():
    _PLAIN[ord(_c)] = ord(_l)
    _MARK[ord(_c)] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>@~^_=+")] = True
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: bytes) -> set[bytes]:
    """Words and word beginnings (ending in *) of a text."""
    words = set(_TERM.findall(text.lower()))
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM}


class Lexicon:
    """Weights by hash of words and of word beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.words = self._table({k: v for k, v in weights.items() if not k.endswith("*")})
        self.stems = self._table({k[:-1]: v for k, v in weights.items() if k.endswith("*")})
        self.second = self._table({k: 1.0 for k in SECOND_PERSON})

    @staticmethod
    def _table(weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        buf, at = joined([k.encode("utf-8", "surrogateescape") for k in weights])
        h = word_hashes(buf, at[:-1], at[1:] - 1) if weights else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h)
        return h[order], np.array(list(weights.values()))[order]

    @staticmethod
    def look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        keys, weights = table
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, weights[at], 0.0)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if flag[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    buf, at = joined(texts)
    n = len(texts)
    of = lambda pos: np.searchsorted(at, pos, side="right") - 1
    per_doc = lambda flag: np.add.reduceat(flag.astype(np.int64), at[:-1])
    starts, ends = _runs(_LETTER[buf])
    doc = of(starts)
    small = _SMALL[buf]
    h = word_hashes(small, starts, ends)
    hs = word_hashes(small, starts, np.minimum(ends, starts + STEM))
    long = ends - starts > STEM
    w = lexicon.look(lexicon.words, h)
    s = np.where(long, lexicon.look(lexicon.stems, hs), 0.0)
    second = lexicon.look(lexicon.second, h) > 0
    words = np.bincount(doc, minlength=n).astype(np.float64)
    per = np.maximum(1.0, words)
    count = lambda flag: np.bincount(doc[flag], minlength=n)
    hit = (w > 0) | (s > 0)
    # a pronoun of the same text within NEAR words on either side
    place = np.concatenate(([-1 << 40], np.flatnonzero(second), [1 << 40]))
    i = np.flatnonzero(hit)
    right = np.searchsorted(place, i)
    before, after = place[right - 1], place[right]
    near = ((i - before <= NEAR) & (doc[np.clip(before, 0, None)] == doc[i])) | ((after - i <= NEAR) & (doc[np.clip(after, None, max(0, len(doc) - 1))] == doc[i]))
    top = np.zeros(n)
    np.maximum.at(top, doc[i], np.maximum(w[i], s[i]))
    # words between white space, with what stands inside them
    ws, we = word_spans(buf)
    wdoc = of(ws)
    letter, mark, up = (np.concatenate(([0], np.cumsum(f))) for f in (_LETTER[buf], _MARK[buf], (buf >= 65) & (buf <= 90)))
    star = np.concatenate(([0], np.cumsum(buf == 42)))
    length, letters = we - ws, letter[we] - letter[ws]
    # marks with letters on both sides, not those that only close a word
    inner = _MARK[buf]
    inner[1:] &= _LETTER[buf[:-1]] | _MARK[buf[:-1]]
    inner[:-1] &= _LETTER[buf[1:]] | _MARK[buf[1:]]
    inside = np.concatenate(([0], np.cumsum(inner)))
    mixed = (inside[we] - inside[ws] > 0) & (letters >= 2)
    masked = (star[we] - star[ws] >= 2) & (letters >= 1) & (buf[we - 1] != 42)
    same = np.zeros(len(buf), dtype=np.int64)
    same[2:] = (small[2:] == small[1:-1]) & (small[2:] == small[:-2]) & _LETTER[buf[2:]]
    stretch = np.concatenate(([0], np.cumsum(same)))
    stretched = stretch[we] - stretch[ws] > 0
    shouted = (up[we] - up[ws] >= 3) & (up[we] - up[ws] == letters)
    odd = np.flatnonzero(mixed)
    plain = _PLAIN[buf]
    ho = word_hashes(plain, ws[odd], we[odd])
    hidden = (lexicon.look(lexicon.words, ho) > 0) | (lexicon.look(lexicon.stems, word_hashes(plain, ws[odd], np.minimum(we[odd], ws[odd] + STEM))) > 0)
    tokens = np.maximum(1.0, np.bincount(wdoc, minlength=n))
    wcount = lambda flag: np.bincount(wdoc[flag], minlength=n) / tokens
    size = np.maximum(1.0, np.diff(at) - 1.0)
    n_word, n_stem = count(w > 0), count(s > 0)
    return np.column_stack([
        np.log1p(words), n_word / per, np.bincount(doc, weights=w, minlength=n) / per, n_stem / per, np.bincount(doc, weights=s, minlength=n) / per,
        np.minimum(n_word, 5), np.minimum(n_stem, 5), top, np.bincount(doc[i][near], minlength=n) / np.maximum(1.0, np.bincount(doc[i], minlength=n)), count(second) / per,
        per_doc((buf >= 65) & (buf <= 90)) / size, wcount(shouted), per_doc(buf == 33) / size, per_doc(buf == 63) / size, per_doc(_PUNCT[buf]) / size, per_doc(_SYMBOL[buf]) / size,
        wcount(mixed), wcount(masked), wcount(stretched), np.bincount(wdoc[odd][hidden], minlength=n) / tokens])


def learn_lexicon(part: DataFrame, n_terms: int = TERMS) -> dict[str, float]:
    """Terms far more frequent in toxic documents, with the logarithm of how much; counted over all of ``part`` (y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_pylist()
            for first, texts in text_blocks(b.column(1)):
                n, bad = Counter(), Counter()
                for label, t in zip(y[first:], texts):
                    found = terms(t)
                    n.update(found)
                    if label:
                        bad.update(found)
                keys = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in keys]), pa.array([n[k] for k in keys], type=pa.int64()),
                                                  pa.array([bad[k] for k in keys], type=pa.int64())], names=["term", "n", "bad"])

    counts = part.select("y", "text").mapInArrow(run, "term string, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    docs, bad = part.agg(F.count("*"), F.sum("y")).first()
    if not bad or bad == docs:
        return {}
    rate = bad / docs
    lift = (F.col("bad") + 0.5) / (F.col("n") + 0.5 / rate) / rate
    z = (F.col("bad") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    rows = counts.where("bad >= 4").withColumn("lift", lift).withColumn("z", z).where("lift >= 2.5 and z >= 5").orderBy(F.desc("z"), "term").limit(n_terms).collect()
    return {r["term"]: float(np.log(r["lift"])) for r in rows}


class ToxicityModel:
    """Lexicon, trees and calibration; ``rate`` is the score where no trees could be learnt."""

    def __init__(self, lexicon: Lexicon, trees=None, calibration=None, rate: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def rows(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns (long) and the feature vector."""
        lexicon, k = self.lexicon, len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, texts in text_blocks(b.column(k)):
                    x = features(texts, lexicon)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * x.shape[1], type=pa.int32()), pa.array(x.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(texts)) for i in range(k)), flat], names=[*keep, "x"])

        schema = ", ".join([*(f"{c} long" for c in keep), "x array<double>"])
        return docs.select(*(docs[c].cast("long").alias(c) for c in keep), "text").mapInArrow(run, schema).withColumn("features", array_to_vector("x")).drop("x")

    def raw(self, rows: DataFrame) -> DataFrame:
        out = self.trees.transform(rows)
        return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        rows = self.rows(docs, "doc_id")
        if self.trees is None:
            return rows.select("doc_id", F.lit(float(self.rate)).alias("score"))
        return self.calibration.transform(self.raw(rows)).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE, trees: int = 40) -> ToxicityModel:
    ids = training_ids(docs, labels, "toxic", folds, held, sample)
    chosen = docs.select(docs["doc_id"].cast("long"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("y").cast("long").alias("y"), "text")
    part = F.pmod(F.xxhash64(F.concat(F.lit("part"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(PARTS))
    chosen = stored(chosen.withColumn("part", part), "toxic-sample")
    n, bad = chosen.agg(F.count("*"), F.sum("y")).first()
    per = {(r["part"], r["y"]) for r in chosen.select("part", "y").distinct().collect()}
    model = ToxicityModel(Lexicon({}), rate=(bad or 0) / n if n else 0.0)
    if any({y for p, y in per if p != k} != {0, 1} for k in range(PARTS)):
        return model
    # features of a part by the lexicon of the others, scores of a part by the trees of the others
    rows = None
    for k in range(PARTS):
        own = ToxicityModel(Lexicon(learn_lexicon(chosen.where(F.col("part") != k)))).rows(chosen.where(F.col("part") == k), "doc_id", "y", "part")
        rows = own if rows is None else rows.unionByName(own)
    rows = stored(rows, "toxic-features")
    gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, seed=5, maxBins=32, minInstancesPerNode=5, cacheNodeIds=False)
    raw = None
    for k in range(PARTS):
        model.trees = gbt.fit(rows.where(F.col("part") != k).coalesce(2))
        own = model.raw(rows.where(F.col("part") == k))
        raw = own if raw is None else raw.unionByName(own)
    iso = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score")
    model.calibration = iso.fit(stored(raw.withColumn("y", F.col("y").cast("double")), "toxic-raw").coalesce(1))
    model.lexicon, model.trees = Lexicon(learn_lexicon(chosen)), gbt.fit(rows.coalesce(2))
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = fit(docs, labels, folds, held, sample).score(docs)
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
