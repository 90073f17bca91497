"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A sentence's score is a logistic function of the features (words and word beginnings) that it holds; a document is toxic
with probability 1 - product of (1 - score) over its sentences. The weights are trained from document labels alone, by
gradient ascent on that probability, so that the sentences which explain a label are found with it.

Training uses at most MAX_TRAIN labelled rows (those of the smallest hashed ids) and the FEATURES features that tell the
two labels apart best; scoring covers every sentence of every row.

Defined results: null text counts as empty; a text without sentences scores as one empty sentence; repeated rows get
equal scores; repeated labels of a document count once, by their mean; without labels of both kinds all scores are low
or high alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, with_text
from .quality_gbdt import held_out, training_ids

MAX_TRAIN, FEATURES = 8_000, 4_096
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_END = frozenset(".!?\n")
BEGINNINGS = (4, 5, 6, 7, 8)


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def sentences(text: str):
    """Start, end and lower-cased words of each sentence that has words."""
    words, start, end = [], 0, 0
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t[0] in _END:
            if words:
                yield start, m.end(), words
            words = []
        else:
            if not words:
                start = m.start()
            words.append(t.lower())
            end = m.end()
    if words:
        yield start, end, words


#: A feature starts with this share of its log odds: a word has several features, which add up.
START = 0.5


def _chosen(rows: DataFrame, size: int) -> list[tuple[str, float]]:
    """The features that tell the labels apart best, by the log-likelihood ratio of their document counts, and the
    weight that each starts from: a share of its log odds, where they speak for toxic."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        for b in slices(batches):
            for y, t in zip(column_of(b, "y").to_pylist(), column_of(b, "text").to_pylist(), strict=True):
                for f in {f for w in set(re.findall(r"[^\W\d_]+", t.lower())) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[y >= 0.5] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["feature", "n0", "n1"])

    n1, n = rows.agg(F.count_if(F.col("y") >= 0.5), F.count("*")).first()
    if not n1 or n1 == n:
        return []
    counts = rows.select("y", "text").mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    p, q = (F.col("b") + 0.5) / (n1 + 1), (F.col("a") + 0.5) / (n - n1 + 1)
    worth = F.abs(F.col("b") * F.log(p / q) + (n1 - F.col("b")) * F.log((1 - p) / (1 - q)))
    best = counts.where(F.col("a") + F.col("b") >= 3).orderBy(F.desc(worth), "feature").limit(size)
    return [(r.feature, START * max(r.odds, 0.0)) for r in best.select("feature", F.log(p / q).alias("odds")).collect()]


def fit(bags: list[list[list[int]]], y: np.ndarray, start: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; bags: for each document the feature numbers of each of its sentences.

    Weights are drawn to where they start: a word whose documents others explain as well keeps its weight.
    """
    width = len(start)
    bag_of = np.array([i for i, bag in enumerate(bags) for _ in bag], np.int64)
    sent = [s for bag in bags for s in bag]
    rows, cols = np.repeat(np.arange(len(sent)), [len(s) for s in sent]), np.array([f for s in sent for f in s], np.int64)
    w, bias, n = start.copy(), -7.0, len(bags)
    mean, square, step = np.zeros(width + 1), np.zeros(width + 1), 0
    for _ in range(steps if len(sent) else 0):
        z = np.clip(bias + np.bincount(rows, w[cols], len(sent)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        # log of the chance that no sentence is toxic
        none = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        some = np.maximum(-np.expm1(none), 1e-9)
        # d log-likelihood / d z of a sentence: p for toxic bags times the odds of none, -p for others
        pull = np.where(y > 0.5, np.exp(none) / some, -1.0)
        d = pull[bag_of] * p / n
        grad = np.append(np.bincount(cols, d[rows], width) - decay * (w - start), d.sum())
        step += 1
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w + move[:-1], bias + move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN, size: int = FEATURES) -> tuple[dict[str, float], float]:
    """A weight for each chosen feature, and the bias of a sentence."""
    rows = with_text(docs).join(F.broadcast(training_ids(labels, label, most)), "doc_id")
    chosen = _chosen(rows, size)
    number = {f: i for i, (f, _) in enumerate(chosen)}

    def run(batches):
        for b in slices(batches):
            bags = [[sorted({number[f] for w in set(words) for f in word_features(w) if f in number}) for _, _, words in sentences(t)] for t in column_of(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "y"), pa.array([x or [[]] for x in bags], pa.list_(pa.list_(pa.int32())))], ["doc_id", "y", "bag"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, bag array<array<int>>").toArrow().sort_by("doc_id")
    y = (got.column("y").to_numpy() >= 0.5).astype(float)
    w, bias = fit(got.column("bag").to_pylist(), y, np.array([x for _, x in chosen]))
    return {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, bias


class Scorer:
    """Scores texts; the weight of each word is worked out once for each worker."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        x = self.words.get(w)
        if x is None:
            if len(self.words) > 500_000:
                self.words.clear()
            low = w.lower()
            x = self.words[w] = sum(self.weights.get(f, 0.0) for f in dict.fromkeys(word_features(low)))
        return x

    def text(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Document score, number of sentences, and the sentences of at least 0.5: start, end, score."""
        sums, spans, current, start, filled = [], [], {}, 0, False
        end = 0
        word, get = self.word, self.words.get
        for m in _TOKEN.finditer(text):
            t = m.group()
            if t[0] in _END:
                if filled:
                    sums.append(current)
                    spans.append((start, m.end()))
                current, filled = {}, False
                continue
            if not filled:
                start, filled = m.start(), True
            end = m.end()
            x = get(t)
            if x is None:
                x = word(t)
            if x:
                low = t.lower()
                for f in word_features(low):
                    v = self.weights.get(f)
                    if v is not None:
                        current[f] = v
        if filled:
            sums.append(current)
            spans.append((start, end))
        z = np.array([sum(c.values()) if c else 0.0 for c in sums] or [0.0]) + self.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        hot = [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)] if spans else []
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), len(spans), hot


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and the offending sentences (start, end, score) of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, label, most))

    def run(batches):
        s = Scorer(*model.value)
        for b in slices(batches):
            got = [s.text(t) for t in column_of(b, "text").to_pylist()]
            spans = pa.array([[{"start": x, "end": y, "score": z} for x, y, z in hot] for _, _, hot in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array([x for x, _, _ in got], pa.float64()), pa.array([n for _, n, _ in got], pa.int32()), spans], ["doc_id", "score", "n_sentences", "offending"])

    out = with_text(docs).mapInArrow(run, "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")
