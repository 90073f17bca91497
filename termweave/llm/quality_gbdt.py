"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays (feature, threshold, leaf value), which numpy walks for a whole batch of
documents level by level. Training uses at most MAX_TRAIN labelled rows (those of the smallest hashed ids), statistics
only; scoring covers every row.

Defined results: null text counts as empty and gets a score like any other; repeated rows get equal scores; repeated
labels of a document count once, by their mean; without labels of both kinds every score is the share of ones (0.5 if
there are none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, slices, with_text
from .text_stats import MORE, stats

MAX_TRAIN = 20_000
#: Training ids up to so many are broadcast to the documents; MAX_TRAIN bounds them.
FOLDS = 5


@dataclass
class Trees:
    """feature and threshold: trees x inner nodes; value: trees x leaves; node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.feature):
            return np.full(len(x), self.bias)
        trees, depth = len(self.feature), int(np.log2(self.value.shape[1]))
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.bias + self.value[tree, node - (self.value.shape[1] - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, reg: float = 2.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss on binned features."""
    n, d = x.shape if len(x) else (0, len(MORE))
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    cell = binned + np.arange(d)[None, :] * bins
    f, raw = [], np.full(n, bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, bins), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (d * bins) + cell).ravel()
            sums = [np.bincount(where, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            gt, ht, nt = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
            gain[(nl < least) | (nt - nl < least)] = 0
            flat = gain.reshape(width, -1).argmax(1)
            useful = gain.reshape(width, -1).max(1) > 1e-9
            feature[first : first + width] = np.where(useful, flat // bins, 0)
            cut[first : first + width] = np.where(useful, flat % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + reg)
        raw = raw + value[leaf]
        limit = np.array([edges[j][c] if c < len(edges[j]) else np.inf for j, c in zip(feature, cut, strict=True)])
        f.append((feature, limit, value))
    return Trees(*(np.stack([t[k] for t in f]) for k in range(3)), bias)


def _features(batches, doc_id: bool = True):
    for b in slices(batches):
        rows = np.array([stats(t)[1] for t in column_of(b, "text").to_pylist()], np.float64).reshape(-1, len(MORE))
        yield b, rows


def held_out(doc_id) -> F.Column:
    """True for the rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def training_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled documents outside the held-out fold: doc_id, y."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    once = rows.groupBy("doc_id").agg(F.avg(label).alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Trees:
    texts = with_text(docs)
    rows = texts.join(F.broadcast(training_ids(labels, label, most)), "doc_id")

    def run(batches):
        for b, x in _features(batches):
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, x array<double>").toArrow()
    got = got.sort_by("doc_id")
    x = np.array(got.column("x").combine_chunks().values, np.float64).reshape(-1, len(MORE)) if got.num_rows else np.zeros((0, len(MORE)))
    return fit(x, (got.column("y").to_numpy() >= 0.5).astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, label, most)

    def run(batches):
        for b, x in _features(batches):
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = with_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """The rows that the classifier doesn't reject, with all their columns: decided where each row lies, no join."""
    spark = docs.sparkSession
    model = train(docs, labels, label, most)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([stats(t or "")[1] for t in texts], np.float64).reshape(-1, len(MORE))))

    return docs.where(score(F.col("text")) >= threshold)
