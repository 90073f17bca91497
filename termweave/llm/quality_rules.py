"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document's counts. Expectation-maximisation over the distinct patterns of
votes estimates, for good and for bad documents, how often each rule casts each vote; the posterior probability of
"good" under those estimates decides. The counts cover all documents; only the number of each pattern goes to the driver,
and there are at most 3 ** len(RULES) patterns, whatever the number of documents.

Defined results: null and empty texts have no words and fail the base check; repeated rows get equal results; on an empty
table the estimates stay at their priors and the result is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, persist, slices, with_text
from .text_stats import BASE, MORE, stats

#: name, figure, bad at or beyond, good at or within (a figure between them: abstain). Where bad < good, low is bad.
RULES = (
    ("symbols", "symbols", 0.20, 0.03),
    ("repeats", "repeats", 0.25, 0.05),
    ("upper", "upper", 0.45, 0.12),
    ("exclaim", "exclaim", 0.20, 0.02),
    ("pipes", "pipes", 0.20, 0.01),
    ("top_word", "top_share", 0.25, 0.12),
    ("duplicate_lines", "dup_lines", 0.35, 0.10),
    ("adjacent", "adjacent", 0.15, 0.03),
    ("marked_ends", "marked_ends", 0.30, 0.05),
)
GOOD, ABSTAIN, BAD = 2, 1, 0


def votes(figures: dict[str, float]) -> int:
    """The pattern of votes, a digit to the base of three for each rule."""
    code = 0
    for _, name, bad, good in RULES:
        x = figures[name]
        code = code * 3 + (BAD if x >= bad else GOOD if x <= good else ABSTAIN)
    return code


def unpack_votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(RULES) - 1, -1, -1)], 1).astype(int).reshape(len(codes), len(RULES))


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) as rules x classes x votes, and the share of good documents.

    Priors: a rule's vote is more often right than wrong; `strength` pseudo-documents hold for each rule and class.
    """
    v = unpack_votes(codes)
    prior = np.zeros((len(RULES), 2, 3))
    prior[:, 1], prior[:, 0] = (0.05, 0.15, 0.80), (0.35, 0.25, 0.40)
    theta, share = prior.copy(), 0.8
    total = max(counts.sum(), 1)
    post = np.zeros(len(codes))
    for _ in range(rounds):
        like = np.stack([np.log(theta[np.arange(len(RULES)), c, v]).sum(1) for c in (0, 1)], 1) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -60, 60)))
        moved = np.abs(new - post).max() if len(new) else 0.0
        post = new
        for c, weight in ((1, post * counts), (0, (1 - post) * counts)):
            for r in range(len(RULES)):
                theta[r, c] = (np.bincount(v[:, r], weight, 3) + strength * prior[r, c]) / (weight.sum() + strength)
        share = float(np.clip((post @ counts + 8) / (total + 10), 0.05, 0.99))
        if moved < 1e-9:
            break
    return post, theta, share


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and the pattern of votes of every row."""

    def run(batches):
        for b in slices(batches):
            rows = [stats(t) for t in column_of(b, "text").to_pylist()]
            cols = [pa.array([base[k] for base, _ in rows], pa.int64()) for k in range(len(BASE))]
            code = pa.array([votes(dict(zip(MORE, more, strict=True))) for _, more in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), *cols, code], ["doc_id", *BASE, "votes"])

    return with_text(docs, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "votes long"]))


def judge_quality(docs: DataFrame, least: float = 0.5, min_words: int = 20, repeat_percent: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, kept, posterior for every row."""
    spark = docs.sparkSession
    measured = persist(measure(docs, id_col, text_col), "quality-counts")
    seen = measured.groupBy("votes").agg(F.count("*").alias("n")).toPandas().sort_values("votes")
    post, _, _ = estimate(seen["votes"].to_numpy(np.int64), seen["n"].to_numpy(np.float64))
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(seen["votes"], post, strict=True)], "votes long, posterior double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    out = measured.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior", "votes")
