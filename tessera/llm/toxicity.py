"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

A text is the hashed 4- to 6-grams of characters (code points, lower case) that it holds, each with its density:
occurrences over one and the text's thousands of characters, 1 at most, since in long texts a gram met once says
little. Features are
scaled by the log ratio of their smoothed counts in toxic and other texts, and a logistic regression is fitted on the
scaled features. It is trained on a bounded sample of labelled texts; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import holdout_col, labelled_sample, text_of

GRAMS, BITS, PER = (4, 5, 6), 20, 1_000
#: Labelled texts that training may take, and the features it keeps.
SAMPLE, FEATURES = 5_000, 2_000


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of the whole text, repeats included."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, dtype=np.uint32)
            for j in range(n):
                h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint32(16777619)
            out.append((h ^ (h >> np.uint32(15))) & np.uint32((1 << BITS) - 1))
    return np.concatenate(out) if out else np.array([], dtype=np.uint32)


def densities(text: str, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (of those in used, if given) and their densities."""
    g = grams(text)
    size = 1 + len(g) / (len(GRAMS) * PER)
    g, n = np.unique(g if used is None else g[used[g]], return_counts=True)
    return g, np.minimum(1, n / size)


class NaiveBayesLinear:
    """Weights of the scaled features, by hash, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights.astype(np.float32), intercept
        self.used = weights != 0

    def score(self, text: str) -> float:
        g, x = densities(text, self.used)
        z = self.intercept + float(self.weights[g] @ x)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[str], labels: list[int], features: int = FEATURES, rounds: int = 100, l2: float = 1e-4) -> NaiveBayesLinear:
    """Fit on labelled texts. With one label only, or none, the score is the smoothed share of label 1."""
    y = np.array(labels, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    size = 1 << BITS
    if not 0 < y.sum() < len(y):
        return NaiveBayesLinear(np.zeros(size), prior)
    one, zero, texts_with = np.zeros(size), np.zeros(size), np.zeros(size, dtype=np.int32)
    for text, label in zip(texts, labels, strict=True):
        g, x = densities(text)
        (one if label else zero)[g] += x
        texts_with[g] += 1
    p, q = (one + 0.5) / (y.sum() + 1), (zero + 0.5) / (len(y) - y.sum() + 1)
    ratio = np.log(p / q)
    # What tells the labels apart and is not met once only: the ratio weighed by how often it is met.
    worth = np.abs(p - q) * np.abs(ratio) * (texts_with >= 3)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:features])
    chosen = chosen[worth[chosen] > 0]
    slot, used = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=bool)
    slot[chosen], used[chosen] = np.arange(len(chosen)), True
    rows = [densities(t, used) for t in texts]  # once more, so that the grams of all texts are never held together
    row = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    col = slot[np.concatenate([g for g, _ in rows])]
    x = ratio[chosen][col] * np.concatenate([d for _, d in rows])
    w, b = np.zeros(len(chosen)), prior
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col] * x, minlength=len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, weights=e[row] * x, minlength=len(chosen)) + l2 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - 0.02 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size)
    weights[chosen] = w * ratio[chosen]
    return NaiveBayesLinear(weights, float(b))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Null and empty texts get the score of no n-grams.

    Repeated rows are scored each; of columns only doc_id and text are looked at.
    """
    model = fit(*labelled_sample(docs, labels, "toxic", sample))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 5 MB, whatever the corpus

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(shared.value.score).astype("float64")

    scored = docs.select("doc_id", holdout_col().alias("held_out"), F.pandas_udf(score, "double")(text_of()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
