"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded and met by learned filters five bytes wide. A text is covered, whole, by chunks that overlap by
half; each filter is max-pooled over a chunk, and the chunk maxima are combined, by their mean and their largest,
into one probability by a logistic layer. Trained on a bounded sample of labelled texts, each taken whole, as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import holdout_col, labelled_sample, text_of

WIDTH, FILTERS, EMBED, HALF = 5, 12, 6, 128
#: Positions that one slice of a long text holds: whole half chunks, so that memory stays bounded.
SLICE = 512 * HALF
#: Labelled texts that training may take, its steps, and the line of label 1.
SAMPLE, STEPS, LINE = 3_000, 600, 0.3


def as_bytes(text: str) -> np.ndarray:
    """The text's bytes, padded with zeros to one filter width at least."""
    b = text.encode("utf-8", "replace")
    return np.frombuffer(b.ljust(WIDTH, b"\0"), dtype=np.uint8)


class ByteNet:
    """Embedding e (256, E), filters f (WIDTH, E, F) with bias c (F), output weights u (2F) with bias d."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.f = rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.c = np.zeros(FILTERS, dtype=np.float32)
        self.u = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.d = np.zeros(1, dtype=np.float32)

    def maps(self, b: np.ndarray) -> np.ndarray:
        """Filter outputs at every position: a table of filter by byte value for each place in the window."""
        n = len(b) - WIDTH + 1
        out = np.tile(self.c, (n, 1))
        for k in range(WIDTH):
            out += (self.e @ self.f[k])[b[k : k + n]]
        return out

    def pooled(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk maxima (chunks, F) after a rectifier, and the positions they are at, slice by slice."""
        tops, places = [], []
        for lo in range(0, len(b) - WIDTH + 1, SLICE):
            y = self.maps(b[lo : lo + SLICE + WIDTH - 1])
            halves = -(-len(y) // HALF)
            if len(y) < halves * HALF:
                y = np.concatenate([y, np.full((halves * HALF - len(y), FILTERS), -np.inf, dtype=y.dtype)])
            y = y.reshape(halves, HALF, FILTERS)
            at = y.argmax(axis=1)
            tops.append(np.take_along_axis(y, at[:, None], axis=1)[:, 0])
            places.append(lo + HALF * np.arange(halves)[:, None] + at)
        top, place = np.concatenate(tops), np.concatenate(places)
        if len(top) > 1:
            later = top[1:] > top[:-1]
            top, place = np.where(later, top[1:], top[:-1]), np.where(later, place[1:], place[:-1])
        return np.maximum(top, 0), place

    def maxima(self, b: np.ndarray) -> np.ndarray:
        """The chunk maxima alone."""
        tops = []
        for lo in range(0, len(b) - WIDTH + 1, SLICE):
            y = self.maps(b[lo : lo + SLICE + WIDTH - 1])
            tops.append(np.maximum.reduceat(y, np.arange(0, len(y), HALF), axis=0))
        top = np.concatenate(tops)
        return np.maximum(np.maximum(top[:-1], top[1:]) if len(top) > 1 else top, 0)

    def logit(self, chunks: np.ndarray) -> float:
        return float(np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ self.u + self.d[0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.maxima(as_bytes(text))), -30, 30))))

    def gradients(self, b: np.ndarray, label: float, weight: float) -> dict[str, np.ndarray]:
        chunks, at = self.pooled(b)
        n = len(chunks)
        best = chunks.argmax(axis=0)
        z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        err = np.float32(weight * (1 / (1 + np.exp(-np.clip(float(z @ self.u + self.d[0]), -30, 30))) - label))
        g = {"u": err * z, "d": np.array([err]), "e": np.zeros_like(self.e), "f": np.zeros_like(self.f)}
        back = np.tile(err * self.u[:FILTERS] / n, (n, 1))
        back[best, np.arange(FILTERS)] += err * self.u[FILTERS:]
        back[chunks <= 0] = 0
        g["c"] = back.sum(axis=0)
        seen = b[at[:, :, None] + np.arange(WIDTH)]  # (chunks, F, WIDTH): the bytes below each maximum
        g["f"] = np.einsum("nf,nfke->kef", back, self.e[seen])
        np.add.at(g["e"], seen, back[:, :, None, None] * self.f.transpose(2, 0, 1)[None])
        return g


def fit(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 16, seed: int = 7) -> ByteNet:
    """Train by Adam on batches with as many whole texts of either label.

    With one label only, or none, the score is that label's smoothed share for every text.
    """
    net, rng, y = ByteNet(seed), np.random.default_rng(seed), np.array(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        net.u[:] = 0
        net.d[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return net
    data = [as_bytes(t) for t in texts]
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    names = ("e", "f", "c", "u", "d")
    m = {k: np.zeros_like(getattr(net, k), dtype=np.float64) for k in names}
    v = {k: np.zeros_like(m[k]) for k in names}
    for t in range(1, steps + 1):
        total = {k: np.zeros_like(m[k]) for k in names}
        for i in np.concatenate([rng.choice(side, batch // 2) for side in sides]):
            g = net.gradients(data[i], y[i], 1 / batch)
            for k in names:
                total[k] += g[k]
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * total[k]
            v[k] = 0.999 * v[k] + 0.001 * total[k] ** 2
            step = 0.01 * (1 - 0.8 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    # Batches are balanced; the corpus is not.
    net.d += np.float32(np.log(len(sides[1]) / len(sides[0])) / 2)
    return net


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Null and empty texts are scored as zero bytes.

    Repeated rows are scored each; of columns only doc_id and text are looked at.
    """
    net = fit(*labelled_sample(docs, labels, "quality", sample))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(net.score).astype("float64")

    scored = docs.select("doc_id", holdout_col().alias("held_out"), F.pandas_udf(score, "double")(text_of()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= LINE, 1).otherwise(0))
