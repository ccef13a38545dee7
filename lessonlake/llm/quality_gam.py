"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features and then over a few pairs of features, add up to lookup tables over
bins; a text's score is the logistic of the sum of its bins' entries. Learnt on at most TRAIN_ROWS labelled
rows (those of least hash), of which only numeric features reach the driver.

Defined results: null and empty texts get the features of an empty text and so a score; repeated rows
are scored one by one; without labels of both kinds every score is the share of label 1 (0.5 without any).
Only doc_id and text are read, so other columns may have any name and are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.quality_rules import line_features, repeat_words

TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
RATE = 0.15
FEATURES = ("log words", "word bytes", "symbols per word", "upper share", "digit share", "exclamations per word", "distinct words", "repeated windows", "repeated lines", "worst line symbols", "sentence ends per word", "non-ASCII share", "log lines")
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def text_features(text: str | None) -> list[float]:
    text = text or ""
    b = text.encode("utf-8", "replace")
    words = b.split()
    n, size = max(len(words), 1), max(len(b), 1)
    rows, _, again = line_features(text)
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        (len(b) - len(b.translate(None, b"#*$%&|<>"))) / n,
        (len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size,
        (len(b) - len(b.translate(None, b"0123456789"))) / size,
        b.count(b"!") / n,
        len(set(words)) / n,
        repeat_words(words) / n,
        again / max(len(rows), 1),
        max((r[0] for r in rows), default=0.0),
        (b.count(b".") + b.count(b"?")) / n,
        (len(b) - len(text)) / size,
        float(np.log1p(len(rows))),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 2.0) -> np.ndarray:
    """A tree over the bins of one feature: the value of each bin."""
    out = np.full(len(grad), -grad.sum() / (hess.sum() + 1.0))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1)
        gain[(h < least / 4) | (hess.sum() - h < least / 4)] = -1
        if (k := int(gain.argmax())) is not None and gain[k] > grad.sum() ** 2 / (hess.sum() + 1) + 1e-9:
            out[: k + 1] = _tree(grad[: k + 1], hess[: k + 1], depth - 1)
            out[k + 1 :] = _tree(grad[k + 1 :], hess[k + 1 :], depth - 1)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree over a grid: the best cut along one feature, then one along the other on each side."""
    def best(axis: int) -> tuple[float, np.ndarray]:
        out, top = None, -1.0
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for k in range(1, g.shape[0]):
            value = np.vstack([np.tile(_tree(g[:k].sum(0), h[:k].sum(0), 1), (k, 1)), np.tile(_tree(g[k:].sum(0), h[k:].sum(0), 1), (g.shape[0] - k, 1))])
            gain = -(value * g).sum() - 0.5 * (value**2 * h).sum()
            if gain > top:
                out, top = value, gain
        return top, out if axis == 0 else out.T

    return max((best(0), best(1)), key=lambda x: x[0])[1]


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        self.main = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.bias = float(np.log(self.base / (1 - self.base)))
        if len(y) and 0 < y.mean() < 1:
            self._fit(self._bins(x), y)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def _coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * PAIR_BINS // len(self.main[j])

    def _fit(self, bins: np.ndarray, y: np.ndarray) -> None:
        f = np.full(len(y), self.bias)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for j, t in enumerate(self.main):
                g, h = slopes()
                step = RATE * np.clip(_tree(np.bincount(bins[:, j], g, len(t)), np.bincount(bins[:, j], h, len(t)), 2), -4, 4)
                t += step
                f += step[bins[:, j]]
        g, h = slopes()
        size = PAIR_BINS * PAIR_BINS
        cells = {(a, b): self._coarse(bins, a) * PAIR_BINS + self._coarse(bins, b) for a, b in combinations(range(len(self.main)), 2)}
        gain = {k: (np.bincount(c, g, size) ** 2 / (np.bincount(c, h, size) + 1)).sum() for k, c in cells.items()}
        for a, b in sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]:
            self.pairs.append((a, b, np.zeros(size)))
        for _ in range(ROUNDS // 6):
            for a, b, t in self.pairs:
                c = cells[a, b]
                g, h = slopes()
                shape = (PAIR_BINS, PAIR_BINS)
                step = RATE * np.clip(_pair_tree(np.bincount(c, g, size).reshape(shape), np.bincount(c, h, size).reshape(shape)), -4, 4).ravel()
                t += step
                f += step[c]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        f = np.full(len(x), self.bias)
        for j, t in enumerate(self.main):
            f += t[bins[:, j]]
        for a, b, t in self.pairs:
            f += t[self._coarse(bins, a) * PAIR_BINS + self._coarse(bins, b)]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """Fits on labelled rows that are not held out."""
    picked = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([text_features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text").mapInArrow(features, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    return Gam(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def score(documents: DataFrame, model: Gam) -> DataFrame:
    """documents(doc_id, text) -> RESULT. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([text_features(t) for t in b.column("text").to_pylist()], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, RESULT)
