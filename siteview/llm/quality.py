"""Quality by Bradley-Terry ranking: strengths from preference pairs, cut at a quantile of the strengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, label_sample

#: Labelled documents that are learnt from, and preference pairs drawn from them.
SAMPLE, PAIRS = 6000, 40_000
N_FEATURES = 18


def features(text: str | None) -> np.ndarray:
    """Shares and ratios of a whole text; all zero for an empty one."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()
    if not words:
        return np.zeros(N_FEATURES)
    n, w = len(body), len(words)
    c = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    plain = c[[33, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    lines = body.split(b"\n")
    repeats = sum(map(bytes.__eq__, words[1:], words))
    distinct = len(set(words))
    return np.array([
        1.0, np.log1p(w), upper / n, digit / n, (marks - plain) / w, plain / w, c[124] / w, c[33] / w, (c[35] + c[36] + c[37] + c[38] + c[42]) / w, repeats / w,
        distinct / w, np.log1p(w) * distinct / w, (n - c[32]) / w, len(set(lines)) / len(lines), upper / max(1, upper + lower), c[128:].sum() / n, np.log1p(w / len(lines)), c[46] / w,
    ])


def feature_table(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` (columns before text pass through) with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, N_FEATURES)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields[:-1])
    return documents.mapInArrow(run, f"{kinds}, x array<double>")


class Ranker:
    """strength = weights . standardised features; score = logistic of its distance from a quantile."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, at: float = 0.3):
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        self.w, self.cut, self.at = np.zeros(N_FEATURES), 0.0, at
        self.fitted = bool(len(good) and len(bad))
        if not self.fitted:
            return
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        # Newton steps on the mean logistic loss of feature differences, with a little ridge
        for _ in range(15):
            p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))
            grad = -(d * p[:, None]).mean(axis=0) + 1e-3 * self.w
            hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(N_FEATURES)
            self.w -= np.linalg.solve(hess, grad)
        s = z @ self.w
        # the quantile that leaves the share of label 0 below, moved into the middle of the gap there
        order = np.sort(s)
        share = len(bad) / len(s)
        levels = np.clip(share + np.linspace(-0.03, 0.03, 121), 0.001, 0.999)
        cuts = np.quantile(order, levels)
        right = [(s[bad] < c).mean() + (s[good] >= c).mean() for c in cuts]
        best = np.nonzero(np.array(right) >= max(right) - 1e-9)[0]
        self.cut = float(cuts[best].mean())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w - self.cut
        return 1 / (1 + np.exp(-np.clip(s, -30, 30) - np.log(self.at / (1 - self.at))))


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, limit: int = SAMPLE, at: float = 0.3) -> Ranker:
    """Learn from at most ``limit`` labelled documents outside fold 0 (those with the smallest id hashes)."""
    sample = label_sample(labels, "quality", folds, limit)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.join(F.broadcast(sample), "doc_id").select("label", "text")  # at most ``limit`` narrow rows
    rows = feature_table(known).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, N_FEATURES)
    return Ranker(x, np.array([r["label"] for r in rows]), at=at)


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole text, one row for each input row.

    Null and empty texts have all-zero features and get a score like any other. Without labels of both kinds the
    score is 0.5. A null id falls in fold 0. Repeated labels of a document are averaged.
    """
    ranker = fit(documents, labels, folds, at=threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(2).to_pylist()]).reshape(-1, N_FEATURES)
            s = ranker.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
