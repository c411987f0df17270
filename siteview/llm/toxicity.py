"""Toxic spans by a linear-chain conditional random field; documents by its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, label_sample

#: Labelled documents that are learnt from, and hashed feature weights.
SAMPLE, WEIGHTS = 4000, 1 << 18
TOKEN = re.compile(r"\w+")


def _hash(name: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) & (WEIGHTS - 1)


def _stems(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["=" + word, *["^" + word[:k] for k in (4, 5, 6, 7) if len(word) > k]]


def _features(word: str) -> list[int]:
    return [_hash(x) for x in (*_stems(word), "$" + word[-3:], "#" + str(min(len(word), 12)), "")]


def _families(texts: list[str]) -> np.ndarray:
    """A number for each text, the same for near copies: texts that share a MinHash value of their 4-word shingles."""
    import xxhash

    up = list(range(len(texts)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    first: dict[tuple[int, int], int] = {}
    by = np.random.default_rng(1).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k, text in enumerate(texts):
        w = text.split()
        h = np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))], np.uint64)
        for j, m in enumerate(by):
            up[top(k)] = top(first.setdefault((j, int((h * m).min())), k))
    return np.array([top(k) for k in range(len(texts))])


def token_labels(texts: list[str], toxic: np.ndarray, purity: float = 0.97, least: int = 3) -> set[str]:
    """The stems that mark tokens of toxic training documents as toxic.

    Document labels become token labels in two steps. A stem is taken if nearly all its documents are toxic and
    they are so many that none of the stems would have as many by chance; near copies count as one document, so
    that words which merely share copies of a toxic document are not taken. Then, while toxic documents without
    a taken stem are left, the pure stem in most of them is taken, down to ``least``.
    """
    family = _families(texts)
    of: dict[str, set[int]] = {}
    clean: dict[str, set[int]] = {}
    for by, into in ((1, of), (0, clean)):
        for k, text in enumerate(texts):
            if toxic[k] == by:
                for s in {s for w in {w.lower() for w in TOKEN.findall(text)} for s in _stems(w)}:
                    if by or s in of:
                        into.setdefault(s, set()).add(int(family[k]))
        if by:
            tried = len(of)
            of = {s: d for s, d in of.items() if len(d) >= least}
    pool = {s: d for s, d in of.items() if len(d) >= purity * (len(d) + len(clean.get(s, ())))}
    groups = {int(f) for f, y in zip(family, toxic, strict=True) if y}
    share = len(groups) / max(1, len(set(family.tolist())))
    enough = np.log(0.1 / max(1, tried)) / np.log(min(max(share, 1e-6), 0.999))
    taken = {s for s, d in pool.items() if len(d) >= enough}
    left = groups - {f for s in taken for f in pool[s]}
    while pool:
        gain, best = max((len(d & left), s) for s, d in pool.items())
        if gain < least:
            break
        left -= pool.pop(best)
        taken.add(best)
        pool = {s: d for s, d in pool.items() if d & left}
    return taken


def forward_backward(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginal probability of state 1 at every token of many chains laid end to end.

    ``emit`` is the score of state 1 over state 0; ``trans`` the 2x2 transition scores. The chains advance
    together, longest first, so that each step is one operation over those that still run.
    """
    p = np.zeros(len(emit))
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(n[0]) if len(n) else 0
    running = np.searchsorted(-n, -np.arange(longest), "left")
    t = np.exp(trans)
    e = np.exp(np.clip(emit, -30, 30))
    ahead = np.empty(len(emit))  # share of state 1 in the normalised forward pair
    a1 = None
    for k in range(longest):
        m = int(running[k])
        at = starts[:m] + k
        if a1 is None:
            y1, y0 = e[at], 1.0
        else:
            x1 = a1[:m]
            y1, y0 = e[at] * ((1 - x1) * t[0, 1] + x1 * t[1, 1]), (1 - x1) * t[0, 0] + x1 * t[1, 0]
        a1 = y1 / (y1 + y0)
        ahead[at] = a1
    b1 = np.full(len(n), 0.5)
    for k in range(longest - 1, -1, -1):
        m = int(running[k])
        at = starts[:m] + k
        x, b = ahead[at], b1[:m]
        num = x * b
        p[at] = num / (num + (1 - x) * (1 - b))
        y1, y0 = b * e[at], 1 - b
        c1, c0 = t[1, 1] * y1 + t[1, 0] * y0, t[0, 1] * y1 + t[0, 0] * y0
        b1[:m] = c1 / (c1 + c0)
    return p


class Tagger:
    """Weights of token features and transitions, and the score of a word, kept once a task."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self.memo: dict[str, float] = {}

    def emission(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            w = self.weights
            got = self.memo[word] = float(sum(w[f] for f in _features(word.lower())))
        return got

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        memo, emission = self.memo, self.emission
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        emit = np.array([memo[w] if w in memo else emission(w) for ws in texts for w in ws])
        return forward_backward(emit, sizes, self.trans), sizes


def train(texts: list[str], toxic: np.ndarray, rounds: int = 30, seed: int = 5) -> Tagger:
    """Conditional log-likelihood by Adagrad over windows round all toxic tokens and two random windows a text."""
    marks = token_labels(texts, toxic)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    windows: list[tuple[list[int], list[int]]] = []
    for text, is_toxic in zip(texts, toxic, strict=True):
        words = [w.lower() for w in TOKEN.findall(text)]
        label = [int(bool(is_toxic) and any(s in marks for s in _stems(w))) for w in words]
        hits = [i for i, y in enumerate(label) if y] if is_toxic else []
        at = -1
        for i in hits:  # windows of neighbouring tokens are one
            if i > at:
                at = i + 8
                near = [k for k in hits if i <= k <= at]
                a, b = max(0, i - 8), near[-1] + 9
                windows.append(([vocabulary.setdefault(w, len(vocabulary)) for w in words[a:b]], label[a:b]))
        for i in rng.integers(0, len(words), 2).tolist() if words else []:
            a, b = max(0, i - 8), i + 9
            windows.append(([vocabulary.setdefault(w, len(vocabulary)) for w in words[a:b]], label[a:b]))
    weights, trans = np.zeros(WEIGHTS), np.zeros((2, 2))
    weights[_hash("")] = -2.0
    if not marks or not windows:
        weights[_hash("")] = -6.0
        return Tagger(weights, trans)
    feats = [_features(w) for w in vocabulary]
    flat = np.concatenate([np.array(f) for f in feats])
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    word = np.concatenate([np.array(x) for x, _ in windows])
    gold = np.concatenate([np.array(y) for _, y in windows])
    sizes = np.array([len(x) for x, _ in windows])
    first = np.zeros(len(word), bool)
    first[np.cumsum(sizes) - sizes] = True
    nxt = np.nonzero(~first)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[nxt - 1], gold[nxt]), 1)
    g2, t2 = np.full(WEIGHTS, 1e-2), np.full((2, 2), 1e-2)
    for _ in range(rounds):
        emit = np.bincount(owner, weights[flat], len(feats))[word]
        p = forward_backward(emit, sizes, trans)
        by_word = np.bincount(word, gold - p, len(feats))
        grad = np.bincount(flat, by_word[owner], WEIGHTS) - 1e-2 * weights
        # expected transitions from neighbouring marginals
        a, b = p[nxt - 1], p[nxt]
        expected = np.array([[((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum()], [(a * (1 - b)).sum(), (a * b).sum()]])
        g2 += grad**2
        weights += 0.5 * grad / np.sqrt(g2)
        tg = seen - expected
        t2 += tg**2
        trans += 0.1 * tg / np.sqrt(t2)
    return Tagger(weights, trans)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, limit: int = SAMPLE) -> Tagger:
    """Learn from at most ``limit`` labelled documents outside fold 0, half of them toxic; of equal texts one."""
    sample = label_sample(labels, "toxic", folds, limit)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(sample), "doc_id").where(F.length("text") > 0).select("label", "text").toLocalIterator()
    seen = {r["text"]: r["label"] for r in rows}
    texts = sorted(seen)
    return train(texts, np.array([seen[t] for t in texts]))


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every whole text, one row for each input row.

    The score is the largest marginal of a token, spans the code-point offsets ``start:end`` of tokens whose
    marginal reaches the threshold, comma-joined. Null and empty texts score 0. Without toxic training documents
    nothing is marked. A null id falls in fold 0; repeated labels of a document are averaged.
    """
    tagger = tagger or fit(documents, labels, folds)
    weights, trans = tagger.weights, tagger.trans
    sparse = np.nonzero(weights)[0]
    values = weights[sparse]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(WEIGHTS)
        full[sparse] = values
        own = Tagger(full, trans)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(2).to_pylist()]
                p, sizes = own.marginals([TOKEN.findall(t) for t in texts])
                ends = np.cumsum(sizes)
                score = np.zeros(len(texts))
                full_rows = sizes > 0
                if full_rows.any():
                    score[full_rows] = np.maximum.reduceat(p, (ends - sizes)[full_rows])
                spans = []
                for k, text in enumerate(texts):
                    if score[k] < threshold:
                        spans.append("")
                        continue
                    mine = p[ends[k] - sizes[k] : ends[k]] >= threshold
                    spans.append(",".join(f"{m.start()}:{m.end()}" for m, y in zip(TOKEN.finditer(text), mine, strict=False) if y))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans)], ["doc_id", "held_out", "score", "predicted", "spans"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans string")


def reject_toxic(documents: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score stays below the threshold, unchanged; null and empty texts stay."""
    tagger = fit(documents, labels, folds)
    sparse = np.nonzero(tagger.weights)[0]
    values, trans, at = tagger.weights[sparse], tagger.trans, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(WEIGHTS)
        full[sparse] = values
        own = Tagger(full, trans)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                p, sizes = own.marginals([TOKEN.findall(t or "") for t in part.column(at).to_pylist()])
                worst = np.zeros(part.num_rows)
                if len(p):
                    worst[sizes > 0] = np.maximum.reduceat(p, (np.cumsum(sizes) - sizes)[sizes > 0])
                yield part.filter(pa.array(worst < threshold))

    return documents.mapInArrow(run, documents.schema)
