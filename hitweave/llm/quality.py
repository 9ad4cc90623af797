"""Quality classifier: a generalised additive model with pairwise interactions (operator 6).

Every text becomes a row of surface features. Cyclic boosting visits the features in turn and adds a shallow tree over the
feature's bins to that feature's lookup table; then the strongest pairs get small two-way tables the same way. A score is a
sum of looked-up bins, taken for a whole batch at a time.

Defined cases: a null text counts as empty; an empty text gets the score of its features (all zero); repeated rows get equal
scores; without labels of both classes the score is the share of good labels, or 0.5 where there is none; columns besides
doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm.common import arrow_map, fold, labelled_sample

FEATURES = ("log_chars", "log_words", "word_length", "upper", "digit", "symbol", "stop_marks", "non_ascii", "line_breaks", "block_distinct", "block_distinct_least", "repeats", "mark_words", "bang")
#: Classes of code points: 0 other letters, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 other symbols.
_CLASS = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 4 if _s.isspace() else 3 if _s.isdigit() else 2 if _s.isupper() else 1 if _s.islower() else 0 if _s.isalpha() else 5 if _s in ".,;:?'\"-()" else 6
BLOCK = 100


def features(text: str) -> list[float]:
    """Surface features of a whole text; shares lie in 0..1."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(points, 0x24F)], minlength=7)
    tokens = text.split()
    m = max(1, len(tokens))
    letters = max(1, int(kinds[0] + kinds[1] + kinds[2]))
    shares = [len(set(b)) / len(b) for b in (tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)) if len(b) >= BLOCK or len(tokens) < BLOCK] or [0.0]
    return [
        float(np.log1p(n)), float(np.log1p(len(tokens))), min(50.0, (n - kinds[4]) / m), kinds[2] / letters, kinds[3] / n, kinds[6] / n, kinds[5] / n, float((points > 127).mean()),
        text.count("\n") / m, float(np.mean(shares)), min(shares), sum(map(eq, tokens, tokens[1:])) / m, sum(text.count(f"{c} ") for c in "$#%&*|") / m, text.count("!") / m,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features, over quantile bins."""

    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for (a, b), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step function over ordered bins with at most `leaves` values, split greedily by gain."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            at = np.arange(lo + 1, hi)
            if len(at):
                gains = _gain(cg[at] - cg[lo], ch[at] - ch[lo], ridge) + _gain(cg[hi] - cg[at], ch[hi] - ch[at], ridge) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of each of two ordered axes: a tree with four leaves, and its gain."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, at = 0.0, None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(a[i, j], a[i, -1] - a[i, j], a[-1, j] - a[i, j], a[-1, -1] - a[i, -1] - a[-1, j] + a[i, j]) for a in (cg, ch)]
            gain = sum(_gain(p, q, ridge) for p, q in zip(*parts)) - _gain(cg[-1, -1], ch[-1, -1], ridge)
            if gain > best:
                best, at = gain, (i, j, [p / (q + ridge) for p, q in zip(*parts)])
    out = np.zeros(g.shape)
    if at:
        i, j, v = at
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return out, best


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, bins: int = 32, leaves: int = 3, pairs: int = 6, pair_rounds: int = 20, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the log loss: first each feature in turn, then the pairs that gain most on what is left."""
    w = np.ones(len(y)) if weight is None else weight
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    model = AdditiveModel(intercept=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    model.edges, model.coarse = [_edges(x[:, j], bins) for j in range(d)], [_edges(x[:, j], 8) for j in range(d)]
    at = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(d)]
    small = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    grad = lambda: (w * (y - (p := 1 / (1 + np.exp(-z)))), w * np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for j in range(d):
            g, h = grad()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves, ridge)
            model.tables[j] += step
            z += step[at[j]]

    def grids(a: int, b: int):
        g, h = grad()
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = small[a] * shape[1] + small[b]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    found = sorted(((_quadrants(*grids(a, b), ridge)[1], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:pairs]
    model.pairs = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for _, a, b in found}
    for _ in range(pair_rounds):
        for a, b in model.pairs:
            step = rate * _quadrants(*grids(a, b), ridge)[0]
            model.pairs[a, b] += step
            z += step[small[a], small[b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000, max_chars: int = 40_000) -> AdditiveModel:
    """Fit on at most 2 * per_class labelled texts outside the held-out fold, weighted back to the share of each class."""
    rows, counts = labelled_sample(docs, labels, "quality", 5, 0, per_class, max_chars)
    x, y = np.array([features(t) for _, t, _ in rows]).reshape(-1, len(FEATURES)), np.array([v for _, _, v in rows], float)
    have = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.array([counts.get(int(v), 1) / have[int(v)] for v in y])
    return fit(x, y, weight / weight.mean() if len(weight) else None)


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score of every row."""

    def each(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "score": model.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES)))}

    return arrow_map(docs, each, "doc_id long, score double", "doc_id", "text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, learn(docs, labels)).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `threshold`; the text is scored where it lies, without a shuffle."""
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return docs.where(good("text") >= threshold)
