"""Toxicity: a linear-chain conditional random field tags toxic spans of tokens (operator 3).

Labels are of documents, so tokens are labelled from them: a feature (a word, a prefix, a suffix) is evidence where it is in many
times the share of toxic documents than of others, and a token of a toxic document with such a feature is labelled toxic. The
field is fitted on these tokens. Forward-backward marginals of a text give its expected toxic tokens, their share, the
greatest marginal and the chance that any token is toxic; a logistic regression over these gives the document's score.
Tokens whose marginal is at least one half, joined where they adjoin, are the offending spans (code points, end exclusive).

Defined cases: null and empty texts have no tokens, no spans and the score of such features; repeated rows get equal results;
without labels of both classes every score is the share of toxic labels (0.5 without any); other columns are neither read nor
changed.
"""

from __future__ import annotations

import itertools
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm import crf
from hitweave.llm.common import arrow_map, fold, labelled_sample, word_spans, words

#: Scores of token forms kept by a Python worker; when full, the store starts anew (it's only a memory of computed values).
REMEMBERED = 200_000
#: Marginals below this are left out of a document's expected toxic tokens, lest long clean texts add up many of them.
FAINT = 0.1


def token_features(word: str) -> list[str]:
    n = len(word)
    return ["", "=" + word, *("^" + word[:k] for k in range(3, min(n, 7) + 1)), *("$" + word[-k:] for k in range(3, min(n, 6) + 1))]


@dataclass
class ToxicityModel:
    chain: crf.LinearChain
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def aggregate(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of each document from its tokens' toxic marginals."""
    out = np.zeros((len(lengths), 4))
    some = lengths > 0
    if some.any():
        firsts = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(np.where(p >= FAINT, p, 0.0), firsts)
        out[some, 0] = np.log1p(total)
        out[some, 1] = np.log1p(100 * total / (lengths[some] + 30))
        out[some, 2] = np.maximum.reduceat(p, firsts)
        out[some, 3] = 1 - np.exp(np.add.reduceat(np.log1p(-np.where(p >= FAINT, np.minimum(p, 1 - 1e-9), 0.0)), firsts))
    return out


class Tagger:
    """Marginals of token lists under a fitted chain, remembering the scores of the token forms it has met."""

    def __init__(self, chain: crf.LinearChain):
        self.chain, self.known = chain, {}
        self.toxic = {f: w[1] for f, w in chain.weights.items()}

    def _score(self, word: str) -> float:
        get = self.toxic.get
        s = self.known[word] = sum(get(f, 0.0) for f in token_features(word))
        return s

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, new = self.known, self._score
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.fromiter((known[w] if w in known else new(w) for w in itertools.chain.from_iterable(texts)), float, int(lengths.sum()))
        return self.chain.marginals(np.stack([np.zeros(len(flat)), flat], 1), lengths)[:, 1], lengths


def tokenised(texts: list[str]) -> list[list[str]]:
    """Tokens of each text, equal ones held once."""
    return [[sys.intern(w) for w in words(t)] for t in texts]


def evidence(tokens: list[list[str]], y: np.ndarray, ratio: float = 4.0, share: float = 0.01) -> set[str]:
    """Features in at least `share` of toxic texts, and in `ratio` times the share of the others."""
    least, seen = max(3, share * (y == 1).sum()), Counter()
    for t, v in zip(tokens, y):
        if v:
            seen.update({f for w in set(t) for f in token_features(w)})
    toxic = {f: c for f, c in seen.items() if c >= least}
    del seen
    other: Counter = Counter()
    for t, v in zip(tokens, y):
        if not v:
            other.update({f for w in set(t) for f in token_features(w) if f in toxic})
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    return {f for f, c in toxic.items() if c / n1 >= ratio * (other[f] + 0.5) / n0}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on at most 2 * per_class labelled texts outside the held-out fold, weighted back to the share of each class."""
    rows, counts = labelled_sample(docs, labels, "toxic", 4, 2, per_class, max_chars)
    y = np.array([v for _, _, v in rows], float)
    if len(np.unique(y)) < 2:
        total = sum(counts.values())
        return ToxicityModel(crf.LinearChain({}, np.zeros((2, 2)), np.zeros(2)), np.zeros(5), np.zeros(4), np.ones(4), counts.get(1, 0) / total if total else 0.5)
    tokens = tokenised([t for _, t, _ in rows])
    del rows
    marks = evidence(tokens, y)
    toxic_form = {w: any(f in marks for f in token_features(w)) for t in tokens for w in set(t)}
    tags = [[int(toxic_form[w]) if v else 0 for w in t] for t, v in zip(tokens, y)]
    have = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    chain = crf.fit(tokens, tags, token_features, iterations=40, rate=0.4, least=3)
    x = aggregate(*Tagger(chain).marginals(tokens))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = np.array([counts.get(int(v), 1) / have[int(v)] for v in y])
    return ToxicityModel(chain, _logistic(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, w / w.mean()), mean, scale)


def spans(text: str, p: np.ndarray) -> list[list[int]]:
    """Offsets of the runs of tokens whose marginal is at least one half, in the text as it is (tokens are of its lower case)."""
    out: list[list[int]] = []
    last = -2
    for k, ((a, b), v) in enumerate(zip(word_spans(text), p, strict=True)):
        if v >= 0.5:
            if last == k - 1:
                out[-1][1] = b
            else:
                out.append([a, b])
            last = k
    return out


def score(docs: DataFrame, model: ToxicityModel, batch_tokens: int = 200_000) -> DataFrame:
    """doc_id, score, spans (offset pairs) of every row; texts are tagged in groups of about `batch_tokens` tokens."""
    held: list[Tagger] = []

    def each(ids: list, texts: list) -> dict:
        if not held:
            held.append(Tagger(model.chain))
        scores, found = np.zeros(len(texts)), [[] for _ in texts]
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                p, lengths = held[0].marginals([t for _, t in group])
                scores[[k for k, _ in group]] = model.score(aggregate(p, lengths))
                ends = np.cumsum(lengths)
                hot = np.searchsorted(ends, np.flatnonzero(p >= 0.5), "right")
                for g in np.unique(hot):
                    found[group[g][0]] = spans(texts[group[g][0]], p[ends[g] - lengths[g] : ends[g]])
            group, size = [], 0

        for k, t in enumerate(texts):
            group.append((k, words(t or "")))
            size += len(group[-1][1])
            if size >= batch_tokens:
                flush()
        flush()
        return {"doc_id": ids, "score": scores, "spans": found}

    return arrow_map(docs, each, "doc_id long, score double, spans array<array<int>>", "doc_id", "text")


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document."""
    return score(docs, learn(docs, labels)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
