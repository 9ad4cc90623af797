"""Linear-chain conditional random field over sequences of items, with vectorised forward-backward and Viterbi.

An item (a token form, a DOM block) is a bag of feature strings; its score for a state is the sum of the features' weights.
Sequences of unequal length are packed by position, longest first, so that one step serves all sequences still running.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np


def pack(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of sequences still running at each position, and where each element of the concatenated sequences lands."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    starts = np.concatenate([[0], np.cumsum(active)])[:-1]
    position = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return active, starts[position] + np.repeat(rank, lengths) if longest else np.zeros(0, np.int64)


@dataclass
class LinearChain:
    """weights: feature -> one weight a state; transitions[i, j] from state i to j; start by state."""

    weights: dict
    transitions: np.ndarray
    start: np.ndarray

    def item_score(self, features) -> np.ndarray:
        total = np.zeros(len(self.start))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """State probabilities of each element; scores and result follow the concatenated sequences."""
        return forward_backward(scores, lengths, self.transitions, self.start)[0]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best state sequence of one sequence; ties go to the lower state."""
        if not len(scores):
            return []
        best, back = self.start + scores[0], []
        for s in scores[1:]:
            through = best[:, None] + self.transitions
            back.append(through.argmax(0))
            best = through.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray):
    """Marginals, expected transition counts, expected start counts and the log partition sum."""
    k = len(start)
    active, at = pack(lengths)
    n, a = len(scores), np.exp(transitions)
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k), 0.0
    high = scores.max(1)
    e = np.empty((n, k))
    e[at] = np.exp(scores - high[:, None])
    alpha, beta, norm = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    cut = np.concatenate([[0], np.cumsum(active)])
    for t, m in enumerate(active):
        now = slice(cut[t], cut[t] + m)
        v = e[now] * (np.exp(start) if t == 0 else alpha[cut[t - 1] : cut[t - 1] + m] @ a)
        norm[now] = s = v.sum(1)
        alpha[now] = v / s[:, None]
    expected = np.zeros((k, k))
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        now, before = slice(cut[t], cut[t] + m), slice(cut[t - 1], cut[t - 1] + m)
        v = e[now] * beta[now] / norm[now][:, None]
        expected += a * (alpha[before].T @ v)
        beta[before] = v @ a.T
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return p[at], expected, p[: active[0]].sum(0), float(np.log(norm).sum() + high.sum())


def fit(sequences: list[list], labels: list[list[int]], features_of, states: int = 2, iterations: int = 40, rate: float = 0.3, ridge: float = 1e-4, weight: np.ndarray | None = None, least: int = 1) -> LinearChain:
    """Penalised maximum likelihood by full-batch Adam over sequences of hashable items; state 0 is the reference, with weights of zero.

    Features with fewer than `least` occurrences are left out; `weight` counts sequences.
    """
    forms: dict = {}
    flat = np.array([forms.setdefault(x, len(forms)) for s in sequences for x in s], np.int64)
    gold = np.array([v for s in labels for v in s], np.int64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    keep = lengths > 0
    w = np.ones(len(lengths)) if weight is None else np.asarray(weight, float)
    w, lengths = w[keep], lengths[keep]
    per_token = np.repeat(w, lengths)
    # features become numbers as they are met, so that no string is held more than once
    found: dict = {}
    numbers, sizes = array("q"), []
    for x in forms:
        before = len(numbers)
        numbers.extend(found.setdefault(f, len(found)) for f in features_of(x))
        sizes.append(len(numbers) - before)
    cols, rows = np.array(numbers, np.int64), np.repeat(np.arange(len(forms)), np.array(sizes, np.int64))
    common = np.bincount(cols, np.bincount(flat, minlength=len(forms))[rows], len(found)) >= least
    names = {f: i for i, f in enumerate(f for f, i in found.items() if common[i])}
    rows, cols = rows[common[cols]], (np.cumsum(common) - 1)[cols[common[cols]]]
    del found, numbers
    theta, trans, start = np.zeros((len(names), states)), np.zeros((states, states)), np.zeros(states)
    if not len(flat):
        return LinearChain({}, trans, start)
    gold_hot = np.zeros((len(flat), states))
    gold_hot[np.arange(len(flat)), gold] = per_token
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    inner = np.ones(len(flat), bool)
    inner[firsts] = False
    steps = np.flatnonzero(inner)
    gold_trans = np.zeros((states, states))
    np.add.at(gold_trans, (gold[steps - 1], gold[steps]), per_token[steps])
    gold_start = np.bincount(gold[firsts], w, states)
    total = per_token.sum()
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, trans, start)]
    groups = _groups(w)
    for it in range(1, iterations + 1):
        item = np.zeros((len(forms), states))
        for s in range(1, states):
            item[:, s] = np.bincount(rows, theta[cols, s], len(forms))
        p, et, es = np.zeros((len(flat), states)), np.zeros((states, states)), np.zeros(states)
        for value, members in groups:
            own = np.repeat(members, lengths)
            q, t1, s1, _ = forward_backward(item[flat[own]], lengths[members], trans, start)
            p[own] = q * value
            et += t1 * value
            es += s1 * value
        gap = gold_hot - p
        by_item = np.stack([np.bincount(flat, gap[:, s], len(forms)) for s in range(states)], 1)
        grad = np.stack([np.zeros(len(names)) if s == 0 else np.bincount(cols, by_item[rows, s], len(names)) for s in range(states)], 1)
        for x, g, m in ((theta, grad / total - ridge * theta, moments[0]), (trans, (gold_trans - et) / total - ridge * trans, moments[1]), (start, (gold_start - es) / total - ridge * start, moments[2])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**it)) / (np.sqrt(m[1] / (1 - 0.99**it)) + 1e-8)
    return LinearChain({f: theta[i] for f, i in names.items() if np.abs(theta[i]).max() > 1e-3}, trans, start)


def _groups(w: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Sequences by their weight, as masks: classes share a weight, so there are few."""
    return [(float(v), w == v) for v in np.unique(w)]
