"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification (operator 1).

Texts and items are sequences of lower-case words. A document leaks an item if some stretch of it is within `ratio` of the item's
word count in edit distance (insertions, deletions, substitutions of words).

1. Windows. A window has the length of some item. k edits leave a run of ceil((m - k) / (k + 1)) item words intact (LONGEST_RUN at
   most), so windows are laid where the text has a run of words that is a run of an item of that length, at every shift that k edits
   allow. This bounds where a leak can start; no leak is lost by it, and it names no item.
2. Embedding. The CGK random walk reads a window and copies its current word to each of 3m output places, moving on or not by a
   random bit of (word, place); windows within a few edits of an item then agree with it in most places.
3. LSH. Each repetition draws a new walk and a sample of places. Items are kept in a table by the words at these places; a window's
   words at the same places are looked up there, and the items found are its candidates. The number of repetitions is set so
   that windows at the edit limit reach `recall`, measured for each length class on edited copies of the block's own items; a
   warning says where the most repetitions stop short of it.
4. Verification. The exact edit distance of the item to the best stretch of the document near its candidates decides.

Items are taken in blocks of at most `block_chars` characters (one longer item makes a block of its own). A block is sent to the
tasks, and its results are written before the next one is read: neither driver nor tasks hold more than a block, and documents are
read once a block. Defined cases: items without words (null, empty) match nothing; an item of fewer than five words must be there
word by word; equal items each give their rows; null texts count as empty; repeated documents each give their rows; rows with a
null doc_id are looked at and give rows with a null doc_id; extra columns are not read by `find` and kept by `remove`.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import materialise, word_spans, words

LONGEST_RUN = 4
SCHEMA = "doc_id long, item_id long, start long, `end` long, distance int, item_words int"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def intact_run(m: int, k: int) -> int:
    """Words in a row of m that k edits must leave together, LONGEST_RUN at most."""
    return min(LONGEST_RUN, math.ceil((m - k) / (k + 1)))


def embed(windows: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of each row's first `lengths` words (ids of 1 and more) into `steps` places; 0 where the walk has ended."""
    r = np.random.default_rng(seed)
    odd = r.integers(0, 2**63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n, width = windows.shape
    padded = np.hstack([windows, np.zeros((n, 1), windows.dtype)]).astype(np.uint64)
    flat, base, at = padded.ravel(), np.arange(n) * (width + 1), np.zeros(n, np.int64)
    out = np.empty((n, steps), np.uint32)
    for j in range(steps):
        word = np.where(at < lengths, flat[base + np.minimum(at, width)], 0)
        out[:, j] = word
        at += (((word + np.uint64(1)) * odd[j]) >> np.uint64(63)).astype(np.int64) & (at < lengths)
    return out


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of the item to the nearest stretch of the region, with its bounds; among equals the one that ends first, then the longest."""
    n = len(region)
    places = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), places.copy()
    for i, w in enumerate(item, 1):
        swap = row[:-1] + (region != w)
        drop = row[1:] + 1
        take = np.concatenate([[i], np.minimum(swap, drop)])
        origin = np.concatenate([[0], np.where(swap <= drop, start[:-1], start[1:])])
        # an insertion adds one to the place before: the least of take - place so far, plus the place
        level = take - places
        low = np.minimum.accumulate(level)
        start = origin[np.maximum.accumulate(np.where(level == low, places, 0))]
        row = low + places
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


@dataclass
class Index:
    """Items of one block, the runs that say where windows are laid, and the LSH tables of each length."""

    ids: list
    items: list
    limits: list
    vocabulary: dict
    runs: dict
    members: dict
    sample: int
    repetitions: dict
    _tables: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def build(rows: list[tuple], ratio: float = 0.2, recall: float = 0.995, sample: int = 3, most: int = 256) -> "Index":
        kept = [(i, w) for i, t in rows if (w := words(t or ""))]
        vocabulary: dict = {}
        items = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.uint32) for _, w in kept]
        limits = [int(ratio * len(x)) for x in items]
        members: dict = {}
        for n, x in enumerate(items):
            members.setdefault(len(x), []).append(n)
        found: dict = {}
        for x, k in zip(items, limits):
            size = intact_run(len(x), k)
            for at, h in enumerate(_grams(x, size).tolist()):
                found.setdefault(size, {}).setdefault(h, set()).add((len(x), at, k))
        runs = {}
        for size, by in found.items():
            keys = np.array(sorted(by), np.uint64)
            laid = [sorted(by[int(h)]) for h in keys]
            runs[size] = (keys, np.cumsum([0] + [len(p) for p in laid]), np.array([q for p in laid for q in p], np.int64).reshape(-1, 3))
        return Index([i for i, _ in kept], items, limits, vocabulary, runs, members, sample, _repetitions(items, limits, recall, sample, most))

    def __getstate__(self):
        return {**self.__dict__, "_tables": {}}

    def encode(self, w: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, w, itertools.repeat(0)), np.uint32, len(w))

    def windows(self, doc: np.ndarray) -> dict[int, np.ndarray]:
        """First words of the windows to look at, by window length: those that a run shared with an item of that length allows."""
        spans: list[np.ndarray] = []
        known = doc > 0
        for size, (keys, firsts, laid) in self.runs.items():
            if len(doc) < size:
                continue
            all_known = known[: len(doc) - size + 1].copy()
            for s in range(1, size):
                all_known &= known[s : len(doc) - size + 1 + s]
            at = np.flatnonzero(all_known)
            if not len(at):
                continue
            h = _hash([doc[at + s] for s in range(size)])
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[k] == h
            at, k = at[same], k[same]
            n = firsts[k + 1] - firsts[k]
            which = np.repeat(firsts[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            length, offset, shift = laid[which].T
            place = np.repeat(at, n) - offset
            spans.append(np.stack([length, place - shift, place + shift + 1], 1))
        if not spans:
            return {}
        every = np.concatenate(spans)
        out = {}
        for m in np.unique(every[:, 0]).tolist():
            lo, hi = every[every[:, 0] == m, 1], every[every[:, 0] == m, 2]
            last = max(1, len(doc) - int(0.5 * m))  # a window may run over the end of the text
            depth = np.zeros(last + 1, np.int64)
            np.add.at(depth, np.clip(lo, 0, last), 1)
            np.add.at(depth, np.clip(hi, 1, last), -1)  # what would start before the text starts with it
            out[m] = np.flatnonzero(np.cumsum(depth)[:last] > 0)
        return out

    def _table(self, m: int) -> list[tuple]:
        """For each repetition the sampled places, and the items of m words in the order of their words at these places."""
        if m not in self._tables:
            rows = np.array([self.items[n] for n in self.members[m]], np.uint32)
            out = []
            for rep in range(self.repetitions[m]):
                places = (np.random.default_rng(1000 + rep).random(self.sample) * 3 * m).astype(np.int64)
                keys = _mix(embed(rows, np.full(len(rows), m), int(places.max()) + 1, rep)[:, places])
                order = np.argsort(keys, kind="stable")
                out.append((places, keys[order], np.array(self.members[m])[order]))
            self._tables[m] = out
        return self._tables[m]

    def candidates(self, docs: list[np.ndarray], found: dict[int, list[tuple[int, np.ndarray]]]) -> list[tuple[int, int, int]]:
        """Sorted distinct (doc, item, first word) whose window has, in some repetition, the item's words at all sampled places."""
        out: set[tuple[int, int, int]] = set()
        for m, laid in found.items():
            who = np.concatenate([np.full(len(s), d, np.int64) for d, s in laid])
            start = np.concatenate([s for _, s in laid])
            step = max(1, 1_000_000 // m)
            for lo in range(0, len(start), step):
                out |= self._look_up(m, docs, who[lo : lo + step], start[lo : lo + step])
        return sorted(out)

    def _look_up(self, m: int, docs: list[np.ndarray], who: np.ndarray, start: np.ndarray) -> set[tuple[int, int, int]]:
        view, lengths = np.zeros((len(start), m), np.uint32), np.empty(len(start), np.int64)
        for n, (d, s) in enumerate(zip(who.tolist(), start.tolist())):
            part = docs[d][s : s + m]
            view[n, : len(part)], lengths[n] = part, len(part)
        out: set[tuple[int, int, int]] = set()
        for rep, (places, keys, members) in enumerate(self._table(m)):
            mine = _mix(embed(view, lengths, int(places.max()) + 1, rep)[:, places])
            first, last = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for n in np.flatnonzero(last > first).tolist():
                d, s = int(who[n]), int(start[n])
                out.update((d, item, s) for item in members[first[n] : last[n]].tolist())
        return out

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """(item_id, first word, word after the last, distance, item words) of every leak in each text."""
        docs: list[np.ndarray] = []
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for d, t in enumerate(texts):
            docs.append(self.encode(words(t)))
            for m, starts in self.windows(docs[-1]).items():
                found.setdefault(m, []).append((d, starts))
        out: list[list[tuple]] = [[] for _ in texts]
        for (d, i), group in itertools.groupby(self.candidates(docs, found), key=lambda f: f[:2]):
            m, k, regions = len(self.items[i]), self.limits[i], []
            for _, _, s in group:
                lo, hi = max(0, s - 2 * k), min(len(docs[d]), s + m + 2 * k)
                if regions and lo <= regions[-1][1] - m:
                    regions[-1][1] = hi
                else:
                    regions.append([lo, hi])
            last = -1
            for lo, hi in regions:
                # several leaks may lie in one region: the best is cut out, and what lies before and behind it is looked at again
                open_, spans = [(max(lo, last), hi)], []
                while open_:
                    lo, hi = open_.pop()
                    if hi - lo < m - k:
                        continue
                    cost, a, b = best_stretch(self.items[i], docs[d][lo:hi])
                    if cost <= k:
                        spans.append((lo + a, lo + b, cost))
                        open_ += [(lo, lo + a), (lo + b, hi)]
                out[d] += [(self.ids[i], a, b, cost, m) for a, b, cost in sorted(spans)]
                last = max([last, *(b for _, b, _ in spans)])
        return out


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c, m in zip(columns, _MIX):
        h = (h ^ c.astype(np.uint64)) * m
        h ^= h >> np.uint64(29)
    return h


def _grams(x: np.ndarray, size: int) -> np.ndarray:
    return _hash([x[s : len(x) - size + 1 + s] for s in range(size)])


def _mix(words_at: np.ndarray) -> np.ndarray:
    """One key of the words at the sampled places of each row."""
    h = np.zeros(len(words_at), np.uint64)
    for c in words_at.T:
        h = (h ^ c.astype(np.uint64)) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h


def _edited(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """x after k random edits with new words, cut to the length of x as a window would be."""
    y = x.tolist()
    for _ in range(k):
        p, kind = int(r.integers(0, len(y))), int(r.integers(0, 3))
        y[p : p + (kind > 0)] = [] if kind == 1 else [1_000_000 + int(r.integers(0, 10**6))]
    return np.array(y or [0], np.uint32)[: len(x)]


def _repetitions(items: list[np.ndarray], limits: list[int], recall: float, sample: int, most: int, tried: int = 40, trials: int = 12) -> dict[int, int]:
    """For each item length, the repetitions that find windows at the edit limit with probability `recall`.

    Lengths within a fifth of each other share a class; a class is measured on edited copies of `tried` of its items.
    """
    r, out = np.random.default_rng(3), {}
    classes: dict[int, list[int]] = {}
    for n, x in enumerate(items):
        classes.setdefault(int(math.log(len(x)) / math.log(1.2)), []).append(n)
    for members in classes.values():
        pairs = [(items[n], _edited(items[n], limits[n], r)) for n in members[:tried] if limits[n]]
        reps, reached = 1, 1.0
        if pairs:
            chance = np.zeros(len(pairs))
            for n, (x, y) in enumerate(pairs):
                rows, lengths = np.stack([x, np.pad(y, (0, len(x) - len(y)))]), np.array([len(x), len(y)])
                for t in range(trials):
                    a, b = embed(rows, lengths, 3 * len(x), 500 + t)
                    chance[n] += (a == b).mean() ** sample / trials
            for reps in range(1, most + 1):
                reached = 1 - ((1 - chance) ** reps).mean()
                if reached >= recall:
                    break
            else:
                warnings.warn(f"{most} repetitions reach a recall of {reached:.4f} a window at the edit limit, short of {recall}", stacklevel=3)
        out |= {len(items[n]): reps for n in members}
    return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about `block_chars` characters, each small enough to broadcast."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, recall: float = 0.995, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, end (code points), distance, item_words of every leak."""
    out, last = None, None
    for rows in blocks(benchmark, block_chars):
        if last is not None:  # more than one block: results are written, so that the plan holds one block at most
            done = materialise(docs.sparkSession, last, "leaks")
            out = done if out is None else out.unionByName(done)
        last = _find(docs, Index.build(rows, ratio, recall))
    return last if out is None else out.unionByName(last)


def _find(docs: DataFrame, index: Index) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for i, t, leaks in zip(ids, texts, index.leaks(texts)):
                if leaks:
                    spans = word_spans(t)
                    out += [(i, item, spans[a][0], spans[b - 1][1], cost, m) for item, a, b, cost, m in leaks]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, recall: float = 0.995, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, all columns, that leak no item; texts are looked at where they lie, without a shuffle."""
    out, first = docs, True
    for rows in blocks(benchmark, block_chars):
        if not first:
            out = materialise(docs.sparkSession, out, "clean")
        out, first = out.where(_clean(Index.build(rows, ratio, recall))("text")), False
    return out


def _clean(index: Index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not x for x in index.leaks([t or "" for t in texts])], dtype=bool)

    return clean
