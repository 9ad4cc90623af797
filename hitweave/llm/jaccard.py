"""N-gram Jaccard join with Bayesian candidate pruning (operator 2).

A text is the set of its five-word shingles (lower-case words; a text of one to four words has one shingle of all of them).
Texts with equal sets are one class and are looked at once. The steps:

1. Every text gives the digest of its set and its MinHash values; copies fold into classes by a pre-aggregated count.
2. Classes that share a band key are compared within that key, on their MinHash values alone. A pair belongs to the first band
   that it shares, so no pair is looked at twice, and nothing is chained through pairs that aren't alike. A key of many classes is
   cut into parts of at most about `block` classes and `block_chars` characters, and compared part by part. Values are
   compared a few at a time; a pair is dropped once the posterior probability that its similarity reaches the threshold falls
   below `tolerance`. A task puts out the classes that have a pair left, never pairs.
3. Only texts of these classes are fetched (a bitmap of their keys spares all others the shuffle), and the pairs that were left are
   verified on their whole sets. A task returns one row a class: its links, and the least class it hangs together with.
4. Components of the verified links are the classes of near copies.

With 24 bands of 4 values a pair at the threshold of 0.8 shares none with probability 3e-6; pruning loses a pair at the threshold
with probability below `tolerance`.

Result: doc_id, class_id (least doc_id that hangs together with it), n_links (other documents whose similarity to it is at least
the threshold). Defined cases: null texts count as empty; texts without words link to nothing (class_id is their doc_id);
repeated rows link to each other; rows with a null doc_id take part in links and have the class_id of their group (null where
no row of the group has a doc_id); extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.llm.common import KeyFilter, arrow_map, materialise, words
from hitweave.operators.components import components

SHINGLE, VALUES, ROWS = 5, 96, 4
NO_ID = -(2**63)  # stands for a null doc_id where rows are fetched
_ODD = np.random.default_rng(42).integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _BASE[k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def set_digest(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty set."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(out, (_ODD[:, None] * s[None, k : k + 4096]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(seen: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among `seen` for which P(similarity >= threshold) is at least `tolerance`, from a uniform prior.

    The posterior is Beta(m + 1, seen - m + 1), and its upper tail is P(Binomial(seen + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(seen + 1):
        tail += math.comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if tail >= tolerance:
            return m
    return seen + 1


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 8) -> np.ndarray:
    """Pairs (row of a, row of b) that incremental comparison of signatures doesn't drop."""
    first = np.zeros((len(a), len(b)), np.uint8)
    for k in range(step):
        first += a[:, None, k] == b[None, :, k]
    i, j = np.nonzero(first >= least_matches(step, threshold, tolerance))
    count = first[i, j].astype(np.int64)
    for lo in range(step, VALUES, step):
        if not len(i):
            break
        for k in range(lo, lo + step):
            count += a[i, k] == b[j, k]
        keep = count >= least_matches(lo + step, threshold, tolerance)
        i, j, count = i[keep], j[keep], count[keep]
    return np.stack([i, j], 1)


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets: merged one by one, or by blocked products where pairs are dense."""
    sizes = np.array([len(s) for s in sets])
    used = np.unique(pairs)
    if len(pairs) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    row = np.repeat(np.arange(len(used)), sizes[used])
    values, col, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    order = np.argsort(col[shared], kind="stable")
    row, col = row[shared][order], col[shared][order]
    place = np.searchsorted(used, pairs)
    out, width, at = np.zeros((len(used), len(used)), np.float32), 4096, 0
    while at < len(col):
        lo = col[at]
        end = int(np.searchsorted(col, lo + width))
        block = np.zeros((len(used), width), np.float32)
        block[row[at:end], col[at:end] - lo] = 1
        out += block @ block.T
        at = end
    return out[place[:, 0], place[:, 1]].round().astype(np.int64)


def verified_pairs(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs whose sets have at least the threshold's similarity."""
    if not len(pairs):
        return pairs
    size = np.array([len(s) for s in sets])
    both = overlaps(sets, pairs)
    return pairs[both >= threshold * (size[pairs[:, 0]] + size[pairs[:, 1]] - both) - 1e-9]


def _lowest(nodes: list[int], pairs: np.ndarray) -> dict[int, int]:
    """For each position with a link, the least node it hangs together with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
    low: dict[int, int] = {}
    for x in parent:
        r = root(x)
        low[r] = min(low.get(r, nodes[x]), nodes[x])
    return {x: low[root(x)] for x in parent}


def text_digest() -> Column:
    """Digest by which rows of one doc_id are told apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def join(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 400, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, class_id, n_links of every row of docs."""
    return classed(spark, docs, threshold, tolerance, block, block_chars).select("doc_id", "class_id", "n_links")


def band_survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, band: int, threshold: float, tolerance: float) -> np.ndarray:
    """Pairs (positions) between the two sides that pruning leaves and that share no band before `band`."""
    found = []
    for lo in range(0, len(left), 512):
        part = left[lo : lo + 512]
        p = survivors(sig[part], sig[right], threshold, tolerance)
        p = np.stack([part[p[:, 0]], right[p[:, 1]]], 1)
        if same:
            p = p[p[:, 0] < p[:, 1]]
        for b in range(band):
            if not len(p):
                break
            p = p[(sig[p[:, 0], b * ROWS : (b + 1) * ROWS] != sig[p[:, 1], b * ROWS : (b + 1) * ROWS]).any(1)]
        found.append(p)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


TASK = ["band", "key", "p", "q"]


def small_survivors(sig: np.ndarray, band: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, threshold: float, tolerance: float, step: int = 8) -> np.ndarray:
    """As `band_survivors`, for many small groups of rows at once: all pairs of each group, thinned out step by step."""
    out = []
    for n in np.unique(sizes).tolist():
        i, j = np.triu_indices(n, 1)
        starts = firsts[sizes == n]
        for lo in range(0, len(starts), max(1, 200_000 // max(1, len(i)))):
            part = starts[lo : lo + max(1, 200_000 // max(1, len(i)))]
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            count = np.zeros(len(a), np.int64)
            for k in range(0, VALUES, step):
                count += (sig[a, k : k + step] == sig[b, k : k + step]).sum(1)
                keep = count >= least_matches(k + step, threshold, tolerance)
                a, b, count = a[keep], b[keep], count[keep]
            same = (sig[a].reshape(len(a), VALUES // ROWS, ROWS) == sig[b].reshape(len(a), VALUES // ROWS, ROWS)).all(2)
            own = same.argmax(1) == band[a]  # the first band that they share
            out.append(np.stack([a[own], b[own]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def task_pairs(rows: pa.Table, threshold: float, tolerance: float, small: int = 64) -> list[np.ndarray]:
    """Pairs of rows left in each task of `rows`, which are sorted by task."""
    key = [rows[c].to_numpy() for c in TASK]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
    firsts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([firsts, [rows.num_rows]]))
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(-1, VALUES)
    band, p, q, part = key[0], key[2], key[3], rows["part"].to_numpy()
    few = (sizes <= small) & (p[firsts] == q[firsts])
    out = []
    if few.any():
        pairs = small_survivors(sig, band, firsts[few], sizes[few], threshold, tolerance)
        at = np.searchsorted(firsts, pairs[:, 0], "right")
        order = np.argsort(at, kind="stable")
        out += np.split(pairs[order], np.flatnonzero(np.diff(at[order])) + 1) if len(pairs) else []
    for k in np.flatnonzero(~few).tolist():
        inside = np.arange(firsts[k], firsts[k] + sizes[k])
        left, right = (inside[part[inside] == x] for x in (p[firsts[k]], q[firsts[k]]))
        out.append(band_survivors(sig, left, right, p[firsts[k]] == q[firsts[k]], int(band[firsts[k]]), threshold, tolerance))
    return out


def by_task(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` over whole tasks, many to a call: a call for each of thousands of small groups would cost far more than the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            same = np.all([held[c].to_numpy()[1:] == held[c].to_numpy()[:-1] for c in TASK], axis=0)
            ends = np.flatnonzero(~same)
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from work(held.slice(0, cut)).to_batches()
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held).to_batches()

    return rows.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(run, schema)


def classed(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 400, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, text_digest, component (null for a text without words), class_id, n_links of every row of docs."""

    def prepare(ids: list, texts: list, digests: list) -> dict:
        nodes, sigs, sizes = [], [], []
        for t in texts:
            s = shingles(t or "")
            nodes.append(set_digest(s) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
            sizes.append(len(t or ""))
        return {"doc_id": ids, "text_digest": digests, "node": nodes, "sig": sigs, "size": sizes}

    prepared = materialise(spark, arrow_map(docs.select("doc_id", "text", text_digest().alias("text_digest")), prepare, "doc_id long, text_digest long, node long, sig binary, size long", "doc_id", "text", "text_digest"), "shingled")
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_digest").alias("digest"), F.col("size").alias("size"), F.col("sig").alias("sig"))
    classes = materialise(
        spark,
        prepared.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min(row).alias("r"))
        .select("node", "first_id", "copies", F.col("r.id").alias("row_id"), F.col("r.digest").alias("row_digest"), F.col("r.size").alias("size"), F.col("r.sig").alias("sig")),
        "classes",
    )
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(VALUES // ROWS)))
    keys = classes.select("node", "size", F.posexplode(bands).alias("band", "key"))
    groups = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("chars")).where("n > 1")
    shared = groups.select("band", "key", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / block_chars)).cast("int").alias("parts"))
    members = keys.join(shared, ["band", "key"]).select("band", "key", "parts", "node", F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int").alias("part"))
    dealt = (
        members.join(classes.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("band", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "sig")
    )

    def prune(rows: pa.Table) -> pa.Table:
        found = task_pairs(rows, threshold, tolerance)
        used = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return rows.take(pa.array(used)).select([*TASK, "part", "node"])

    left = materialise(spark, by_task(dealt, prune, "band int, key long, p int, q int, part int, node long"), "candidates")
    wanted = classes.join(left.select("node").distinct(), "node", "left_semi").select("node", "row_id", "row_digest", "copies", "sig")
    # of several rows with one id and text any will do; copies fold on the map side
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("row_id"), text_digest().alias("row_digest"), "text")
    texts = KeyFilter(wanted, ["row_id", "row_digest"]).maybe(rows).groupBy("row_id", "row_digest").agg(F.first("text").alias("text")).join(wanted, ["row_id", "row_digest"]).drop("row_id", "row_digest")

    out = pa.schema([("node", pa.int64()), ("linked", pa.int64()), ("low", pa.int64())])

    def compare(rows: pa.Table) -> pa.Table:
        nodes, copies, texts = (rows[c].to_pylist() for c in ("node", "copies", "text"))
        got: list[tuple] = []
        for pairs in task_pairs(rows, threshold, tolerance):
            used, local = np.unique(pairs, return_inverse=True)
            used = used.tolist()
            found = verified_pairs([shingles(texts[k] or "") for k in used], local.reshape(-1, 2), threshold)
            count: dict[int, int] = {}
            for i, j in found.tolist():
                count[i] = count.get(i, 0) + copies[used[j]]
                count[j] = count.get(j, 0) + copies[used[i]]
            low = _lowest([nodes[k] for k in used], found)
            got += [(nodes[used[k]], count[k], low[k]) for k in count]
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*got) if got else ([], [], []))], schema=out)

    verified = materialise(spark, by_task(left.join(texts, "node"), compare, "node long, linked long, low long"), "verified")
    near = components(spark, verified.select(F.col("node").alias("a"), F.col("low").alias("b")))
    whole = classes.select("node", "first_id", "copies").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = whole.groupBy("component").agg(F.min("first_id").alias("class_id"))
    counts = verified.groupBy("node").agg(F.sum("linked").alias("linked"))
    facts = whole.join(names, "component").join(counts, "node", "left").select("node", "component", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return prepared.select("doc_id", "text_digest", "node").join(facts, "node", "left").select(
        "doc_id", "text_digest", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_first(spark: SparkSession, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those whose group of near copies has a lesser doc_id; a repeated row stays once.

    Rows are told apart by doc_id and text: other texts under the same doc_id are judged by themselves, and of the rows of one
    doc_id whose texts are near copies one stays. Rows without doc_id have no lesser one, and all of them stay. Rows that surely
    don't leave pass by a bitmap, without a shuffle.
    """
    found = materialise(spark, classed(spark, docs, threshold), "near")
    known = found.where("doc_id is not null")
    # of the rows that have their class's doc_id, those of one text stay; two classes can have the same doc_id
    first = F.min("text_digest").over(Window.partitionBy("doc_id", "component"))
    other = known.where("doc_id = class_id and component is not null").withColumn("first", first).where("text_digest <> first")
    removed = known.where("doc_id <> class_id").select("doc_id", "text_digest").unionByName(other.select("doc_id", "text_digest")).distinct()
    repeated = known.groupBy("doc_id", "text_digest").count().where("count > 1").select("doc_id", "text_digest")
    touched = materialise(spark, removed.withColumn("gone", F.lit(True)).unionByName(repeated.join(removed, ["doc_id", "text_digest"], "left_anti").withColumn("gone", F.lit(False))), "touched")
    key = ["_id", "_digest"]
    touched = touched.withColumnsRenamed({"doc_id": "_id", "text_digest": "_digest"})
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_digest": text_digest()})
    which = KeyFilter(touched, key)
    some = which.maybe(keyed).join(touched.hint("merge"), key, "left").where("gone is null or not gone")
    stay = some.where("gone is null").select(*docs.columns)
    once = some.where("gone is not null").dropDuplicates(key).select(*docs.columns)
    return which.surely_not(keyed).select(*docs.columns).unionByName(stay).unionByName(once)
