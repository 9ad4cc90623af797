"""Decontamination and the Jaccard join against brute force."""

import random

import numpy as np
import pytest

from hitweave.llm import decontaminate as dc
from hitweave.llm import jaccard as jc
from hitweave.llm.common import words


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j - 1] + (x != y), prev[j] + 1, row[-1] + 1))
    return row[-1]


def test_best_stretch_is_the_exact_distance():
    r = random.Random(4)
    for _ in range(60):
        item, region = np.array([r.randrange(4) for _ in range(r.randint(1, 7))]), np.array([r.randrange(4) for _ in range(r.randint(0, 12))])
        cost, a, b = dc.best_stretch(item, region)
        best = min(edit(item.tolist(), region[i:j].tolist()) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        assert cost == best == edit(item.tolist(), region[a:b].tolist())


def test_edited_passages_are_found(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 60)))) for i in range(60)]
    docs, truth = [], set()
    for i, t in items:
        w = t.split()
        for _ in range(r.randint(0, int(0.2 * len(w)))):
            p, kind = r.randrange(len(w)), r.randrange(3)
            w[p : p + (kind > 0)] = [] if kind == 1 else [r.choice(vocabulary)]
        place = r.choice(["start", "middle", "end"])
        noise = r.choices(vocabulary, k=100)
        cut = {"start": 0, "middle": 50, "end": 100}[place]
        docs.append((i, " ".join(noise[:cut] + w + noise[cut:])))
        truth.add((i, i))
    docs.append((1000, " ".join(r.choices(vocabulary, k=3000))))
    got = dc.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(g["doc_id"], g["item_id"]) for g in got}
    assert len(truth - found) <= 1 and not any(d == 1000 for d, _ in found)
    text = dict(docs)
    for g in got:
        assert edit(words(items[g["item_id"]][1]), words(text[g["doc_id"]][g["start"] : g["end"]])) == g["distance"] <= 0.2 * g["item_words"]


def test_seed_runs_lose_no_window():
    for m in range(1, 80):
        k = int(0.2 * m)
        assert 1 <= dc.intact_run(m, k) <= (m - k + k) // (k + 1) + 1


def test_decontamination_cases(spark, messy, none):
    items = spark.createDataFrame([(0, "a b c d e f"), (1, None), (2, ""), (3, "one"), (3, "one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.find(messy, items).collect())
    assert got == [(3, 3), (3, 3), (4, 3), (4, 3), (8, 0), (8, 0)]
    assert dc.find(none, items).count() == 0 and dc.find(messy, items.where("item_id < 0")).count() == 0
    kept = dc.remove(messy, items)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4
    assert sorted(r["item_id"] for r in dc.find(messy, items, block_chars=4).collect()) == [0, 0, 3, 3, 3, 3]


def brute(texts, threshold=0.8):
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} if words(t) else set() for i, t in texts}
    ids, links, low = sorted(sets), {i: 0 for i in sets}, {i: i for i in sets}
    adjacent = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    adjacent[a].add(b)
                    adjacent[b].add(a)
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for n in adjacent[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        low[i] = min(seen)
    return {i: (low[i], links[i]) for i in ids}


@pytest.mark.parametrize("block", [400, 7])
def test_join_equals_brute_force(spark, block):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for g in range(12):
        base = r.choices(vocabulary, k=r.choice([3, 6, 40, 200]))
        for _ in range(r.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(r.randint(0, max(0, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append((len(texts), " ".join(w)))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jc.join(spark, spark.createDataFrame(texts, "doc_id long, text string"), block=block).collect()}
    assert got == brute(texts)


def test_pruning_bound():
    """A pair at the threshold has fewer matches than the bound with probability below the tolerance."""
    from math import comb

    for seen in (8, 32, 96):
        m = jc.least_matches(seen, 0.8, 1e-6)
        assert sum(comb(seen, k) * 0.8**k * 0.2 ** (seen - k) for k in range(m)) < 1e-5


def test_join_cases(spark, messy, none):
    rows = jc.join(spark, messy).collect()
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None))
    assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 1), (8, 8, 1), (9, 9, 0)]
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, 0)]
    assert jc.join(spark, none).count() == 0
    kept = jc.keep_first(spark, messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 1


def test_keep_first_tells_rows_apart_by_text(spark):
    """Rows without doc_id all stay; texts under one doc_id are judged by themselves, also where one of them is a near copy."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (1, a), (1, b), (2, a), (2, c), (3, c + " more"), (None, d), (None, d), (None, a), (None, None), (4, None), (4, ""), (4, " "), (5, d), (5, d + " more")]
    kept = jc.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), (r["text"] or "")[:1]) for r in kept)
    assert got == [(-1, ""), (-1, "a"), (-1, "d"), (-1, "d"), (1, "a"), (1, "b"), (2, "c"), (4, ""), (4, " "), (5, "d")]


def test_rows_without_doc_id_have_links(spark):
    a = [f"w{i}" for i in range(100)]
    near = a[:50] + ["x"] + a[51:]
    rows = [(None, " ".join(near)), (5, " ".join(a)), (None, " ".join(f"u{i}" for i in range(90))), (None, " ".join([*(f"u{i}" for i in range(90)), "v"]))]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jc.join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", "5", 1), ("None", "5", 1), ("None", "None", 1), ("None", "None", 1)]


def test_key_filter_passes_every_key(spark):
    from hitweave.llm.common import KeyFilter

    all_rows = spark.range(20_000).selectExpr("id AS a", "id % 7 AS b", "repeat('x', 10) AS text")
    keys = all_rows.where("a % 50 = 3").select("a", "b")
    for most in (1 << 28, 1 << 15):
        f = KeyFilter(keys, ["a", "b"], most)
        maybe = {r["a"] for r in f.maybe(all_rows).collect()}
        assert {r["a"] for r in keys.collect()} <= maybe and len(maybe) < 2500
        assert f.surely_not(all_rows).count() == 20_000 - len(maybe) and f.surely_not(all_rows).columns == all_rows.columns
    assert KeyFilter(keys.limit(0), ["a", "b"]).maybe(all_rows).count() == 0


def test_edited_copy_before_an_exact_one(spark):
    item = [f"w{i}" for i in range(20)]
    edited = item[:5] + ["x"] + item[6:12] + ["y"] + item[13:]
    docs = [(0, " ".join(edited + item)), (1, " ".join(["a", "b"] + edited + ["c"] + item + edited))]
    got = dc.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["distance"]) for r in got) == [(0, 0), (0, 2), (1, 0), (1, 2), (1, 2)]
    with pytest.warns(UserWarning, match="short of 0.995"):
        dc.Index.build([(0, " ".join(f"w{i}" for i in range(500)))], 0.2, 0.995, most=1)


def test_windows_of_a_common_run_are_laid_once(spark):
    """Items that begin alike share their windows, and a leak among them is found by the table of its length."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(800)]
    items = [(i, " ".join(["which", "of", "the", "following", *r.choices(vocabulary, k=26)])) for i in range(300)]
    text = " ".join(" ".join(["which", "of", "the", "following", *r.choices(vocabulary, k=15)]) for _ in range(10)) + " " + items[17][1]
    index = dc.Index.build(items)
    laid = index.windows(index.encode(words(text)))
    assert list(laid) == [30] and len(laid[30]) <= len(words(text))
    assert [(i, d) for i, _, _, d, _ in index.leaks([text])[0]] == [(17, 0)]


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query over whole small tables, nulls and repeats among them, against all stretches of all documents."""
    from hitweave.llm import queries

    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 12)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for i in range(60):
        w = r.choices(vocabulary, k=r.randint(0, 40))
        if i % 3 == 0:
            x = words(items[i % 12][1])
            if i % 2:
                x[r.randrange(len(x))] = "new"
            w[5:5] = x
        docs.append((i if i % 11 else None, " ".join(w) if i % 13 else None))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(g["doc_id"], g["item_id"], g["start"] is not None) for g in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    want = set()
    for d, t in docs:
        w = words(t or "")
        for i, x in items:
            x = words(x or "")
            k = int(0.2 * len(x))
            if x and any(edit(x, w[a : a + n]) <= k for n in range(max(1, len(x) - k), len(x) + k + 1) for a in range(max(0, len(w) - n) + 1)):
                want.add((d, i, True))
    assert got == want


def test_small_groups_at_once_equal_one_by_one():
    r = np.random.default_rng(5)
    sizes, rows, band = np.array([2, 5, 3, 1, 5]), [], []
    for b, n in enumerate(sizes):
        base = r.integers(0, 2**32, jc.VALUES, dtype=np.uint32)
        for _ in range(n):
            own = base.copy()
            own[r.random(jc.VALUES) < 0.25] += 1
            rows.append(own)
            band.append(int(b) % 3)
    sig, band, firsts = np.array(rows), np.array(band), np.cumsum(sizes) - sizes
    got = {tuple(p) for p in jc.small_survivors(sig, band, firsts, sizes, 0.8, 1e-6).tolist()}
    want = set()
    for f, n in zip(firsts, sizes):
        at = np.arange(f, f + n)
        for i, j in jc.band_survivors(sig, at, at, True, int(band[f]), 0.8, 1e-6).tolist():
            if (sig[i].reshape(-1, 4) == sig[j].reshape(-1, 4)).all(1)[band[f]]:  # rows of a task share its band
                want.add((i, j))
    assert got == want
