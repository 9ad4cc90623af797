"""Classifiers and fields: numerics against brute force, held-out accuracy, and the defined cases."""

import hashlib
import html
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

from hitweave.llm import crf, pagetext, pii, quality, toxicity


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_forward_backward_and_viterbi_equal_enumeration():
    r = np.random.default_rng(1)
    trans, start = r.normal(size=(3, 3)), r.normal(size=3)
    lengths = np.array([2, 0, 4, 1])
    scores = r.normal(size=(lengths.sum(), 3))
    got, expected, starts, log_z = crf.forward_backward(scores, lengths, trans, start)
    want, counts, total, at = np.zeros_like(scores), np.zeros((3, 3)), 0.0, 0
    for n in lengths:
        s, best = scores[at : at + n], []
        if n:
            paths = list(itertools.product(range(3), repeat=int(n)))
            value = np.array([start[p[0]] + sum(s[i, p[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
            w = np.exp(value - np.logaddexp.reduce(value))
            total += np.logaddexp.reduce(value)
            for p, v in zip(paths, w):
                for i in range(n):
                    want[at + i, p[i]] += v
                for a, b in zip(p, p[1:]):
                    counts[a, b] += v
            best = list(paths[int(value.argmax())])
        assert crf.LinearChain({}, trans, start).viterbi(s) == best
        at += n
    assert np.allclose(got, want) and np.allclose(expected, counts) and log_z == pytest.approx(total)


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in m.pairs and auc(y[2000:2300], m.score(x[2000:2300])) > 0.95
    z = m.intercept + sum(t[np.searchsorted(e, x[7, j], "right")] for j, (e, t) in enumerate(zip(m.edges, m.tables)))
    z += sum(t[np.searchsorted(m.coarse[a], x[7, a], "right"), np.searchsorted(m.coarse[b], x[7, b], "right")] for (a, b), t in m.pairs.items())
    assert m.score(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("operator, label, modulus, remainder, least", [(quality.classify, "quality", 5, 0, 0.97), (toxicity.detect, "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, operator, label, modulus, remainder, least):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r["doc_id"]: r for r in operator(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [i for i in truth if rows[i]["held_out"]]
    assert auc([truth[i] for i in held], [rows[i]["score"] for i in held]) >= least


@pytest.mark.parametrize("operator", [quality.classify, toxicity.detect])
def test_classifier_cases(spark, operator, messy, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (8, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = operator(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[8]) == 1 and by[0] == by[1] and by[3] == by[4]
    assert operator(none, labels).count() == 0
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in operator(messy, labels.where("doc_id < 0")).collect())


def test_toxic_spans_are_offsets_in_the_text():
    text = "you idiot moron are fine"
    p = np.array([0.1, 0.9, 0.8, 0.1, 0.2])
    assert [text[a:b] for a, b in toxicity.spans(text, p)] == ["idiot moron"]
    grown = "İstanbul idiot İİ moron ΑΣ Σ"  # lower-casing these texts makes them longer, or depends on what stands around a letter
    spans = toxicity.spans(grown, np.array([0.1, 0.1, 0.9, 0.1, 0.1, 0.9, 0.2, 0.2]))
    assert [grown[a:b] for a, b in spans] == ["idiot", "moron"]


# ---- personal data


def brute_base(t):
    luhn = lambda d: sum((int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9))) for i, c in enumerate(reversed(d))) % 10 == 0
    num = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(num(m[0])) <= 19 and luhn(num(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(num(m[0])) <= 15]


TRICKY = ["a@b.co@c.de x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (202) 555-0100 +12 +1((((", "é@x.yz 1.2.3", "٣.٣.٣.٣", "a.b+c@d-e.f.g.", "", "+49 30 1234567.", "9" * 3000, "1." * 2000]


def test_base_spans_equal_the_plain_patterns():
    texts = TRICKY + [r[0] or "" for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t[:80]


def test_field_finds_what_it_was_not_trained_on():
    model, wrong, total = pii.trained(), 0, 0
    for text, spans in pii.training_sentences(400, 12345):
        total += len(spans)
        wrong += len(set(spans) ^ set(model.spans(text)))
    assert wrong <= 0.05 * total


def test_field_finds_what_no_pattern_does():
    model = pii.trained()
    long = "-".join(f"ab{i}cd" for i in range(12))
    web = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbUJU1"
    want = {
        "password: hunter2": [("secret", "hunter2")], "my SSN 078-05-1120 is": [("id", "078-05-1120")], "wire to IBAN DE89 3704 0044 0532 0130 00 today": [("account", "DE89 3704 0044 0532 0130 00")],
        "please call 0171 555 0199 now": [("phone", "0171 555 0199")], "Mr. John Smith lives at 12 Elm Street.": [("person", "John Smith"), ("address", "12 Elm Street")],
        f'token = "{long}" end': [("secret", long)], f"token={web} end": [("secret", web)], "x" * 500 + " api_key: " + "a1b2" * 300: [("secret", "a1b2" * 300)],
        "the password is wrong": [], "The token was lost in 1990 and The King": [], "key words in 12 Big Cities": [], "version 1.22.3 of 2024-01-02": [],
    }
    for text, spans in want.items():
        assert [(k, text[a:b]) for k, a, b in model.spans(text)] == spans and pii.base_spans(text) == [], text[:80]


def test_field_is_linear():
    import time

    model = pii.trained()
    for unit in ("1 ", "a1", "@", "A ", "key ", "+ ", "(", "x", "12 Ab "):
        took = []
        for n in (3000, 12_000):
            start = time.perf_counter()
            model.spans(unit * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 0.5 + 8 * took[0], unit


def test_semi_markov_choice_equals_enumeration():
    model = pii.SemiMarkov({k: {"u": float(n + 1), "v": float(3 - n), "bias": -1.0} for n, k in enumerate(pii.KINDS)})
    found = [(0, 1, ("u", "bias")), (0, 3, ("u", "v", "bias")), (1, 2, ("v", "bias")), (2, 4, ("u", "bias")), (3, 4, ("v",))]
    value = lambda f: max((sum(model.weights[k].get(x, 0) for x in f), k) for k in pii.KINDS)[0]
    best = max(sum(value(f) for _, _, f in s) for n in range(4) for s in itertools.combinations(found, n) if all(a[1] <= b[0] for a, b in zip(s, s[1:])))
    got = model.best(4, found)
    assert sum(max(sum(model.weights[k].get(x, 0) for x in f) for i, j, f in found if (i, j) == (a, b)) for a, b, k in got) == best


def test_pii_cases(spark, messy, none):
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "mail a.b@c.org, ip 10.0.0.1 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"")], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert (rows[20]["n_email"], rows[20]["n_ip"], rows[20]["n_card"], rows[20]["n_phone"], rows[20]["n_added"]) == (1, 1, 0, 0, 1)
    assert rows[20]["spans"] == "email:5:14,ip:19:27,secret:37:77"
    assert rows[20]["base_sha256"] == hashlib.sha256(b"email:5:14,ip:19:27").hexdigest()
    assert rows[0]["base_sha256"] == rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["spans"] == ""
    assert pii.find(none).count() == 0
    clean = {r["doc_id"]: r for r in pii.redact(docs.withColumn("n_chars", docs.doc_id)).collect()}
    assert clean[20]["text"] == 'mail [EMAIL], ip [IP] token = "[SECRET]"' and clean[20]["n_chars"] == len(clean[20]["text"]) and clean[0]["text"] is None
    assert pii.redact(messy).columns == messy.columns


# ---- pages


def test_main_text_of_pages():
    chain, bad = pagetext.trained(), 0
    for (x,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        a = re.search(r"<article>(.*?)(</article>|$)", x, re.S)[1]
        want = "\n".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", a)) if t)
        bad += pagetext.main_text(x, chain) != want
    assert bad == 0


def test_unseen_furniture():
    chain, wrong, total = pagetext.trained(), 0, 0
    for page, main in pagetext.training_pages(150, 777):
        got = [t for t in pagetext.main_text(page, chain).split("\n") if t]
        total += len(main)
        wrong += len(set(got) ^ set(main))
    assert wrong <= 0.07 * total


def test_blocks():
    b = pagetext.leaf_blocks('<p>a &amp; <b>b</b>c<p>d<br>e<script>x < y</script><!-- q --><ul><li>f<li>g &lt</ul><td>h</table>1 < 2')
    assert [x.text for x in b] == ["a & bc", "d", "e", "f", "g <", "h", "1 < 2"]
    assert pagetext.leaf_blocks("<p class='x") == [] and pagetext.leaf_blocks("<!-- never closed") == []


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one <script src=/a/>var x = 1; alert(x);</script>two</p>", ["one two"]),
        ("<p>a</p><select><option>s<p>b</p><video><p>c", ["a", "s", "b", "c"]),
        ("<p>x <svg><title>q</title><text>z</text></svg>y <object><p>o</p></object>z</p>", ["x y z"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> be</p>", ["let x=2 be"]),
        ("<p>a <style>p{}</style>b<script>never closed <p>c", ["a b"]),
        ("<p>a<script src='x'/><p>b", ["a", "b"]),
        ("<ul><li>1<div>d</div><li>2<ul><li>3</ul><li>4</ul>", ["1", "d", "2", "3", "4"]),
        ("<p><i>a<div>b</i>c</div>d", ["a", "bc", "d"]),
    ],
)
def test_what_is_text_and_what_ends_a_block(page, want):
    assert [b.text for b in pagetext.leaf_blocks(page)] == want


def test_links_with_an_unquoted_address():
    (b,) = pagetext.leaf_blocks("<p><a href=/x/>link</a> rest</p>")
    assert b.links == 0.5


def test_reading_is_linear():
    """Pages that nest, repeat or never close: four times the page takes nowhere near sixteen times the time."""
    import time

    shapes = [lambda n: "<div>a" * n, lambda n: "<title>" * n, lambda n: "".join(f"<div class='k{i}'>a" for i in range(n)), lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<ul>" + "<div>" * n + "<li>x" * n, lambda n: "<!--" * n, lambda n: "<select>x" * n]
    chain = pagetext.trained()
    for shape in shapes:
        took = []
        for n in (4000, 16_000):
            start = time.perf_counter()
            pagetext.main_text(shape(n), chain)
            took.append(time.perf_counter() - start)
        assert took[1] < 0.3 + 8 * took[0]


def test_page_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<div class=ad>buy</div>"), (3, "u", "<div class=ad>buy</div>"), (None, None, "<article><p>" + "w " * 50000 + "</p></article>")]
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert [(r["page_id"], r["text"][:3], r["n_chars"]) for r in got[:2]] == [(1, "", 0), (2, "", 0)]
    assert got[2] == got[3] and got[4]["n_chars"] == 99999
    assert pagetext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
