"""Fingerprints, tool calls, archives, pieces, and the pipeline."""

import gzip
import hashlib
import json
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from hitweave.llm import imatch, pieces, toolcalls, warc


# ---- fingerprints


def brute_prints(rows, least=imatch.LEAST_SHARE, most=imatch.MOST_SHARE):
    import regex

    signed = lambda v: v - 2**64 if v >= 2**63 else v
    hash_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    terms = lambda t: {hash_text(w) & -2 for w in regex.split(r"[^\p{L}\p{N}]+", t.lower())}
    df = Counter(x for _, t in rows for x in terms(t))
    lex = {x for x, n in df.items() if least * len(rows) <= n <= most * len(rows)}

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
        return seed

    def fingerprint(t):
        kept = sorted(terms(t) & lex)
        if not kept:
            return f"w{hash_text(t.lower()) % 2**64:x}"
        out = []
        for bits, shift in imatch.SUBSETS:
            mask = (1 << bits) - 1
            mine = [x for x in kept if (x >> shift) & mask == mask]
            out.append(f"{f'{chain(mine):x}'[-6:]}.{len(mine)}" if mine else "-")
        return ":".join(out)

    order, out = sorted(rows, reverse=True), {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited))
    return out


def test_fingerprints_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in imatch.fingerprints(spark, docs).collect()}
    want = brute_prints([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    for i, w in want.items():
        assert (got[i]["n_chars"], got[i]["edited_sha256"], got[i]["fingerprint"], got[i]["edited_fingerprint"]) == w
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.15 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_fingerprint_cases(spark, messy, none):
    rows = imatch.fingerprints(spark, messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[0][0]["fingerprint"] == by[1][0]["fingerprint"] and by[5][0]["fingerprint"] == by[6][0]["fingerprint"] and by[8][0] == by[8][1] and None in by
    assert by[6][0]["near_next"] == 1.0
    assert imatch.fingerprints(spark, none).count() == 0
    alone = imatch.fingerprints(spark, messy.where("doc_id = 7")).first()
    assert alone["near_next"] == 1.0


# ---- tool calls


def call(i, name, **arguments):
    return "<tool_call>" + json.dumps({"name": name, "id": i, "arguments": arguments}) + "</tool_call>"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", 'hi "x"\né\u0001'), (1, 1, "assistant", "do " + call("b", "fetch", url="$a") + call("a", "search", query="q", limit=3)),
        (1, 2, "tool", json.dumps({"id": "a", "content": {"z": 1, "b": [1, 2.5, None]}})), (1, 3, "tool", '<tool_result>{"id":"b","content":"ok"}</tool_result><tool_result>{"id":"zz","content":1}</tool_result>'),
        (2, 0, "assistant", call("a", "search", limit="x") + call("c", "fetch", url="$d") + call("d", "fetch", url="$c") + "<tool_call>not json</tool_call>" + call("a", "zip")), (2, 1, "assistant", call("e", "search", query="q", more=1)), (2, 2, "assistant", call("f", "calculate", expression=7)),
        (None, None, None, None), (None, None, None, None),
    ]
    got = toolcalls.link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS message", "2 AS calls")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): (r, json.loads(r["message_json"])) for r in got}
    for r in got:
        assert list(json.loads(r["message_json"])) == ["calls", "content", "results", "role"] and ", " not in r["message_json"].replace(json.loads(r["message_json"])["content"] or "", "")
    assert by[1, 0][1]["content"] == 'hi "x"\né\u0001'
    first = by[1, 1][1]["calls"]
    assert [(c["id"], c["level"], c["problem"]) for c in first] == [("a", 0, None), ("b", 1, None)] and first[0]["result"]["content"] == {"b": [1, 2.5, None], "z": 1}
    assert by[1, 1][0]["n_linked"] == 2 and by[1, 3][0]["n_orphans"] == 1
    second = {(c["id"], c["name"]): (c["level"], c["problem"]) for c in by[2, 0][1]["calls"]}
    assert second == {("a", "search"): (0, "missing argument query"), ("c", "fetch"): (-1, None), ("d", "fetch"): (-1, None), (None, None): (0, "malformed"), ("a", "zip"): (0, "unknown tool")}
    assert by[2, 1][1]["calls"][0]["problem"] == "unknown argument more" and by[2, 2][1]["calls"][0]["problem"] == "type of argument expression"


def test_conversations_without_calls(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    got = sorted((r["conv_id"], r["turn"], r["message_json"]) for r in toolcalls.link(spark, chats).collect())
    want = sorted((r["conv_id"], r["turn"], json.dumps({"calls": [], "content": r["text"] or "", "results": [], "role": r["role"]}, ensure_ascii=False, separators=(",", ":"))) for r in chats.collect())
    assert got == want
    assert toolcalls.link(spark, chats.where("turn < 0")).count() == 0


def test_levels_of_chains_and_cycles(spark):
    """A chain of 1,200 calls, a call on both its ends, calls that refer to the two before them, and a cycle with a call behind it."""
    ref = {0: [], 1200: [0, 1199], 1300: [], 1301: [1300], 2000: [2001], 2001: [2002], 2002: [2000], 2003: [2000, 0], 2004: [2004]}
    ref |= {i: [i - 1] for i in range(1, 1200)} | {i: [i - 1, i - 2] for i in range(1302, 1312)}
    rows = [(1, i, "assistant", call(str(i), "fetch", url=[f"${k}" for k in r])) for i, r in ref.items()]
    got = {}
    for r in toolcalls.link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r["turn"]] = json.loads(r["message_json"])["calls"][0]["level"]
    assert got == {i: i for i in range(1201)} | {i: i - 1300 for i in range(1300, 1312)} | {i: -1 for i in range(2000, 2005)}


def test_marks_that_give_nothing_stay_in_the_text(spark):
    good, done = call("a", "search", query="q"), '<tool_result>{"id":"a","content":1}</tool_result>'
    kept = ['<tool_result>{"content":"no id"}</tool_result>', '<tool_result>{"id":"a", broken}</tool_result>', "<tool_call>{broken</tool_call>", '<tool_call>{"id":"x","other":5}</tool_call>', '<tool_call>{"id":"y","name":"search","arguments":"no json"}</tool_call>']
    rows = [(1, k, "assistant", f"é {x} text {good} after {done} end") for k, x in enumerate(kept)] + [(1, 9, "assistant", f"{good}{done}\n{good}"), (1, 10, "tool", '{"id":"a","content":"<tool_ of it"}')]
    got = {r["turn"]: json.loads(r["message_json"]) for r in toolcalls.link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for k, x in enumerate(kept):
        assert got[k]["content"] == f"é {x} text  after  end" and [r["id"] for r in got[k]["results"]] == ["a"] and sum(c["name"] == "search" and c["id"] == "a" for c in got[k]["calls"]) == 1
    assert got[9]["content"].strip() == "" and len(got[9]["calls"]) == 2 and got[10]["content"] == ""


def brute_links(rows):
    """calls, results and orphans of every message by plain loops over a conversation."""
    schemas = {"search": {"query": ("string", True), "limit": ("bigint", False)}, "calculate": {"expression": ("string", True)}, "fetch": {"url": ("string", True), "headers": ("object", False)}}
    kind = lambda v: {bool: "boolean", int: "bigint", float: "double", str: "string", dict: "object", list: "array", type(None): "null"}[type(v)]
    out = {}
    for conv in {r[0] for r in rows}:
        calls, results = [], []
        for _, turn, text in sorted(r for r in rows if r[0] == conv):
            for k, m in enumerate(re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text)):
                c = json.loads(m)
                calls.append({"turn": turn, "place": k, "id": c["id"], "name": c["name"], "arguments": c["arguments"]})
            for m in re.findall(r"(?s)<tool_result>(.*?)</tool_result>", text):
                results.append((turn, json.loads(m)))
        first = {}
        for c in calls:
            first.setdefault(c["id"], c)
        level, open_ = {}, list(range(len(calls)))
        refs = [[first[x] for x in set(re.findall(r'"\$([^"]+)"', json.dumps(c["arguments"]))) if x in first] for c in calls]
        while True:
            ready = [k for k in open_ if all(id(x) in level for x in refs[k])]
            if not ready:
                break
            now = {id(calls[k]): max((level[id(x)] + 1 for x in refs[k]), default=0) for k in ready}
            level |= now
            open_ = [k for k in open_ if k not in ready]
        for c in calls:
            schema = schemas.get(c["name"])
            if schema is None:
                problem = "unknown tool"
            else:
                wrong = [f"missing argument {a}" for a, (_, need) in schema.items() if need and a not in c["arguments"]]
                wrong += [f"unknown argument {a}" if a not in schema else f"type of argument {a}" for a, v in c["arguments"].items() if a not in schema or schema[a][0] != kind(v)]
                problem = min(wrong, default=None)
            if first[c["id"]] is not c and problem is None:
                problem = "repeated"
            answer = next((r["content"] for _, r in results if r["id"] == c["id"]), None) if first[c["id"]] is c else None
            out.setdefault((conv, c["turn"]), []).append((c["place"], c["id"], c["name"], level.get(id(c), -1), problem, answer))
        for turn, r in results:
            out.setdefault((conv, turn, "orphans"), []).append(r["id"] not in first)
    return out


def test_query_links_as_brute_force_does(spark, tmp_path):
    """The registered query over random chats: references, cycles, repeated identifiers, orphans, wrong arguments, ties of turn."""
    import random

    from hitweave.llm import queries

    r = random.Random(11)
    rows = []
    for conv in range(25):
        names = [f"c{i}" for i in range(r.randint(1, 12))]
        for turn in range(r.randint(1, 10)):
            text = r.choice(["", "hello ", "x" * 3000 + " "])
            for _ in range(r.randint(0, 3)):
                arguments = {a: v for a, v in [("query", r.choice(["q", f"${r.choice(names)}", 5])), ("limit", r.choice([3, "three"])), ("url", f"${r.choice(names)}"), ("expression", "1+1"), ("headers", r.choice([{}, {"a": f"${r.choice(names)}"}, [1]]))] if r.random() < 0.4}
                text += call(r.choice(names), r.choice(["search", "fetch", "calculate", "zip"]), **arguments) + " and "
            for _ in range(r.randint(0, 2)):
                text += "<tool_result>" + json.dumps({"id": r.choice([*names, "other"]), "content": r.randint(0, 99)}) + "</tool_result>"
            rows.append((conv, turn, text))
    spark.createDataFrame([(c, t, "assistant", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_links(rows)
    for got in queries.op5_tool_call_linking(spark, str(tmp_path)).collect():
        key, message = (got["conv_id"], got["turn"]), json.loads(got["message_json"])
        mine = sorted(want.get(key, []))
        calls = [(c["id"], c["name"], c["level"], c["problem"], (c["result"] or {}).get("content")) for c in message["calls"]]
        assert sorted(calls, key=str) == sorted((x[1:] for x in mine), key=str)
        order = [c["level"] if c["level"] >= 0 else 10**9 for c in message["calls"]]
        assert order == sorted(order)
        assert [x["orphan"] for x in message["results"]] == want.get((*key, "orphans"), []) and got["n_orphans"] == sum(want.get((*key, "orphans"), []))
        assert "<tool_" not in message["content"]


# ---- archives


def test_archives(spark):
    big = "".join(f"<p>é{i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(5000))
    rows = [(1, "http://a/ b", "x"), (2, "u", "x"), (9, "u", "x"), (3, None, None), (4, "u", ""), (5, "ü\n", big), (6, "u", big), (7, "u", "y"), (7, "u", "y"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS record_type")
    path = warc.shared_path(spark, "test")
    warc.write(pages, path, segment_bytes=500, chunk_bytes=77)
    got = warc.reassemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for i, u, t in rows:
        r = by[i][0]
        body = (t or "").encode()
        assert r["url"] == u and r["payload_bytes"] == len(body) and r["payload_digest"] == warc.digest(body)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body
    assert {i: (x[0]["record_type"], x[0]["refers_to"]) for i, x in by.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("revisit", 6), 6: ("response", None), 7: ("response", None), None: ("revisit", 9)}
    assert warc.round_trip(spark, pages.where("page_id < 0")).count() == 0
    least = {r["page_id"]: r["record_type"] for r in warc.round_trip(spark, pages, least_bytes=2).collect()}
    assert least[1] == "response" and least[5] == "revisit"


def test_archives_are_members_of_records(spark, tmp_path):
    """Each record is a gzip member of its own, and a reader that knows gzip alone gets them one after the other."""
    import zlib

    pages = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>" * i) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/w", segment_bytes=100, chunk_bytes=30)
    n = 0
    for f in tmp_path.glob("w/*.txt"):
        raw = f.read_bytes()
        while raw:
            opener = zlib.decompressobj(31)
            record = opener.decompress(raw)
            assert opener.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            raw, n = opener.unused_data, n + 1
    assert n == warc.read_records(spark, f"{tmp_path}/w").count() > 30


def test_a_payload_that_many_pages_hold(spark):
    """A third of all rows with one payload, null ids and repeats among them."""
    rows = [(i if i % 9 else None, f"u{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(600)] + [(1, "u", "own 1"), (None, "a", "z"), (None, "b", "z")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    want = Counter()
    ids = {}
    for i, _, t in rows:
        ids.setdefault(t, []).append(i)
    for i, _, t in rows:
        first = max((x for x in ids[t] if x is not None), default=None)
        want[i, warc.digest(t.encode()), "revisit" if first is not None and i != first else "response", first if first is not None and i != first else None] += 1
    assert Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want and all(r["problem"] is None for r in got)


def test_foreign_and_broken_archives(spark, tmp_path):
    good = b"WARC/1.0\r\nwarc-type: response\r\nno colon here\r\nCONTENT-LENGTH:5\r\nWARC-Record-ID: <a>\r\n\r\nhello\r\n\r\n"
    for name, raw in {"a": good + b"rubbish" + good, "b": good + good[:60], "c": b"nothing at all", "d": b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + good, "e": b"", "f": gzip.compress(good) + gzip.compress(good)[:30]}.items():
        (tmp_path / f"{name}.warc").write_bytes(raw)
    rows = warc.read_records(spark, str(tmp_path)).select("record_type", "block").collect()
    assert Counter(r["record_type"] for r in rows) == {"response": 5, "unreadable": 5}
    assert all(bytes(r["block"]) == b"hello" for r in rows if r["record_type"] == "response")
    problems = Counter(r["problem"] for r in warc.reassemble(warc.read_records(spark, str(tmp_path))).collect())
    assert problems == {None: 5, "no record": 5}


def test_broken_segments(spark):
    schema = warc.RECORDS
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    row = lambda o, n, total, b: (f"{o}{n}", o, n, total, "response" if n == 1 else "continuation", int(o) if n == 1 else None, None, None, None, None, bytearray(b))
    rows = [row("1", 2, len(block), block[40:]), row("1", 1, None, block[:40]), row("2", 1, None, block[:40]), row("2", 3, len(block), block[50:]), row("3", 1, None, block[:40]), row("3", 2, 5, block[40:]), row("4", 1, None, block[:60]), row("4", 2, 61, block[60:61])]
    got = {r["page_id"]: r for r in warc.reassemble(spark.createDataFrame(rows, schema)).collect()}
    assert bytes(got[1]["payload"]) == b"hello world" and "missing" in got[2]["problem"] and "length" in got[3]["problem"] and "cut off" in got[4]["problem"]
    assert warc.unchunked(warc.chunked(b"", 3)) == b"" and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


# ---- pieces


def toy():
    names = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "▁▁", "ca"]
    return pieces.Vocabulary(names, [0, -3.0, -3.1, -2.5, -4.0, -4.2, -7.5, -1.0, -3.3, -5.2, -1.5, -5.1], list(range(1, 12)), {}, 0)


def test_viterbi_equals_enumeration():
    v = toy()
    e = v.encoder()

    def best(s):
        score = [0.0] + [float("-inf")] * len(s)
        for j in range(1, len(s) + 1):
            for i in v.ordinary:
                if s[:j].endswith(v.pieces[i]):
                    score[j] = max(score[j], score[j - len(v.pieces[i])] + v.scores[i])
            if s[j - 1] not in e.single:
                score[j] = max(score[j], score[j - 1] + e.lost)
        return score[-1]

    r = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(r.choice(list("abcd  "), size=r.integers(1, 12)))
        ids = np.frombuffer(e.ids(text), np.int32)
        assert sum(v.scores[i] if i else e.lost for i in ids) == pytest.approx(best(e.marked(text)))


def test_public_vocabulary_round_trip(spark, sf):
    v = pieces.Vocabulary.load()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    encoded = pieces.encode(docs, v, batch_ids=5000)
    assert {r["doc_id"]: r["text"] for r in pieces.decode(encoded, v).collect()} == texts
    whole = v.encoder().viterbi  # in one pass, without the split into stretches
    for i in list(texts)[:15]:
        t = texts[i][:400]
        a, b = np.frombuffer(v.encoder().ids(t), np.int32), whole(v.encoder().marked(t))
        assert sum(v.scores[k] for k in a) == pytest.approx(sum(v.scores[k] for k in b)) and len(a) == len(b)


def test_piece_cases(spark, messy, none):
    rows = {r["doc_id"]: r for r in pieces.encode(messy).collect()}
    v = pieces.Vocabulary.load()
    assert rows[0]["ids"] == rows[1]["ids"] == [] and len(rows) == messy.select("doc_id").distinct().count()
    assert v.decode(rows[7]["ids"]) == "naïve café 中文 \U0001f600 İstanbul" and v.decode(rows[2]["ids"]) == "   \n " and v.decode(rows[9]["ids"]) == "x" * 5000
    assert pieces.encode(none).count() == 0


def test_query_decodes_every_text(spark, sf, messy):
    from hitweave.llm import queries

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["same"] == ("▁" not in texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].replace("▁", " ").encode()).hexdigest()
    odd = spark.createDataFrame([(0, "a▁b"), (1, None), (None, " x")], "doc_id long, text string")
    assert {r["doc_id"]: (r["same"], r["decoded_sha256"]) for r in pieces.encode(odd, batch_ids=1, decoded=True).collect()} == {0: (False, hashlib.sha256(b"a b").hexdigest()), 1: (True, hashlib.sha256(b"").hexdigest()), None: (True, hashlib.sha256(b" x").hexdigest())}


# ---- registration and pipeline


def test_oracles(spark, sf):
    from hitweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def test_pipeline(spark, sf):
    import corpus_pipeline
    from hitweave.llm import decontaminate, jaccard, pii, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    sets, kept = {i: set(jaccard.shingles(text[i]).tolist()) for i in good}, set()
    parent = {i: i for i in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(good):
        for b in sorted(good):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    kept = {i for i in good if root(i) == i}
    leaked = {r["doc_id"] for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == kept - leaked and kept & leaked
    v, model = pieces.Vocabulary.load(), pii.trained()
    for i in list(got)[:60]:
        assert v.decode(got[i]) == pii.redacted(text[i], pii.all_spans(text[i], model)[1])


def test_pipeline_cases(spark, tmp_path, messy, sf):
    """Stages over nulls, empty and very long texts, ties, repeated rows and clashing columns; then over empty tables."""
    import corpus_pipeline

    messy.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == messy.columns and kept.count() <= docs.count(), name
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).count() == messy.count() - 3
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_pieces", "ids"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_quality_stage_keeps_what_scores(spark, messy):
    from hitweave.llm import quality

    labels = spark.createDataFrame([(3, 1), (5, 0), (8, 1), (9, 0), (7, 0)], "doc_id long, quality int")
    scores = {}
    for r in quality.classify(messy, labels).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    kept = quality.keep_good(spark, messy, labels)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == messy.columns and got == Counter({i: sum(x >= 0.3 for x in s) for i, s in scores.items() if any(x >= 0.3 for x in s)})
