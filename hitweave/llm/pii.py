"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans (operator 9).

The field scores whole candidate spans: the make-up and grouping of their characters, checksums, the words before and after
them, and what encloses them. Its kinds go beyond the patterns: secrets of any form, national numbers, accounts, local telephone
numbers, persons and addresses. It looks at zones: words that hold a digit or @, and a few words after these or after a cue such as
"password" or "Dr"; elsewhere nothing would score. In a zone a dynamic programme over token boundaries chooses the best set of
non-overlapping spans with their types at once. A token is a whole unbroken string of word characters (joined by - + / . ~), so a
secret of any length is one; an entity has at most MOST_TOKENS tokens, so the work is linear in the text. The field is trained here, on
sentences made by rule, by penalised maximum likelihood over segmentations. Spans of the patterns always stay; the field's spans
are added where they touch none of these.

Offsets are code points, end exclusive. Defined cases: null texts count as empty, empty texts have no spans; repeated rows get
equal results, also under a null doc_id; an empty table gives an empty one; other columns are not read by `find`, and kept by
`redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.common import arrow_map

# Fixed patterns of the contract, in the order in which kinds are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only start where a run of digits does; saying so keeps long runs linear
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "id", "account", "person", "address")

#: Words after which the field looks at what follows, even where it holds no digit.
CUES = "password passwd passphrase pwd token secret key pin login ssn iban account passport name mr mrs ms dr prof signed address".split()
NUMBERED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
CUED = re.compile(rf"(?<![^\W_])(?:{'|'.join(CUES)})(?![^\W_])", re.I)
FOLLOWING = re.compile(r"(?:[^\S\n]+\S++){1,5}")
TOKEN = re.compile(r"\w+(?:[-+/.~]\w+)*+|[^\s\w]")
#: Classes of tokens in a span that can be scored: numbers in groups, single strings, names, and street addresses.
FORMS = re.compile(r"s*[dxU](?:s*[dxU]){0,8}|[lCUx]|C(?:\.?C){1,3}|d[CU]{1,3}(?:,[dCU]{1,3})?|C{1,3}d(?:,d?C{1,2})?|[lCUdx]@[lCUdx]")
MOST_TOKENS = 16
Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in s.split(".")))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def _emails(text: str) -> list[Span]:
    """Matches of EMAIL; only the run of name characters before an @ is tried, so that long texts without one cost nothing."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _NAME:
            first -= 1
        m = EMAIL.match(text, first) if first < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return out


_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if _card_ok(m[0])]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: words with a digit or @, with the words before them that belong to a number, and cues and
    such words with up to five words that follow on their line; what touches is one zone."""
    found = []
    for m in NUMBERED.finditer(text):
        start, end = m.span()
        while start >= 2 and text[start - 2] in "+(" or start >= 3 and text[start - 1] == " " and text[start - 2].isupper():
            # a sign that stands alone, or a group of capitals as in an account number
            k = start - 2
            while k and not text[k - 1].isspace() and start - k < 6:
                k -= 1
            if k and not text[k - 1].isspace():
                break
            start = k
        after = text[end : end + 1]
        if after == " " and text[end + 1 : end + 2].isupper():
            end = FOLLOWING.match(text, end).end()
        found.append((start, end))
    for m in CUED.finditer(text):
        stop = REST_OF_WORD.match(text, m.end()).end()
        more = FOLLOWING.match(text, stop)
        found.append((m.start(), more.end() if more else stop))
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


REST_OF_WORD = re.compile(r"\S*+")
WORD_BEFORE = re.compile(r"\w+")


def token_class(t: str) -> str:
    """d digits, x with a digit, U capitals, C capitalised, l other words, and the signs themselves (s for those inside numbers)."""
    if t[0].isalnum() or t[0] == "_":
        if t.isdigit():
            return "d"
        if any(c.isdigit() for c in t):
            return "x"
        return "U" if t.isupper() and len(t) > 1 else "C" if t[0].isupper() else "l"
    return "s" if t in "+()-" else t if t in "@,." else "o"


def _valid_account(s: str) -> bool:
    """The check digits of an international account number."""
    s = re.sub(r"\s", "", s).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _bucket(n: int) -> int:
    return n if n <= 4 else 4 + n.bit_length()


def left_features(text: str, a: int) -> list[str]:
    """Features of the words before a place and of the signs between."""
    found = list(WORD_BEFORE.finditer(text, max(0, a - 40), a))
    if not found:
        return []
    one = found[-1]
    gap, w = text[one.end() : a], one[0].lower()
    out = [f"left {w}"]
    if len(found) > 1:
        out.append(f"far left {found[-2][0].lower()}")
    if (sign := gap.strip()[:1]) and sign in ":=":
        out += [f"after {sign}", f"left {w} {sign}"]
    if "\n" in gap:
        out.append("starts a line")
    return out


def span_features(text: str, a: int, b: int, classes: str, left: list[str]) -> tuple[str, ...]:
    """Features of a whole span in its text; `classes` are those of its tokens, `left` the features of what stands before."""
    s, out = text[a:b], ["bias", f"class {classes if len(classes) < 6 else classes[:2] + '..'}", f"length {_bucket(b - a)}"]
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and (before.isalnum() or before in "@.%+_-#/"):
        out.append("joined before")
    if after and (after.isalnum() or after in "@%+_-/") or after == "." and text[b + 1 : b + 2].isalnum():
        out.append("joined after")
    out += left
    cue = left[0][5:] if left else ""
    d = _digits(s)
    if d:
        out.append(f"digits {min(len(d), 20)}")
        groups = [len(x) for x in re.findall("[0-9]+", s)]
        if len(groups) <= 5:
            out.append("groups " + "-".join(str(min(g, 9)) for g in groups))
        if len(d) * 2 < len(s):
            out.append("mostly no digits")
    if "@" in s:
        out.append("email" if EMAIL.fullmatch(s) else "has at")
    if len(classes) == 1:
        kinds = [bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]")]
        make_up = "".join(c for c, k in zip("aA0-", kinds) if k)
        out += [f"make-up {make_up}", f"make-up {make_up} length {_bucket(b - a)}"]
        if cue in _CUE_SET:
            out.append(f"cue, make-up {make_up}")
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
            out.append("hexadecimal")
        if before and before in "\"'`" and after == before:
            out.append("quoted")
        if IP.fullmatch(s):
            out.append("ip" if _ip_ok(s) else "ip out of range")
    if classes[0] in "sdx" and d:
        if CARD.fullmatch(s) and 16 <= len(d) <= 19:
            out.append("card" if luhn(d) else "fails checksum")
        if PHONE.fullmatch(s):
            out.append("phone" if _phone_ok(s) else "phone length")
        out += [f"begins {s[0]}" if s[0] in "+(0" else "begins otherwise"]
    if 14 <= b - a <= 42 and s[:2].isalpha():
        out.append("account checks" if _valid_account(s) else "no account")
    if classes[-1] in "CUl":
        out.append(f"last {s.split()[-1].lower()}")
    return tuple(out)


_CUE_SET = frozenset(CUES) | {"api_key", "apikey", "auth", "bearer", "credential"}


def candidates(text: str, zone: tuple[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Tokens of a zone, and the candidate spans as (first token, token after the last, features)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, *zone)]
    classes = "".join(token_class(text[a:b]) for a, b in tokens)
    found = []
    for i, (a, _) in enumerate(tokens):
        if classes[i] not in "dxUCls":
            continue
        left = None
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            c = classes[j]
            if c in "o" or j > i and "\n" in text[tokens[j - 1][1] : tokens[j][0]]:
                break
            if c in "dxUCl" and FORMS.fullmatch(classes, i, j + 1):
                if left is None:
                    left = left_features(text, a)
                found.append((i, j + 1, span_features(text, a, tokens[j][1], classes[i : j + 1], left)))
    return tokens, found


class SemiMarkov:
    """weights[kind][feature]; a token outside any span scores 0."""

    def __init__(self, weights: dict[str, dict[str, float]]):
        self.weights = weights

    def best(self, n: int, found: list) -> list[tuple[int, int, str]]:
        """Boundaries and types of the best non-overlapping spans over n tokens; ties go to the fewer spans."""
        ending: dict[int, list] = {}
        for i, j, f in found:
            for kind in KINDS:
                w = self.weights[kind]
                s = sum(w.get(x, 0.0) for x in f)
                if s > 0:  # a span that scores no more than the tokens left outside can't be in the best set
                    ending.setdefault(j, []).append((i, kind, s))
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            score[j] = score[j - 1]
            for i, kind, s in ending.get(j, ()):
                if score[i] + s > score[j]:
                    score[j], back[j] = score[i] + s, (i, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        out = []
        for zone in zones(text):
            tokens, found = candidates(text, zone)
            if found:
                out += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in self.best(len(tokens), found)]
        return out


def training_sentences(n: int = 2000, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences with spans known by construction, and look-alikes that are none."""
    r = random.Random(seed)
    pick = r.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    any_of = lambda chars, k: "".join(pick(chars) for _ in range(k))
    word = lambda: "".join(pick("abdeilmnorstuéß") for _ in range(r.randint(2, 8)))
    name = lambda: word().capitalize()
    letters, capitals = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def card(valid: bool) -> str:
        body = str(r.randint(2, 6)) + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        d = body + (last if valid else str((int(last) + r.randint(1, 9)) % 10))
        sep = pick(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def account(valid: bool) -> str:
        body = pick([digits(18), any_of(capitals, 4) + digits(14), digits(20), digits(14)])
        country = any_of(capitals, 2)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{(check if valid else check % 97 + 1):02d}{body}"
        return pick([s, " ".join(s[k : k + 4] for k in range(0, len(s), 4))])

    def password() -> str:
        k = r.randint(4, 9)
        return pick([any_of(letters, k) + digits(r.randint(1, 4)), any_of(letters + capitals + "0123456789", k + 3), any_of(letters, k).capitalize() + digits(2), any_of(letters, k) + "-" + digits(3)])

    def key() -> str:
        k = r.choice([20, 24, 32, 40, 64])
        return pick([hexes(k), any_of(letters + capitals + "0123456789", k), "-".join(any_of(letters + "0123456789", 5) for _ in range(r.randint(4, 14))), ".".join(any_of(letters + capitals + "0123456789_", k) for _ in range(3))])

    quoted = lambda s: pick(['"{}"', "'{}'", "{}"]).format(s)
    lead = {
        "secret": lambda: pick(["token", "secret", "api_key", "key", "password", "passwd", "pwd", "access token", "Password", "passphrase", "api key", "PIN", "bearer"]) + pick([" = ", "=", ": ", ":", " ", " is "]),
        "id": lambda: pick(["SSN ", "SSN: ", "ssn ", "social security number ", "social security no. ", "passport ", "passport no. ", "tax id ", "national id: "]),
        "account": lambda: pick(["IBAN ", "IBAN: ", "account ", "", "transfer to "]),
        "phone": lambda: pick(["call ", "tel ", "tel. ", "Tel: ", "phone ", "phone: ", "mobile ", "call me at ", "ring ", "fax ", ""]),
        "person": lambda: pick(["Mr. ", "Mrs. ", "Ms ", "Dr. ", "Dr ", "Mr ", "Prof. ", "Name: ", "name: ", "my name is ", "signed ", "signed, "]),
        "address": lambda: pick(["lives at ", "address: ", "Address: ", "at ", "visit ", ""]),
        "email": lambda: "", "ip": lambda: "", "card": lambda: "",
    }
    street = lambda: pick(["Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court", "Place", "Way", "Square"])
    makers = {
        "email": lambda: f"{word()}{pick(['', '.', '_'])}{digits(2)}@{word()}{pick(['', digits(1)])}.{word()}.com",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "secret": lambda: key() if r.random() < 0.6 else password(),
        "id": lambda: pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{any_of(capitals, 1)}{digits(8)}", f"{digits(3)} {digits(2)} {digits(4)}", f"{any_of(capitals, 2)}{digits(7)}"]),
        "account": lambda: account(True),
        "person": lambda: pick([f"{name()} {name()}", f"{name()} {name()}", f"{name()} {pick(capitals)}. {name()}"]),
        "address": lambda: f"{r.randint(1, pick([9, 99, 999, 9999]))} {name()} {street()}" + pick(["", "", f", {name()}"]),
    }
    local = lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)} {digits(7)}", f"0{digits(4)}/{digits(6)}", f"0{digits(3)} {digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}"])
    none = [
        lambda: digits(r.randint(1, 9)), lambda: card(False), lambda: f"{r.randint(256, 999)}.{digits(2)}.{digits(2)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{word()}@{word()}", lambda: f"{digits(1)}.{digits(2)}",
        lambda: f"{word()}{digits(22)}", lambda: hexes(40), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{name()} {digits(4)}", lambda: f"{digits(2)} {name()} {digits(4)}", lambda: f"version {digits(1)}.{digits(2)}.{digits(1)}", lambda: f"page {digits(3)}",
        lambda: f"{any_of(capitals, 2)}-{digits(4)}", lambda: f"{digits(1)} {digits(3)} {digits(3)}", lambda: f"{digits(2)} {name()} {word()}", lambda: f"{name()} {name()}", lambda: account(False).replace(" ", ""), lambda: f"the {pick(['token', 'password', 'key', 'secret', 'name', 'account', 'address', 'login', 'pin'])} {pick(['is', 'was', 'of', 'has been'])} {word()}",
        lambda: f"{pick(['key', 'token', 'secret', 'password'])} {word()} {word()}", lambda: f"{pick(['account', 'key', 'name'])} {name()}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"Dr {word()}", lambda: f"chapter {digits(2)} {name()} {name()}", lambda: f"order {digits(3)}-{digits(7)}", lambda: f"{word()}{digits(2)}", lambda: f"name {word()} {name()}",
    ]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 4)):
            text += pick([" ", " ", ". ", ", ", "\n"]) + " ".join(pick([word, word, word, name])() for _ in range(r.randint(1, 4))) + " "
            kind = pick([*KINDS, "secret", *[None] * 12])
            if kind is None:
                text += pick(none)()
                continue
            text += lead[kind]() if kind != "phone" else ""
            if kind == "phone":
                if r.random() < 0.5:
                    s = pick([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(20, 99)} {digits(3)} {digits(7)}"])
                    text += lead[kind]()
                else:
                    s = local()
                    text += lead[kind]() or "call "
            else:
                s = makers[kind]()
            shown = quoted(s) if kind == "secret" else s
            at = len(text) + shown.index(s)
            spans.append((kind, at, at + len(s)))
            text += shown
        out.append((text + pick([".", "", " " + word()]), spans))
    return out


@cache
def trained(iterations: int = 80, rate: float = 0.4, ridge: float = 0.0003) -> SemiMarkov:
    """Penalised maximum likelihood over segmentations: forward and backward sums over segments give expected features."""
    data, flat, sizes, gold_of = [], [], [], []
    names: dict[str, int] = {}
    for text, spans in training_sentences():
        gold = {(a, b): KINDS.index(k) for k, a, b in spans}
        for zone in zones(text):
            tokens, found = candidates(text, zone)
            if not found:
                continue
            data.append((len(tokens), [(i, j) for i, j, _ in found]))
            for i, j, f in found:
                flat += [names.setdefault(x, len(names)) for x in f]
                sizes.append(len(f))
                gold_of.append(gold.get((tokens[i][0], tokens[j - 1][1]), -1))
    flat, sizes, gold_of = np.array(flat), np.array(sizes), np.array(gold_of)
    common = np.bincount(flat, minlength=len(names)) >= 4  # features seen once or twice are words of single sentences
    firsts = np.cumsum(sizes) - sizes
    aims = np.zeros((len(KINDS), len(sizes)))
    aims[gold_of[gold_of >= 0], np.flatnonzero(gold_of >= 0)] = 1
    theta = np.zeros((len(KINDS), len(names)))
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, iterations + 1):
        s = np.exp(np.clip(np.add.reduceat(theta[:, flat], firsts, axis=1), -30, 30))
        mass = s.sum(0).tolist()
        share, x = np.empty(len(sizes)), 0
        for n, spans in data:
            a, b = [0.0] * (n + 1), [0.0] * (n + 1)
            a[0] = b[n] = 1.0
            by_end: list[list] = [[] for _ in range(n + 1)]
            by_start: list[list] = [[] for _ in range(n + 1)]
            for y, (i, j) in enumerate(spans, x):
                by_end[j].append((i, mass[y]))
                by_start[i].append((j, mass[y]))
            for j in range(1, n + 1):
                a[j] = a[j - 1] + sum(a[i] * m for i, m in by_end[j])
            for i in range(n - 1, -1, -1):
                b[i] = b[i + 1] + sum(m * b[j] for j, m in by_start[i])
            for y, (i, j) in enumerate(spans, x):
                share[y] = a[i] * b[j] / a[n]
            x += len(spans)
        gap = aims - s * share
        grad = np.stack([np.bincount(flat, np.repeat(g, sizes), len(names)) for g in gap]) * common
        g = grad / len(data) - ridge * theta
        one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
        theta += rate * (one / (1 - 0.9**it)) / (np.sqrt(two / (1 - 0.99**it)) + 1e-8)
    return SemiMarkov({k: {f: float(theta[i, c]) for f, c in names.items() if common[c]} for i, k in enumerate(KINDS)})


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans: these and what the field adds, by kind as listed, then by start."""
    base = base_spans(text)
    added = [s for s in model.spans(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, counts by kind of the patterns' spans, base_sha256, spans, n_added of every row."""
    model = model or trained()

    def each(ids: list, texts: list) -> dict:
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for t in texts:
            base, every = all_spans(t or "", model)
            for k in KINDS[:4]:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(every))
            out["n_added"].append(len(every) - len(base))
        return out | {"doc_id": ids}

    return arrow_map(docs, each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", "doc_id", "text")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the one that starts first goes in."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """docs with personal data in `text` replaced, and n_chars (where there is such a column) brought up to date; null texts stay null."""
    model = model or trained()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, all_spans(t, model)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
