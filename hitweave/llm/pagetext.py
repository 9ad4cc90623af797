"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page (operator 10).

A page is read once into leaf blocks: text between block tags, with its ancestors' tags, class and id words, and the share of
link text. The field labels each block as main text or not from ancestor and text features, and Viterbi takes the best
labelling of the page. It is trained here on pages made by rule, whose labels are known.

Within a block character references are decoded and white space becomes one space; blocks are joined by one line break. A
line-break tag ends a block; scripts, styles and embedded objects are left out without ending one, and formulas are text. Reading
takes time and memory in proportion to the page, however its tags are nested.

Defined cases: a null or empty page, or one without main text, gives an empty text; unclosed tags and pages cut short are read as
far as they go: a start tag whose content is never text, and which isn't closed on the page, is passed over (of scripts and styles
the rest of the page is content); repeated rows get equal results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from hitweave.llm import crf
from hitweave.llm.common import arrow_map

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A slash that ends a tag, and isn't part of an attribute's unquoted value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"']|^[^=]*)/$|[\s\"'][^\s=\"']*/$")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mspace mstyle semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; the first ones are raw text, and go on to the page's end if they aren't closed.
RAW = frozenset("script style".split())
UNSEEN = RAW | frozenset("template noscript iframe svg object canvas audio video head title textarea select annotation annotation-xml".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol table dl select".split())
CUES = frozenset("cookie cookies consent subscribe newsletter login register share comment comments reply copyright rights reserved privacy terms advertisement sponsored menu home search related".split())


@dataclass
class Block:
    """A leaf block: its text, its innermost block tag, the distinct tags and names around it, and the share of link text."""

    text: str
    own: str
    tags: frozenset
    names: frozenset
    links: float


def _names(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    return frozenset(p.lower() for m in ATTRIBUTE.finditer(attributes) for p in NAME_PART.findall(m[1] or m[2] or m[3] or ""))


class _Open:
    """The open elements, with what blocks and closing rules ask of them kept up to date, so that no question scans the stack.

    Of class and id words only those in `known` (if given) are kept: a page can have any number of others. `ANY` stands for these.
    """

    ANY = "*"

    def __init__(self, known: frozenset | None):
        self.known = known
        self.stack: list[tuple[str, frozenset]] = []
        self.where: dict[str, list[int]] = {}
        self.names: dict[str, int] = {}
        self.blocks: list[int] = []
        self.lists: list[int] = []
        self._around: tuple[str, frozenset, frozenset] | None = None

    def push(self, tag: str, names: frozenset) -> None:
        if names and self.known is not None:
            names = (names & self.known) or frozenset((self.ANY,))
        place = len(self.stack)
        self.stack.append((tag, names))
        self.where.setdefault(tag, []).append(place)
        for x in names:
            self.names[x] = self.names.get(x, 0) + 1
        if tag not in INLINE:
            self.blocks.append(place)
        if tag in LISTS:
            self.lists.append(place)
        self._around = None

    def cut(self, place: int) -> None:
        """Close the element at `place` and all above it."""
        while len(self.stack) > place:
            tag, names = self.stack.pop()
            self.where[tag].pop()
            if not self.where[tag]:
                del self.where[tag]
            for x in names:
                self.names[x] -= 1
                if not self.names[x]:
                    del self.names[x]
            if tag not in INLINE:
                self.blocks.pop()
            if tag in LISTS:
                self.lists.pop()
        self._around = None

    def close(self, tag: str) -> None:
        """An end tag: an inline one reaches no further than the innermost block."""
        if tag in self.where:
            place = self.where[tag][-1]
            if tag not in INLINE or not self.blocks or self.blocks[-1] < place:
                self.cut(place)

    def make_room(self, tag: str) -> None:
        """What the start tag of a block closes: an open paragraph, and items or cells of the same list."""
        if "p" in self.where:
            self.cut(self.where["p"][-1])
        least = self.lists[-1] if self.lists else -1
        open_ = [w[bisect.bisect(w, least)] for t in CLOSES.get(tag, ()) if (w := self.where.get(t)) and w[-1] > least]
        if open_:
            self.cut(min(open_))

    def around(self) -> tuple[str, frozenset, frozenset]:
        if self._around is None:
            own = self.stack[self.blocks[-1]][0] if self.blocks else "none"
            self._around = own, frozenset(t for t in self.where if t not in INLINE), frozenset(self.names)
        return self._around


def leaf_blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    here = _Open(known)
    buffer: list[str] = []
    linked = total = 0
    at, n = 0, len(page)
    never: set[str] = set()  # tags that aren't closed, and marks that aren't there, from here to the end of the page

    def flush() -> None:
        nonlocal linked, total
        text = " ".join("".join(buffer).split())
        if text:
            out.append(Block(text, *here.around(), linked / max(1, total)))
        buffer.clear()
        linked = total = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        piece = entities.unescape(raw)
        buffer.append(piece)
        size = len(piece.strip())
        total += size
        linked += size * ("a" in here.where)

    def after(mark: str, start: int) -> int:
        """The place after the next `mark`, or -1."""
        end = -1 if mark in never else page.find(mark, start)
        if end < 0:
            never.add(mark)
            return -1
        return end + len(mark)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = TAG.match(page, lt) if ">" not in never else None
        if not m:
            if page.startswith("<!--", lt):
                end = after("-->", lt + 4)
                at = n if end < 0 else end
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") or page[lt + 1 : lt + 2].isalpha():
                end = after(">", lt)
                at = n if end < 0 else end
            else:
                say("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag not in INLINE and tag not in UNSEEN:
                flush()
            here.close(tag)
            continue
        self_closed = m[3].endswith("/") and bool(SELF_CLOSED.search(m[3]))
        if tag in UNSEEN:
            if self_closed and tag not in RAW:
                continue
            end = None if tag in never else _END[tag].search(page, at)
            if end:
                at = end.end()
            else:
                never.add(tag)
                if tag in RAW and not self_closed:
                    at = n
            continue
        if tag not in INLINE:
            flush()
            if tag not in VOID:
                here.make_room(tag)
        if tag not in VOID and not self_closed:
            here.push(tag, _names(m[3]))
    flush()
    return out


_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in UNSEEN}


def block_features(b: Block) -> tuple[str, ...]:
    """Ancestor tags and names, and the look of the text."""
    w = b.text.split()
    low = {x.strip(".,:;!?()").lower() for x in w} if len(w) <= 40 else ()
    out = {"", f"own {b.own}", f"words {min(7, len(w).bit_length())}", f"links {min(3, int(b.links * 4))}"}
    out.update(f"in {t}" for t in b.tags)
    out.update(f"name {x}" for x in b.names if x != _Open.ANY)
    out.update(f"cue {c}" for c in CUES if c in low)
    if "article" not in b.tags and "main" not in b.tags:
        out.update(("outside", f"outside, own {b.own}", f"outside, words {min(7, len(w).bit_length())}"))
    if not b.names:
        out.add("no names")
    if b.text[-1] in ".!?\"”»":
        out.add("ends a sentence")
    if "©" in b.text:
        out.add("copyright sign")
    return tuple(sorted(out))


def training_pages(n: int = 900, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages made by rule with the texts of their main blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeghilmnorstuvw") for _ in range(r.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["", "", ".", "!"])
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>"
    cue = lambda *c: f"{say(0, 4)} {r.choice(c)} {say(1, 6)}" if r.random() < 0.5 else say(2, 14)
    para = lambda *c: f"<p>{cue(*c)}</p>" if r.random() < 0.6 else cue(*c)

    def box(tag_choices: list[str], names: list[str], inner: str) -> str:
        tag = r.choice(tag_choices)
        attr = f' {r.choice(["class", "id"])}="{r.choice(names)}"' if tag in ("div", "section", "ul", "p") or r.random() < 0.4 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    furniture = [
        lambda: box(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "navigation", "pagination", "toc"], links()),
        lambda: box(["header", "header", "div"], ["header", "masthead", "site-header", "top-bar", "branding", "logo"], r.choice([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", say(1, 5)]) + r.choice(["", links()])),
        lambda: box(["footer", "footer", "div"], ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"], r.choice(["&copy; ", "", "Copyright "]) + say(2, 18) + r.choice(["", links(), f"<p>{say(3, 12)}</p>"])),
        lambda: box(["aside", "aside", "div", "section"], ["sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "tags", "rail", "author-box", "bio"], r.choice(["", f"<h3>{say(1, 4)}</h3>"]) + r.choice([links(), para("related"), f"<p>{say(5, 30)}</p>" * 2])),
        lambda: box(["div", "div", "section", "p"], ["notice", "cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "alert", "popup", "modal", "banner", "warning", "disclaimer", "paywall", "announcement", "message", "overlay"], para("cookies", "consent", "privacy") + r.choice(["", "<button>Ok</button>"])),
        lambda: box(["div", "div", "section", "ins", "p"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "adsense", "ad-slot", "banner-ad", "commercial"], para("sponsored", "advertisement")),
        lambda: box(["form", "form", "div"], ["newsletter", "subscribe", "signup", "search", "login", "contact-form", "form"], f"<label>{cue('subscribe', 'search', 'login', 'newsletter')}</label><input type=text><button>{say(1, 2)}</button>" + r.choice(["", f"<p>{say(3, 15)}</p>"])),
        lambda: box(["div", "section", "ol", "ul"], ["comments", "comment-list", "discussion", "responses", "reader-comments", "disqus", "replies", "feedback"], r.choice(["", f"<h3>{r.choice(['Comments', say(1, 3)])}</h3>"]) + "".join(r.choice([f'<div class="comment"><b>{word()}</b><p>{say(3, 40)}</p></div>', f'<article class="comment"><p>{say(4, 40)}</p></article>', f"<li>{say(3, 30)}</li>", f"<p>{say(4, 40)}</p>"]) for _ in range(r.randint(1, 4)))),
        lambda: box(["div", "ul"], ["share", "social", "sharing", "share-buttons", "follow"], links()),
    ]
    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(" ".join(text.split()))
            return text

        def body() -> str:
            parts = [f"<h1>{keep(say(2, 12))}</h1>"] if r.random() < 0.8 else []
            if parts and r.random() < 0.2:
                parts = [f"<header>{parts[0]}<p class=\"{r.choice(['byline', 'meta', 'date', 'author'])}\">{say(2, 6)}</p></header>"]
            for _ in range(r.randint(1, 9)):
                x = r.random()
                if x < 0.62:
                    parts.append(f"<p>{keep(say(r.choice([1, 5, 20]), r.choice([20, 60, 120])))}</p>")
                elif x < 0.68:
                    parts.append(f"<p><b>{keep(say(4, 50))}<br>")
                elif x < 0.74:
                    parts.append(f"<h2>{keep(say(1, 7))}</h2>")
                elif x < 0.79:
                    parts.append("<ul>" + "".join(f"<li>{keep(say(1, 18))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
                elif x < 0.83:
                    parts.append(f"<blockquote><p>{keep(say(5, 40))}</p></blockquote>")
                elif x < 0.86:
                    first, link = say(3, 10), word()
                    keep(f"{first} {link}")
                    parts.append(f"<p>{first} <a href=/x>{link}</a></p>")
                elif x < 0.89:
                    parts.append("<table><tr>" + "".join(f"<td>{keep(say(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
                else:
                    parts.append(r.choice(furniture[3:])())
            if r.random() < 0.15:
                parts.append(r.choice(furniture[2:])())
            return "".join(parts)

        before = "".join(r.choice(furniture[:7])() for _ in range(r.randint(0, 4)))
        kind = r.random()
        text = body()
        if kind < 0.55:
            middle = f"<article>{text}</article>"
        elif kind < 0.65:
            middle = f"<main>{text}</main>"
        elif kind < 0.92:
            names = ["content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "text", "article"]
            middle = f'<div {r.choice(["class", "id"])}="{r.choice(names)}">{text}</div>'
        else:
            middle = f"<div>{text}</div>"
        after = "".join(r.choice(furniture)() for _ in range(r.randint(0, 4)))
        if r.random() < 0.2:
            middle = f"<main>{middle}{after}</main>" if "<main>" not in middle else middle + after
            after = ""
        out.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{before}{middle}{after}</body></html>", main))
    return out


@cache
def trained() -> crf.LinearChain:
    """The field fitted on the pages of `training_pages`; block labels follow from their main texts, in order."""
    sequences, labels = [], []
    for page, main in training_pages():
        rest, marks = list(main), []
        blocks = leaf_blocks(page)
        for b in blocks:
            hit = bool(rest) and b.text == rest[0]
            marks.append(int(hit))
            if hit:
                rest.pop(0)
        sequences.append([block_features(b) for b in blocks])
        labels.append(marks)
    return crf.fit(sequences, labels, lambda x: x, iterations=120, rate=0.2, ridge=3e-4)


def known_names(chain: crf.LinearChain) -> frozenset:
    """The class and id words that the field has met."""
    held = chain.__dict__.get("_known_names")
    if held is None:
        held = chain.__dict__["_known_names"] = frozenset(f[5:] for f in chain.weights if f.startswith("name "))
    return held


def main_text(page: str | None, chain: crf.LinearChain, memory: dict | None = None) -> str:
    blocks = leaf_blocks(page or "", known_names(chain))
    if not blocks:
        return ""
    scores = []
    for b in blocks:
        f = block_features(b)
        s = memory.get(f) if memory is not None else None
        if s is None:
            s = chain.item_score(f)
            if memory is not None:
                if len(memory) > 50_000:
                    memory.clear()
                memory[f] = s
        scores.append(s)
    return "\n".join(b.text for b, v in zip(blocks, chain.viterbi(np.array(scores))) if v)


def extract(pages: DataFrame, chain: crf.LinearChain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    chain = chain or trained()
    memory: dict = {}

    def each(ids: list, urls: list, pages_: list) -> dict:
        texts = [main_text(p, chain, memory) for p in pages_]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages, each, "page_id long, url string, text string, n_chars long", "page_id", "url", "html")
