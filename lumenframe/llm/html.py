"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. A
block is described by its tag path (names, classes, ids and roles of all open elements) and
its words, both hashed, and a few sizes. A bidirectional LSTM reads the whole sequence and
labels each block, so that a block is judged in its document's context. The network is
trained in numpy on generated pages of many layouts, whose random words carry no meaning.

Defined results: null and empty pages, and pages without a main block, have the empty text.
Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line feed. Scripts, styles, templates and comments hold no blocks.
A comment without its end reaches to the page's end.
A head without its end tag ends before the first element or text that can't be in it. Media and the like
that close themselves, or have no end tag of their own (an end tag belongs to the nearest open start before it), hide nothing. A page of more than ``LOT_BLOCKS`` blocks is
read in windows, with the states carried over, with the same labels. Equal rows give equal rows; other columns
stay as they are, whatever their names, but ``html`` and an earlier ``text``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places for the whole path, for its innermost two elements, for words and for sizes.
PATH_PLACES, NEAR_PLACES, WORD_PLACES, SIZES = 256, 128, 64, 8
PLACES = PATH_PLACES + NEAR_PLACES + WORD_PLACES + SIZES
HIDDEN = 16
#: Pages are labelled in lots of at most this many blocks, longer ones alone in windows of as many.
LOT_BLOCKS = 8192

#: HTML elements that end a run of text, that have no end tag, and that show no text.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template noscript head title svg math iframe object canvas audio video".split())
#: What a head may hold.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
#: Hidden elements whose end tag authors leave out.
OFTEN_OPEN = frozenset("template noscript svg math iframe object canvas audio video".split())
_OFTEN_OPEN = re.compile(rf"<(/?)({'|'.join(sorted(OFTEN_OPEN))})(?=[\s>/])([^>]*)", re.IGNORECASE)
_SKIPPED = re.compile(r"<!--|<(script|style)(?=[\s>/])", re.IGNORECASE)
_COMMENT_END = re.compile(r"--!?>")
_RAW_ENDS = {n: re.compile(rf"</{n}(?=[\s>/])", re.IGNORECASE) for n in ("script", "style")}
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An element that an implied end doesn't reach out of.
SCOPES = frozenset("ul ol dl table select article aside body div footer form header main nav section html td th".split())


@lru_cache(maxsize=200_000)
def _place(token: str, places: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % places


@lru_cache(maxsize=50_000)
def _own_places(tag: str, names: str) -> tuple[int, ...]:
    """Places of an element's tag and of the words of its class, id and role."""
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", names)
    return (_place(f"<{tag}>", PATH_PLACES), *(_place(w.lower(), PATH_PLACES) for w in words))


Block = tuple[str, np.ndarray, tuple[int, ...], float]


class Leaves(HTMLParser):
    """Collects ``blocks``: (text, path vector, places of the innermost two elements, share of
    its characters in links)."""

    def __init__(self, unclosed: set[tuple[int, int]]) -> None:
        """``unclosed``: where start tags without their own end tag are (line, column)."""
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed
        self.blocks: list[Block] = []
        self.open: list[tuple[str, np.ndarray, tuple[int, ...]]] = []
        self.count: dict[str, int] = {}
        self.hidden = self.linked = 0
        self.parts: list[str] = []
        self.in_links = 0
        self.root = np.zeros(PATH_PLACES, np.float32)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            near = tuple(i % NEAR_PLACES for e in self.open[-2:] for i in e[2])
            self.blocks.append((text, self.open[-1][1] if self.open else self.root, near, min(1.0, self.in_links / len(text))))
        self.parts.clear()
        self.in_links = 0

    def pop(self) -> None:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        self.hidden -= tag in HIDDEN_TAGS
        self.linked -= tag == "a"

    def close_open(self, tags: set[str], scopes: frozenset[str]) -> None:
        """Closes the nearest open element of ``tags`` that isn't outside a scope."""
        if not any(self.count.get(t) for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if name in scopes:
                return

    def leave_head(self, tag: str) -> None:
        """A head ends before ``tag`` (empty: text) if that can't stand in it."""
        if not self.count.get("head"):
            return
        if tag == "body" or (self.open[-1][0] == "head" and tag not in HEAD_TAGS):
            self.close_open({"head"}, frozenset())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.leave_head(tag)
        if tag in OFTEN_OPEN and self.getpos() in self.unclosed:
            return
        if tag in BLOCK_TAGS:
            self.flush()
            self.close_open(CLOSES.get(tag, {"p"}), SCOPES)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
        above = self.open[-1][1] if self.open else self.root
        places = _own_places(tag, names)
        vector = above
        if any(not above[i] for i in places):  # most inline elements add nothing that isn't there
            vector = above.copy()
            vector[list(places)] = 1.0
        self.open.append((tag, vector, places))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += tag in HIDDEN_TAGS
        self.linked += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN_TAGS:
            return
        self.handle_starttag(tag, attrs)
        if self.count.get("svg") or self.count.get("math"):  # only there does a slash end an element
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if not self.count.get(tag):
            return
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            self.close_open({tag}, frozenset())
        else:  # an inline element ends alone if nothing but inline elements stand inside it
            self.close_open({tag}, BLOCK_TAGS)

    def handle_data(self, data: str) -> None:
        if self.count.get("head") and not data.isspace():
            self.leave_head("")
        if not self.hidden:
            self.parts.append(data)
            if self.linked:
                self.in_links += len(data)


def _shown(html: str) -> str:
    """The page without comments, scripts and styles, in one pass."""
    parts, at = [], 0
    while m := _SKIPPED.search(html, at):
        parts.append(html[at : m.start()])
        if m[1]:
            at = html.find(">", m.end()) + 1
            if at and html[at - 2] != "/":
                end = _RAW_ENDS[m[1].lower()].search(html, at)
                at = html.find(">", end.end()) + 1 if end else 0
        elif html.startswith((">", "->"), m.end()):
            at = html.index(">", m.end()) + 1
        else:
            end = _COMMENT_END.search(html, m.end())
            at = end.end() if end else 0
        if not at:
            return "".join(parts)
    return "".join([*parts, html[at:]])


def _unclosed(html: str) -> set[tuple[int, int]]:
    """Line (from 1) and column (from 0) of the start tags of often open elements that no end tag belongs to."""
    open_at: dict[str, list[int]] = {}
    for m in _OFTEN_OPEN.finditer(html):
        starts = open_at.setdefault(m[2].lower(), [])
        if not m[1] and not m[3].endswith("/"):
            starts.append(m.start())
        elif m[1] and starts:
            starts.pop()
    found, line, last, seen = set(), 1, -1, 0
    for at in sorted(i for starts in open_at.values() for i in starts):
        line += html.count("\n", seen, at)
        last = max(last, html.rfind("\n", seen, at))
        found.add((line, at - last - 1))
        seen = at
    return found


def leaf_blocks(html: str) -> list[Block]:
    html = _shown(html)
    parser = Leaves(_unclosed(html))
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def features(blocks: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Of the blocks from ``lo`` to before ``hi`` of a page."""
    some = blocks[lo:hi]
    out = np.zeros((len(some), PLACES), np.float32)
    for i, (text, path, near, linked) in enumerate(some):
        words = text.lower().split()
        row = out[i]
        row[:PATH_PLACES] = path
        row[[PATH_PLACES + k for k in near]] = 1.0
        row[[PATH_PLACES + NEAR_PLACES + _place(w, WORD_PLACES) for w in set(words)]] = 0.25
        letters = len(text)
        row[-SIZES:] = (np.log1p(letters) / 6, np.log1p(len(words)) / 5, linked, linked > 0.5, 2 * (linked > 0.8), text.count(".") > 0, (lo + i) / len(blocks), text[-1] in ".!?…")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLstm:
    """Labels block sequences, given as (step, sequence, place) with a mask of real blocks."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.05, (2, PLACES, 4 * hidden)).astype(f),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)).astype(f),
            "b": np.zeros((2, 4 * hidden), f),
            "v": rng.normal(0, 0.2, (2, hidden)).astype(f),
            "c": np.zeros(1, f),
        }
        self.p["b"][:, hidden : 2 * hidden] = 1.0  # forget gates begin open

    def pass_over(self, d: int, x: np.ndarray, mask: np.ndarray, h: np.ndarray, c: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outputs (step, sequence, place) of direction ``d`` from the states ``h`` and ``c``, and the states after it."""
        steps, n, _ = x.shape
        k = self.hidden
        out = np.zeros((steps, n, k), np.float32)
        given = (x.reshape(steps * n, -1) @ self.p["x"][d]).reshape(steps, n, -1) + self.p["b"][d]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = given[t] + h @ self.p["u"][d]
            i, f, o, g = _sigmoid(a[:, :k]), _sigmoid(a[:, k : 2 * k]), _sigmoid(a[:, 2 * k : 3 * k]), np.tanh(a[:, 3 * k :])
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            m = mask[t][:, None]
            if trace is not None:
                trace.append((d, t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
            out[t] = h
        return out, h, c

    def run(self, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits (step, sequence). States stay as they are at masked steps."""
        start = np.zeros((x.shape[1], self.hidden), np.float32)
        self.out = out = np.stack([self.pass_over(d, x, mask, start, start, trace)[0] for d in (0, 1)])
        return out[0] @ self.p["v"][0] + out[1] @ self.p["v"][1] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        trace: list = []
        logits = self.run(x, mask, trace)
        k, p = self.hidden, self.p
        dl = ((_sigmoid(logits) - y) * mask / max(1, mask.sum())).astype(np.float32)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["c"][0] = dl.sum()
        g["v"] = np.stack([np.einsum("tn,tnk->k", dl, self.out[d]) for d in (0, 1)])
        carry = {d: (0.0, 0.0) for d in (0, 1)}
        gates = np.zeros((2, *x.shape[:2], 4 * k), np.float32)
        for d, t, h, c, i, f, o, gg, tc, m in reversed(trace):
            dh = dl[t][:, None] * p["v"][d] + carry[d][0]
            dc_pass, dh_pass = carry[d][1] * ~m if np.ndim(carry[d][1]) else 0.0, dh * ~m
            dh = dh * m
            dc = (carry[d][1] * m if np.ndim(carry[d][1]) else 0.0) + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            gates[d, t] = da
            g["u"][d] += h.T @ da
            carry[d] = (da @ p["u"][d].T + dh_pass, dc * f + dc_pass)
        flat = x.reshape(-1, PLACES)
        for d in (0, 1):
            da = gates[d].reshape(-1, 4 * k)
            g["x"][d] = flat.T @ da
            g["b"][d] = da.sum(0)
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's features, which blocks are main text."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):  # pages of like length together: little padding
            hi, first = lo + 1, len(pages[order[lo]])
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) <= first * 1.25 + 4:
                hi += 1
            x, mask = _padded([pages[i] for i in order[lo:hi]])
            on = self.run(x, mask) > 0
            for j, i in enumerate(order[lo:hi]):
                out[i] = on[: len(pages[i]), j]
            lo = hi
        return out

    def label_long(self, blocks: list[Block], window: int = LOT_BLOCKS) -> np.ndarray:
        """Which blocks of one page are main text; features are made for one window at a time."""
        logits = np.full(len(blocks), self.p["c"][0], np.float32)
        windows = range(0, len(blocks), window)
        for d in (0, 1):
            h = c = np.zeros((1, self.hidden), np.float32)
            for lo in windows if d == 0 else reversed(windows):
                x = features(blocks, lo, lo + window)[:, None]
                out, h, c = self.pass_over(d, x, np.ones(x.shape[:2], bool), h, c)
                logits[lo : lo + window] += out[:, 0] @ self.p["v"][d]
        return logits > 0


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(p) for p in pages))
    x = np.zeros((steps, len(pages), PLACES), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


# Generated pages: (html fragments, label) pairs. Words are random; layouts and names are
# those that web pages commonly use.

MAIN_NAMES = "content main-content post post-content entry entry-content article article-body story story-body page-content text body-copy blog-post prose markdown-body".split()
SIDE_NAMES = "sidebar widget related related-posts recommended most-read trending toc tag-cloud about-author author-bio".split()
AD_NAMES = "ad ads advert advertisement ad-slot adsbygoogle banner-ad sponsored sponsor promo promotion promoted outbrain taboola".split()
NOTICE_NAMES = "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal newsletter subscribe paywall message-box".split()
NAV_NAMES = "nav navbar navigation menu main-menu breadcrumbs breadcrumb pagination pager skip-link top-bar links".split()
HEAD_NAMES = "header site-header masthead topbar banner page-header branding logo".split()
FOOT_NAMES = "footer site-footer page-footer copyright bottom colophon legal credits".split()
COMMENT_NAMES = "comments comment-list commentlist comment-section discussion disqus responses replies reader-comments".split()
EXTRA_NAMES = "share social social-share share-buttons tags post-meta byline-links print-link feedback rating".split()


class Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.syllables = [a + b for a in "b c d f g h l m n p r s t v w z th sch ch é ñ ü qu".split() for b in "a e i o u ai ou er en on".split()]
        self.out: list[tuple[str, int | None]] = []

    def some(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def pick(self, of: list):
        return of[int(self.r.integers(len(of)))]

    def words(self, lo: int, hi: int) -> str:
        n = int(self.r.integers(lo, hi + 1))
        style = self.r.random()
        ws = ["".join(self.pick(self.syllables) for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        if style < 0.08:
            ws = [w + self.pick(["***", "###", "!!", " |", "&amp;&amp;"]) for w in ws]
        elif style < 0.14:
            ws = [w.upper() for w in ws]
        s = " ".join(ws)
        return (s[:1].upper() + s[1:] if self.some(0.8) else s) + self.pick([".", ".", ".", "", "?", "!"])

    def tag(self, html: str) -> None:
        self.out.append((html, None))

    def block(self, text: str, label: int) -> None:
        self.out.append((text, label))

    def wrap(self, names: list[str], tags: list[str]) -> str:
        """Opens an element; returns its end tag."""
        tag = self.pick(tags)
        at = "" if tag not in ("div", "section", "ul", "span", "p", "ol") and self.some(0.6) else f' {self.pick(["class", "class", "id"])}="{self.pick(names)}{self.pick(["", "", " wide", " m-2", "-1"])}"'
        self.tag(f"<{tag}{at}>")
        return f"</{tag}>"

    def links(self, label: int) -> None:
        self.tag("<ul>")
        for _ in range(int(self.r.integers(2, 9))):
            self.tag('<li><a href="#">')
            self.block(self.words(1, 4), label)
            self.tag("</a></li>")
        self.tag("</ul>")

    def filler(self, names: list[str], tags: list[str]) -> None:
        end = self.wrap(names, tags)
        for _ in range(int(self.r.integers(1, 4))):
            kind = self.r.random()
            if kind < 0.3:
                self.links(0)
            elif kind < 0.5:
                self.tag(self.pick(["<p>", "<h3>", "<div>"]))
                self.block(self.words(1, 12), 0)
                self.tag(self.pick(["</p>", "</h3>", "</div>"]) if self.some(0.1) else "")
                self.tag("<div>")
                self.block(self.words(2, 30), 0)
                self.tag("</div>")
            else:
                self.block(self.words(1, 40), 0)
                self.tag("<hr>")
        self.tag(end)

    def form(self) -> None:
        self.tag('<form><label>')
        self.block(self.words(1, 3), 0)
        self.tag("</label><hr><button>")
        self.block(self.words(1, 2), 0)
        self.tag("</button></form>")

    def aside(self) -> None:
        kind = self.r.random()
        if kind < 0.3:
            self.filler(AD_NAMES, ["div", "div", "aside", "section", "p"])
        elif kind < 0.5:
            self.filler(NOTICE_NAMES, ["div", "section", "aside", "dialog", "p"])
        elif kind < 0.75:
            self.filler(SIDE_NAMES, ["aside", "div", "section"])
        elif kind < 0.85:
            self.form()
        else:
            self.filler(EXTRA_NAMES, ["div", "ul", "p", "section"])

    def made_name(self) -> str:
        """A name that a build tool made."""
        return self.pick(["css-", "sc-", "_", "jsx-", ""]) + "".join(self.pick(list("abcdefghijkmnpqrstuvwxyz0123456789")) for _ in range(int(self.r.integers(3, 8))))

    def main(self, bare: float = 0.15) -> None:
        kind = self.r.random()
        if kind < bare:  # straight in what is around it
            ends = []
        elif kind < bare + 0.25:
            self.tag(f'<div class="{self.made_name()}">')
            ends = ["</div>"]
        else:
            ends = [self.wrap(MAIN_NAMES, ["article", "article", "article", "main", "div", "div", "section"])]
        if self.some(0.3):
            ends.append(self.wrap(MAIN_NAMES, ["article", "div", "section"]))
        if self.some(0.8):
            self.tag(self.pick(["<h1>", "<h1>", "<h2>", '<h1 class="title">', "<header><h1>"]))
            self.block(self.words(1, 14), 1)
            self.tag("</h1>" if not self.some(0.2) else "</h1></header>")
        for _ in range(int(self.r.integers(1, 14))):
            kind = self.r.random()
            if kind < 0.75:
                self.tag(self.pick(["<p>", "<p>", "<p>", "<p><b>", '<p class="text">', "<div>", "<blockquote><p>", "<pre>"]))
                self.block(self.words(1, 60 if self.some(0.7) else 6), 1)
                self.tag(self.pick(["</p>", "</p>", "</p>", "<br>", "</b></p>", "</p></blockquote>", "</pre>"]))
                self.tag("<p>" if self.some(0.1) else "<!-- x -->")
                self.tag("<p></p>")
            elif kind < 0.82:
                self.tag(self.pick(["<h2>", "<h3>"]))
                self.block(self.words(1, 8), 1)
                self.tag("</h2></h3>")
            elif kind < 0.9:
                self.tag(self.pick(["<ul>", "<ol>"]))
                for _ in range(int(self.r.integers(1, 5))):
                    self.tag("<li>")
                    self.block(self.words(1, 20), 1)
                self.tag("</ul></ol>")
            elif kind < 0.94:
                self.tag("<table><tr><td>")
                self.block(self.words(1, 6), 1)
                self.tag("</td><td>")
                self.block(self.words(1, 6), 1)
                self.tag("</td></tr></table>")
            else:
                self.aside()
        for end in reversed(ends):
            self.tag(end)

    def page(self) -> tuple[str, list[int]]:
        self.tag("<!DOCTYPE html><html><head><title>x</title><script>var a='<p>';</script></head><body>")
        if self.some(0.25):
            self.tag('<div class="wrapper container">')
        if self.some(0.2):
            self.filler(NOTICE_NAMES, ["div", "aside", "section", "p"])
        if self.some(0.6):
            self.filler(HEAD_NAMES, ["header", "header", "div"])
        if self.some(0.75):
            end = self.wrap([self.made_name()] if self.some(0.15) else NAV_NAMES, ["nav", "nav", "div", "ul"])
            self.links(0)
            self.tag(end)
        while self.some(0.5):
            self.aside()
        cells = self.some(0.15)
        if cells:  # a table lays out the page
            self.tag(self.pick(['<table><tr><td>', '<table width="100%"><tbody><tr><td class="left">', "<table><tr><td><ul>"]))
            for _ in range(int(self.r.integers(1, 8))):
                self.tag(self.pick(['<a href="#">', '<li><a href="#">', '<p><a href="#">']))
                self.block(self.words(1, 3), 0)
                self.tag("</a><hr>")
            self.tag("</td><td>")
        if self.some(0.95):
            self.main(0.6 if cells else 0.15)
        if cells:
            self.tag("</td></tr></table>")
        while self.some(0.45):
            self.aside()
        if self.some(0.3):
            end = self.wrap(COMMENT_NAMES, ["section", "div", "ol", "aside"])
            for _ in range(int(self.r.integers(1, 6))):
                self.tag(self.pick(['<div class="comment">', '<li class="comment">', '<article class="comment">', "<p>", '<div class="reply comment-body"><p>']))
                self.block(self.words(1, 40), 0)
                self.tag(self.pick(["</div>", "</li>", "</article>", "</p>", "</p></div>"]) if self.some(0.2) else "<hr>")
            self.tag("</article></div></li></p>")
            self.tag(end)
        if self.some(0.8):
            self.filler(FOOT_NAMES, ["footer", "footer", "div"])
        if self.some(0.9):
            self.tag("</div></body></html>")
        return "".join(h for h, _ in self.out), [y for _, y in self.out if y is not None]


def generated(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of ``n`` pages whose blocks the parser finds one for one."""
    out = []
    k = 0
    while len(out) < n:
        html, labels = Maker(seed + k).page()
        k += 1
        blocks = leaf_blocks(html)
        if blocks and len(blocks) == len(labels):
            out.append((features(blocks), np.array(labels, np.float32)))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 1500, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 1000) -> BiLstm:
    """The labeller; the same on every call."""
    data = generated(pages, seed)
    net = BiLstm()
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-pages // batch)
    for _ in range(epochs):
        order = sorted(rng.permutation(pages), key=lambda i: len(data[i][1]) // 8)
        lots = [order[lo : lo + batch] for lo in range(0, pages, batch)]
        for j in rng.permutation(len(lots)):
            lot = [data[i] for i in lots[j]]
            x, mask = _padded([f for f, _ in lot])
            y = np.zeros(mask.shape, np.float32)
            for c, (_, labels) in enumerate(lot):
                y[: len(labels), c] = labels
            g = net.gradients(x, mask, y)
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, v in g.items():
                v = np.clip(v, -0.5, 0.5)
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.001 * (v * v - s[k])
                net.p[k] -= (now * ((m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8) + 1e-3 * net.p[k])).astype(np.float32)
    net.out = None
    return net


def _kept(net: BiLstm, pages: list[list[Block]]) -> list[str]:
    long = len(pages) == 1 and len(pages[0]) > LOT_BLOCKS
    on = [net.label_long(pages[0])] if long else net.label([features(b) for b in pages])
    return ["\n".join(t for (t, *_), keep in zip(blocks, flags, strict=True) if keep) for blocks, flags in zip(pages, on, strict=True)]


def main_texts(net: BiLstm, htmls: Iterable[str]) -> list[str]:
    out: list[str] = []
    lot: list[list[Block]] = []
    size = 0
    for blocks in map(leaf_blocks, htmls):
        if lot and size + len(blocks) > LOT_BLOCKS:
            out += _kept(net, lot)
            lot, size = [], 0
        lot.append(blocks)
        size += len(blocks)
    return out + _kept(net, lot) if lot else out


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text`` (replaced if there)."""
    held = pages.sparkSession.sparkContext.broadcast(trained())  # some 100 KB
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower())]
    slim = pages.select(F.col(f"`{html}`").cast("string").alias("__html"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            got = main_texts(net, (h.as_py() or "" for h in b.column(0)))
            yield pa.record_batch([*b.columns[1:], pa.array(got, pa.string())], names=[*b.schema.names[1:], "__text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), "__text string"])
    out = slim.mapInArrow(run, schema)
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(rest)], F.col("__text").alias(text))
