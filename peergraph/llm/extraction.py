"""Main-text extraction from HTML with a linear-chain conditional random field.

A page is read into its leaf blocks: the stretches of text between block-level
tags.  Each block gets binary features of its ancestors (tags, and words in their
class, id and role), of its own tag, and of its text; a chain of two labels,
article and other, is trained on labelled pages by gradient ascent on the
conditional likelihood and decoded by Viterbi.

The labelled pages are made here, by :func:`labelled_page`: a generator of page
layouts (semantic and div-based, tables, with and without side matter, comments,
forms, notices and adverts inside and outside the article) that knows of each block
which it is.  Training takes ``PAGES`` pages and is deterministic.

Edge cases: null html is empty; a page without article text gives the empty string;
unclosed and stray tags are tolerated, and an unclosed script, style, title or text
area hides nothing; pages of any length are read in one linear pass; repeated rows
and null or repeated identifiers give equal results; an empty table gives an empty
result; extra columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, ROUNDS, PENALTY, SEED = 300, 150, 0.02, 7

#: Elements that hold raw text and no tags: scripts, styles, the page's title and form fields (fixed values of the HTML standard).
RAW = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Inline elements do not end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag closes open elements of these names, up to a boundary.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
BOUNDARY = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "body", "header", "footer", "form", "blockquote"}
CLOSES_P = BOUNDARY | {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "p", "hr", "figure", "fieldset"}

OPEN = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name: quotes count only after an equals sign, as in the standard.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

ANCESTORS = (
    "nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "table", "figure", "blockquote", "dialog", "menu", "button", "address", "details",
)
#: Words in class, id or role, by what they speak for.
HINTS = {
    "comment": ("comment", "reply", "replies", "disqus", "discussion", "respond", "feedback", "review"),
    "side": ("sidebar", "aside", "widget", "related", "recommend", "trending", "popular", "more-", "complementary", "rail", "promo", "teaser"),
    "menu": ("nav", "menu", "breadcrumb", "crumb", "toc", "pagination", "pager", "tabs", "skip", "toolbar"),
    "head": ("header", "masthead", "banner", "topbar", "logo", "brand", "site-title", "tagline"),
    "foot": ("footer", "copyright", "colophon", "legal", "contentinfo", "bottom"),
    "advert": ("advert", "ads", "ad-", "-ad", "sponsor", "dfp", "promoted", "affiliate"),
    "notice": ("cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer", "warning"),
    "share": ("share", "social", "follow", "tags", "byline", "meta", "author-box", "rating"),
    "form": ("form", "login", "search", "contact", "register"),
    "body": ("content", "article", "post", "entry", "story", "main", "text", "body", "page-body", "prose"),
}
OWN = ("p", "h1", "h2", "h3", "li", "td", "div", "blockquote", "pre", "label", "figcaption", "dd", "span")


class Block:
    __slots__ = ("text", "own", "around", "linked", "hidden")

    def __init__(self, text: str, own: str, around: frozenset, linked: float, hidden: bool):
        self.text, self.own, self.around, self.linked, self.hidden = text, own, around, linked, hidden


@lru_cache(maxsize=4096)
def hints_of(attributes: str) -> frozenset:
    names = " ".join(next(filter(None, m), "") for m in NAMED.findall(attributes)).lower()
    if not names:
        return frozenset()
    found = {kind for kind, words in HINTS.items() if any(w in names for w in words)}
    tokens = set(re.split(r"[^a-z]+", names))
    if tokens & {"ad", "ads"}:
        found.add("advert")
    return frozenset(found)


class Tags:
    """The tags of a page from left to right, in time linear in the page.

    A tag ends at the first ``>`` outside quoted values.  Where there is none, quotes are
    taken as plain characters for the rest of the page, so that search fails only once.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True
        self.ends: dict[str, int] = {}

    def upto(self, mark: str, at: int) -> int:
        """Where ``mark`` next ends, or the end of the page; looked for once if it is missing."""
        if self.ends.get(mark, 0) < 0:
            return len(self.page)
        found = self.page.find(mark, at)
        if found < 0:
            self.ends[mark] = -1
            return len(self.page)
        return found + len(mark)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; a comment or declaration has no name."""
        page = self.page
        while (found := OPEN.search(page, at)) is not None:
            start = found.start()
            if page.startswith("<!--", start):
                return start, self.upto("-->", start + 4), False, "", ""
            if page.startswith("<![CDATA[", start):
                return start, self.upto("]]>", start + 9), False, "", ""
            if page[start + 1] in "!?":
                return start, self.upto(">", start), False, "", ""
            if start > self.last:
                return None
            named = NAME.match(page, start)
            rest = REST.match(page, named.end()) if self.quotes else None
            if rest is None:
                self.quotes = False
                end = page.index(">", named.end() - 1) + 1 if named.end() <= self.last else -1
                if end < 0:
                    return None
            else:
                end = rest.end()
            return start, end, bool(named.group(1)), named.group(2).lower(), page[named.end() : end - 1]
        return None

    def close_of(self, name: str, at: int) -> int | None:
        """The end of the closing tag of a raw element; None where it is missing."""
        if self.ends.get(name) == -1:
            return None
        found = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, at)
        if found is None:
            self.ends[name] = -1
        return found.end() if found else None


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, bool]] = []  # (tag, what surrounds its content, hidden)
    parts: list[tuple[str, bool]] = []
    links, at, n, tags = 0, 0, len(page), Tags(page)
    open_count: dict[str, int] = {}

    def end_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html_lib.unescape("".join(t for t, _ in parts)).split())
            if text:
                own = next((t for t, _, _ in reversed(stack) if t not in INLINE), "body")
                around = stack[-1][1] if stack else frozenset()
                whole = sum(len(t) for t, _ in parts) or 1
                out.append(Block(text, own, around, sum(len(t) for t, inside in parts if inside) / whole, bool(stack) and stack[-1][2]))
            parts = []

    def drop(to: int) -> None:
        nonlocal links
        for t, _, _ in stack[to:]:
            links -= t == "a"
            open_count[t] -= 1
        del stack[to:]

    while at < n:
        found = tags.after(at)
        if found is None:
            parts.append((page[at:], links > 0))
            break
        start, end, closing, name, attributes = found
        if start > at:
            parts.append((page[at:start], links > 0))
        at = end
        if not name:
            continue
        if closing:
            if name not in INLINE:
                end_block()
            if open_count.get(name):
                _close(stack, {name}, drop, BOUNDARY if name in INLINE else frozenset())
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            at = tags.close_of(name, at) or at  # an element that is not closed hides nothing
            continue
        if name == "br":
            parts.append((" ", links > 0))
        if name in VOID:
            if name not in INLINE:
                end_block()
            continue
        if name not in INLINE:
            end_block()
            if name in CLOSES_P:
                _close(stack, {"p"}, drop)
            if name in CLOSES:
                _close(stack, CLOSES[name], drop)
            # an inline element that was left open does not reach over a new block
            while stack and stack[-1][0] in INLINE:
                drop(len(stack) - 1)
        if attributes.rstrip().endswith("/"):
            continue
        around = (stack[-1][1] if stack else frozenset()) | hints_of(attributes)
        if name in ANCESTORS:
            around |= {f"<{name}"}
        open_count[name] = open_count.get(name, 0) + 1
        stack.append((name, around, (bool(stack) and stack[-1][2]) or bool(HIDDEN.search(attributes))))
        links += name == "a"
    end_block()
    return out


def _close(stack: list, names: set[str], drop, boundary: set[str] | frozenset = BOUNDARY) -> None:
    """Closes the innermost open element of ``names``, unless a boundary lies in between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            drop(i)
            return
        if stack[i][0] in boundary:
            return


FEATURES = (
    ["bias", "first", "last"] + [f"<{t}" for t in ANCESTORS] + list(HINTS) + [f"own {t}" for t in OWN]
    + ["hidden", "links none", "links some", "links most", "links all"]
    + [f"words {k}" for k in ("1", "2-4", "5-9", "10-19", "20-49", "50+")]
    + ["ends a sentence", "many commas", "copyright", "capitals", "digits", "no anchor"]
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def features(blocks: list[Block]) -> np.ndarray:
    """A row of zeros and ones for each block."""
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        on = ["bias", *b.around]
        if not b.around & {"<article", "<main", "body"}:
            on.append("no anchor")
        if i == 0:
            on.append("first")
        if i == len(blocks) - 1:
            on.append("last")
        on.append(f"own {b.own}")
        if b.hidden:
            on.append("hidden")
        on.append("links " + ("none" if b.linked == 0 else "some" if b.linked < 0.4 else "most" if b.linked < 0.95 else "all"))
        on.append("words " + ("1" if words < 2 else "2-4" if words < 5 else "5-9" if words < 10 else "10-19" if words < 20 else "20-49" if words < 50 else "50+"))
        if b.text[-1] in ".!?…:;\"”’)":
            on.append("ends a sentence")
        if b.text.count(",") >= 2:
            on.append("many commas")
        if "©" in b.text or "all rights reserved" in b.text.lower():
            on.append("copyright")
        if b.text.isupper():
            on.append("capitals")
        if any(c.isdigit() for c in b.text):
            on.append("digits")
        for f in on:
            if f in _AT:
                x[i, _AT[f]] = 1.0
    return x


class Chain:
    """Two-label linear-chain conditional random field: label 1 is article text."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (features, 2), (2, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labelling, by Viterbi."""
        local = x @ self.weights
        best, back = local[0], []
        for row in local[1:]:
            reach = best[:, None] + self.moves
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0) + row
        labels = [int(best.argmax())]
        for choice in reversed(back):
            labels.append(int(choice[labels[-1]]))
        return np.array(labels[::-1])

    @staticmethod
    def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, penalty: float = PENALTY) -> "Chain":
        """Ascent on the penalised conditional log-likelihood, all pages at a time (Adam steps)."""
        longest, width = max(len(y) for _, y in pages), pages[0][0].shape[1]
        x = np.zeros((len(pages), longest, width))
        y = np.zeros((len(pages), longest), int)
        mask = np.zeros((len(pages), longest))
        for i, (a, b) in enumerate(pages):
            x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, 1
        gold = np.eye(2)[y] * mask[..., None]
        gold_moves = np.einsum("pta,ptb->ab", gold[:, :-1], gold[:, 1:])
        theta = np.zeros(width * 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = mask.sum()
        for step in range(1, rounds + 1):
            w, t = theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2)
            local = x @ w
            ahead, behind = np.zeros_like(local), np.zeros_like(local)
            ahead[:, 0] = local[:, 0]
            for k in range(1, longest):
                ahead[:, k] = np.logaddexp(ahead[:, k - 1, :1] + t[0], ahead[:, k - 1, 1:] + t[1]) + local[:, k]
            for k in range(longest - 2, -1, -1):
                reach = (local + behind)[:, k + 1]
                behind[:, k] = np.logaddexp(reach[:, :1] + t[:, 0], reach[:, 1:] + t[:, 1]) * mask[:, k + 1, None]
            ends = mask.sum(axis=1).astype(int) - 1
            norm = np.logaddexp(*ahead[np.arange(len(pages)), ends].T)[:, None, None]
            expected = np.exp(np.minimum(ahead + behind - norm, 0)) * mask[..., None]
            pair = ahead[:, :-1, :, None] + t + (local + behind)[:, 1:, None, :] - norm[..., None]
            moves = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            grad = np.concatenate([np.einsum("ptf,ptl->fl", x, gold - expected).ravel(), (gold_moves - moves).ravel()]) / total - penalty * theta / 100
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return Chain(theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2))


SYLLABLES = ("ta", "ren", "mo", "il", "sa", "ker", "do", "un", "fe", "lis", "gra", "po", "ne", "tu", "ar", "bin")
#: Marks that carry the label through parsing; they are taken off before features are made.
MARKS = ("zqother ", "zqarticle ")


def labelled_page(rng: random.Random) -> str:
    """A page whose every block of text begins with the mark of its label."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    noise = rng.choice(["", "", "", "###", "&amp;&amp;", "***", "!!"])

    def words(a: int, b: int, end: str = "") -> str:
        n = rng.randint(a, b)
        return " ".join(word() + (noise if noise and rng.random() < 0.7 else "," if rng.random() < 0.08 else "") for _ in range(n)).capitalize() + end

    def prose(label: int, short: float = 0.15) -> str:
        text = words(1, 4, ".") if rng.random() < short else " ".join(words(4, 18, rng.choice("...?!")) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.15:
            text += f' <a href="/{word()}">{word()}</a> {words(2, 6, ".")}'
        return MARKS[label] + (text if rng.random() < 0.9 else text.upper())

    other = lambda a, b, end="": MARKS[0] + words(a, b, end)
    link = lambda: f'<a href="/{word()}">{other(1, 4)}</a>'
    items = lambda a, b: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b)))
    named = lambda *names: rng.choice(["class", "class", "id"]) + f'="{rng.choice(names)}"'

    def maybe(p: float, *makers) -> str:
        return rng.choice(makers)() if rng.random() < p else ""

    menu = lambda: rng.choice(["<nav><ul>{}</ul></nav>", "<div " + named("menu", "navbar", "main-nav", "breadcrumbs") + "><ul>{}</ul></div>", '<ul role="navigation" class="nav">{}</ul>']).format(items(2, 8))
    head = lambda: rng.choice(["<header>{}</header>", "<div " + named("header", "masthead", "site-header", "topbar") + ">{}</div>"]).format(f"<div>{other(1, 4)}</div>" + maybe(0.5, lambda: f"<p>{other(3, 9, '.')}</p>") + maybe(0.3, menu))
    foot = lambda: rng.choice(["<footer>{}</footer>", "<div " + named("footer", "site-footer", "copyright") + ">{}</div>"]).format(rng.choice([f"{MARKS[0]}&copy; {word()}.com &middot; {words(3, 20, '.')}", f"<p>{other(4, 15, '.')}</p><ul>{items(1, 4)}</ul>"]))
    advert = lambda: rng.choice([f"<div {named('ad', 'advert', 'ads', 'sponsored', 'ad-slot')}>{other(3, 25, '.')}</div>", f'<aside class="advertisement"><p>{other(3, 20, ".")}</p></aside>', f'<div class="ad banner"><a href="#">{other(2, 9)}</a></div>'])
    notice = lambda: rng.choice(["<div {}><p>{}</p></div>", '<div role="alert" {}>{}</div>', "<section {}><p>{}</p></section>"]).format(named("cookie-notice", "notice", "alert", "consent", "newsletter", "popup"), other(6, 40, "."))
    form = lambda: f"<form {named('search', 'login', 'f1', 'signup')}><label>{other(1, 4)}</label><input name='q'><p>{other(3, 14, '.')}</p><button>{other(1, 2)}</button></form>"
    side = lambda: rng.choice(["<aside>{}</aside>", "<div " + named("sidebar", "related", "widget", "recommended") + ">{}</div>", "<section class='related-posts'>{}</section>"]).format(f"<h3>{other(1, 4)}</h3>" + rng.choice([f"<ul>{items(2, 6)}</ul>", f"<p>{other(8, 50, '.')}</p>", f"<p>{other(8, 30, '.')}</p><p>{other(5, 30, '.')}</p>"]))
    share = lambda: f"<div {named('share', 'social', 'tags', 'post-meta')}>{link()} {link()}</div>"

    def comments() -> str:
        one = lambda: rng.choice(["<li>{}</li>", '<div class="comment">{}</div>', "<article class='comment'>{}</article>", "<div>{}</div>"]).format(f"<b>{other(1, 2)}</b><p>{prose(0)}</p>" + maybe(0.3, lambda: f"<p>{prose(0)}</p>"))
        inner = maybe(0.7, lambda: f"<h2>{other(1, 3)}</h2>") + "".join(one() for _ in range(rng.randint(1, 6))) + maybe(0.4, form)
        return rng.choice(["<section {}>{}</section>", "<div {}>{}</div>", "<ol {}>{}</ol>"]).format(named("comments", "comment-list", "replies", "discussion", "reader-comments"), inner)

    def body() -> str:
        out = rng.choice([f"<h1>{MARKS[1]}{words(1, 14)}</h1>"] * 5 + [""])
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
            out += rng.choice(
                [f"<p>{prose(1)}</p>"] * 10 + [f"<p><b>{prose(1)}<br>"] * 2 + [f"<p>{prose(1)}"] + [f"<div>{prose(1)}</div>"] * 2
                + [f"<h2>{MARKS[1]}{words(1, 8)}</h2>", f"<blockquote><p>{prose(1)}</p></blockquote>", f"<pre>{MARKS[1]}{words(4, 20)}</pre>"]
                + ["<ul>" + "".join(f"<li>{MARKS[1]}{words(1, 14, '.')}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"]
                + ["<table>" + "".join(f"<tr><td>{MARKS[1]}{words(1, 4)}</td><td>{MARKS[1]}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"]
                + [f"<figure><img src='x.png'><figcaption>{MARKS[1]}{words(2, 10, '.')}</figcaption></figure>"]
            )
            out += maybe(0.04, advert) + maybe(0.02, side) + maybe(0.02, notice) + maybe(0.01, form) + maybe(0.01, share)
        return out

    core = body()
    tail = maybe(0.35, comments)
    core += maybe(0.15, share) + (tail if rng.random() < 0.3 else "")
    if core.endswith(tail) and tail:
        tail = ""
    box = rng.choice(
        ["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>']
        + ['<div class="entry">{}</div>', '<div class="article-body">{}</div>', '<section class="story">{}</section>', '<table><tr><td class="main">{}</td></tr></table>', "<div>{}</div>", "{}"]
    ).format(core)
    before = maybe(0.5, head) + maybe(0.8, menu) + maybe(0.25, notice) + maybe(0.4, advert) + maybe(0.15, form) + maybe(0.2, side)
    after = tail + maybe(0.35, side) + maybe(0.2, advert) + maybe(0.1, notice) + maybe(0.1, form) + maybe(0.85, foot)
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>{before}<!-- {word()} --><script>var t='</p>';</script>{box}{after}</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a generated page, unmarked, with their labels."""
    blocks = blocks_of(page)
    labels = np.array([int(b.text.startswith(MARKS[1].strip())) for b in blocks])
    for b in blocks:
        for mark in MARKS:
            b.text = b.text.replace(mark, "").replace(mark.upper(), "").replace(mark.strip(), "") or "x"
    return blocks, labels


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> Chain:
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        blocks, labels = labelled(labelled_page(rng))
        if blocks:
            data.append((features(blocks), labels))
    return Chain.train(data)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    labels = chain.decode(features(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text; the model, a few kilobytes, is trained on the driver and broadcast."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    def text(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            yield pa.array([main_text(x.as_py(), model.value) for x in batch], pa.string())

    return pages.select(*[c for c in pages.columns if c.lower() != out.lower() or c == html]).withColumn(out, text(F.col(html)))
