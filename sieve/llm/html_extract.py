"""HTML extraction: the main text of a page, by boosted trees over DOM nodes and a consistent choice over the tree.

A page is parsed into its block elements (raw text of scripts, styles and the like is skipped; open paragraphs, items and
cells are closed where the next one implies it).  Every element gets features: its tag, the tokens of its class, id and
role, the same of its ancestors, depth, siblings, and the density of text, links, sentences and controls in its subtree.
Gradient-boosted trees give the log-odds of main text.  Decoding then labels each element main, boilerplate or mixed so that
the total is greatest and nothing contradicts: below main all is main, below boilerplate all is boilerplate, and
only below mixed elements the children differ.

The trees are trained in the driver, once a process, on pages that ``training_pages`` writes with known main
text: no page of the input is used, and the model is a few kilobytes.

The text is the main blocks in page order, joined by ``\\n``: character references decoded, white space inside a block
made one space, ends trimmed; nothing else is dropped or capped.

Defined cases: null or empty html: empty text, 0 characters; html without any element: all its text; broken markup is parsed
as far as it goes; equal rows give equal results, one per row; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import defaultdict
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa

from ._text import kind

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg title textarea iframe select option datalist audio video canvas head".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCKS = (
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption "
    "tbody td tfoot th thead tr ul"
).split()
_BLOCK = {t: i for i, t in enumerate(BLOCKS)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("input button select textarea label".split())
#: a start tag closes an open element of these, up to the bound
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: groups of tokens of class, id and role
TOKENS = {
    "content": "content article post story entry body text main page copy prose blog news read",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs crumbs pager pagination tabs toc links topbar toolbar",
    "ad": "ad ads advert advertisement adv banner sponsor sponsored promo promotion promoted dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast warning paywall disclaimer privacy",
    "comment": "comment comments reply replies discussion respond disqus reviews feedback thread",
    "side": "sidebar side aside widget rail related recommended more popular trending tags share social follow secondary",
    "edge": "header footer foot head masthead copyright legal logo brand site colophon bottom top",
    "form": "form login signup subscribe subscription newsletter search register contact input signin",
}
_GROUP = {t: i for i, (_, words) in enumerate(TOKENS.items()) for t in words.split()}
_SEMANTIC = ("article", "main", "nav", "aside", "header", "footer", "form", "section")
_MARK = ""  # in training pages: the text after it is main text

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


class Page:
    """Block elements and text blocks of a page."""

    __slots__ = ("attrs", "blocks", "controls", "elements", "parent", "tags")

    def __init__(self, html: str):
        self.tags, self.attrs, self.parent = ["html"], [""], [-1]
        self.elements, self.controls = [0], [0]  # inline elements and controls right in each block element
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, its block element)
        where: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
        boxes = [0]  # places of the block elements
        buffer: list[str] = []
        links = linked = skip = 0

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
            linked = 0

        def push(tag: str, element: int):
            where[tag].append(len(stack))
            if tag in _BLOCK:
                boxes.append(len(stack))
            stack.append((tag, element))

        def close(depth: int):
            nonlocal links, skip
            if boxes[-1] >= depth:
                flush()
            while boxes[-1] >= depth:
                boxes.pop()
            for t, _ in stack[depth:]:
                where[t].pop()
                links -= t == "a"
                skip -= t in SKIPPED
            del stack[depth:]

        def text(raw: str):
            nonlocal linked
            if raw and not skip:
                piece = unescape(raw) if "&" in raw else raw
                buffer.append(piece)
                if links:
                    linked += len(piece.strip())

        at = look = 0  # the text not yet taken, and where to look for the next tag
        while True:
            look = html.find("<", look)
            m = _TAG.match(html, look) if look >= 0 else None
            if not m:
                if look < 0 or html[look + 1 : look + 2].isalpha():  # nothing closes a tag from here on
                    text(html[at:])
                    break
                look += 1
                continue
            text(html[at : m.start()])
            at = look = m.end()
            end, tag, attrs = m[1], m[2] or m[4], m[3] if m[2] else m[5]
            if end:
                end = end.lower()
                same = _HEADINGS if end in _HEADINGS else (end,)
                i = max((where[t][-1] for t in same if where.get(t)), default=0)
                if i and (end in _BLOCK or i > boxes[-1]):  # an inline end tag doesn't close blocks
                    close(i)
                continue
            if not tag:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if tag in ("html", "body") and not buffer:
                self.attrs[0] += attrs or ""
                continue
            if tag in RAW:
                m = _RAW_END[tag].search(html, at)
                at = look = m.end() if m else len(html)
                self.controls[stack[-1][1]] += tag == "textarea"
                continue
            if tag == "br":
                buffer.append(" ")
            if tag in _BLOCK and tag not in VOID:
                if tag in _IMPLIED:
                    closes, bound = _IMPLIED[tag]
                    above = max((where[t][-1] for t in bound if where.get(t)), default=0)
                    inside = [own[k] for t in closes if (own := where.get(t)) and (k := bisect_right(own, above)) < len(own)]
                    if inside:
                        close(min(inside))
                if stack[boxes[-1]][0] == "p":
                    close(boxes[-1])
                flush()
                self.tags.append(tag)
                self.attrs.append(attrs or "")
                self.parent.append(stack[-1][1])
                self.elements.append(0)
                self.controls.append(0)
                if not (attrs and attrs.rstrip().endswith("/") and tag in ("hr",)):
                    push(tag, len(self.tags) - 1)
                continue
            if tag == "hr":
                flush()
            owner = stack[-1][1]
            self.elements[owner] += 1
            self.controls[owner] += tag in _CONTROLS
            if tag not in VOID and not (attrs and attrs.endswith("/") and tag in SKIPPED):
                push(tag, owner)
                links += tag == "a"
                skip += tag in SKIPPED
        flush()


def token_groups(attrs: str) -> int:
    """Bits of the token groups that class, id and role touch."""
    bits = 0
    if "=" in attrs:
        for values in _ATTR.findall(attrs):
            for word in _WORD.findall("".join(values).lower()):
                g = _GROUP.get(word)
                if g is not None:
                    bits |= 1 << g
    return bits


def features(page: Page) -> np.ndarray:
    """A row of numbers for each block element."""
    n = len(page.tags)
    parent = page.parent
    own = np.zeros((n, 5))  # characters, link characters, sentence marks, words, blocks
    for e, text, links in page.blocks:
        row = own[e]
        row[0] += len(text)
        row[1] += links
        row[2] += text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count("。")
        row[3] += text.count(" ") + 1
        row[4] += 1
    depth, bits, above, nth, kids, same = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    twins: dict = {}
    for i in range(n):
        bits[i] = token_groups(page.attrs[i]) | (1 << (8 + _SEMANTIC.index(page.tags[i])) if page.tags[i] in _SEMANTIC else 0)
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p] | bits[p]
            nth[i] = kids[p]
            kids[p] += 1
            k = (p, page.tags[i])
            twins[k] = twins.get(k, 0) + 1
    tree = np.concatenate([own, np.zeros((n, 4))], 1)  # and elements, controls, paragraphs, items
    for i in range(n - 1, -1, -1):
        t = tree[i]
        t[5] += 1 + page.elements[i]
        t[6] += page.controls[i]
        t[7] += page.tags[i] == "p"
        t[8] += page.tags[i] == "li"
        if parent[i] >= 0:
            tree[parent[i]] += t
    before = np.cumsum(own[:, 0]) - own[:, 0]
    total = max(1.0, tree[0, 0])
    up = np.array([max(p, 0) for p in parent])
    siblings = np.array([kids[p] if p >= 0 else 1 for p in parent])
    same = np.array([twins.get((parent[i], page.tags[i]), 1) for i in range(n)])
    chars = np.maximum(tree[:, 0], 1)
    words = np.maximum(tree[:, 3], 1)
    columns = [
        [_BLOCK[t] for t in page.tags], depth, siblings, np.array(nth) / siblings, same / siblings,
        np.log1p(tree[:, 0]), tree[:, 1] / chars, tree[:, 2] / words, tree[:, 0] / tree[:, 5], tree[:, 0] / total, tree[:, 0] / words,
        tree[:, 6], tree[:, 7], tree[:, 8], np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), before / total,
        np.log1p(tree[up, 0]), tree[up, 1] / np.maximum(tree[up, 0], 1), np.array(kids),
    ]
    flags = (np.array(bits)[:, None] >> np.arange(16)) & 1
    inherited = (np.array(above)[:, None] >> np.arange(16)) & 1
    return np.column_stack([*columns, flags, inherited]).astype(np.float64)


class BoostedTrees:
    """Second-order boosting of regression trees for the logistic loss, on histograms of binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and cut of each inner node, value of each leaf

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: up to cuts[b]
        share = np.average(y, weights=weight)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                m, first = 2**level, 2**level - 1
                best, choice = np.zeros(m), [(0, self.bins)] * m
                for j in range(f):
                    key = node * self.bins + binned[:, j]
                    hg = np.bincount(key, g, m * self.bins).reshape(m, -1).cumsum(1)
                    hh = np.bincount(key, h, m * self.bins).reshape(m, -1).cumsum(1)
                    tg, th = hg[:, -1:], hh[:, -1:]
                    gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                    gain[(hh < self.least) | (th - hh < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(m), at]
                    for i in np.flatnonzero(top > best + 1e-9):
                        best[i], choice[i] = top[i], (j, int(at[i]))
                right = np.zeros(n, bool)
                for i, (j, b) in enumerate(choice):
                    inside = node == i
                    right[inside] = binned[inside, j] > b
                    feature[first + i], cut[first + i] = j, cuts[j][b] if b < len(cuts[j]) else np.inf
                node = 2 * node + right
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


_MAIN, _REST, _MIXED = range(3)
_MIX_COST = 2.0


def choose(parent: list[int], odds: np.ndarray) -> list[int]:
    """The label of each element: of all choices that nothing contradicts the one of the greatest total."""
    n = len(parent)
    # a mixed element's own text goes by its own sign, and each mixed element costs a little
    main, rest, mixed = odds.tolist(), (-odds).tolist(), (np.abs(odds) - _MIX_COST).tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        main[p] += main[i]
        rest[p] += rest[i]
        mixed[p] += max(main[i], rest[i], mixed[i])
    label = [_MIXED] * n  # the page as a whole is
    for i in range(1, n):
        up = label[parent[i]]
        label[i] = up if up != _MIXED else max(((mixed[i], _MIXED), (rest[i], _REST), (main[i], _MAIN)), key=lambda x: x[0])[1]
    return label


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """Texts of the blocks chosen as main."""
    label = choose(page.parent, odds)
    return [t for e, t, _ in page.blocks if label[e] == _MAIN or (label[e] == _MIXED and odds[e] > 0)]


# ---- training pages --------------------------------------------------------------------------


def training_pages(n: int, seed: int = 5):
    """Pages with articles and everything around them; main text stands after a mark."""
    r = random.Random(seed)
    syllables = "an er th on re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve ch ung und que ción ment".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def prose(k):
        out = [word() for _ in range(max(1, k))]
        for i in range(0, len(out), r.randint(5, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += r.choice([".", ".", ",", "!"])
        return " ".join(out) + r.choice([".", ".", ""])

    def named(tag, group, chance=0.75):
        if r.random() > chance:
            return f"<{tag}>"
        own = r.choice(TOKENS[group].split())
        if r.random() < 0.4:
            own += r.choice(["-", "_", " "]) + r.choice(["box", "wrap", "area", "inner", "list", "1", *TOKENS[group].split()])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{own}">'

    links = lambda k: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def nav():
        tag = r.choice(["nav", "nav", "div", "header"])
        body = f"<ul>{links(r.randint(2, 9))}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#">{word()}</a>' for _ in range(r.randint(2, 7)))
        return f"{named(tag, 'nav', 0.2 if tag == 'nav' else 0.95)}{body}</{tag}>"

    def boiler(kind_):
        if kind_ == "nav":
            return nav()
        if kind_ == "header":
            tag = r.choice(["header", "div"])
            return f"{named(tag, 'edge', 0.3 if tag == 'header' else 1)}{r.choice(['', f'<a href=/>{word()}</a>', f'<h1>{word()}</h1>'])}<p>{prose(r.randint(1, 6))}</p></{tag}>"
        if kind_ == "footer":
            tag = r.choice(["footer", "footer", "div"])
            return f"{named(tag, 'edge', 0.2 if tag == 'footer' else 1)}{r.choice(['&copy; ', '© 2024 ', ''])}{r.choice(['', '<p>'])}{word()}.example &middot; {prose(r.choice([1, 6, 15, 30, 60]))}</{tag}>"
        if kind_ == "ad":
            tag = r.choice(["div", "div", "aside", "section", "p"])
            return f"{named(tag, 'ad', 1)}{r.choice(['', '<a href=x>'])}{prose(r.randint(2, 25))}</{tag}>"
        if kind_ == "notice":
            tag = r.choice(["div", "section", "aside"])
            return f"{named(tag, 'notice', 1)}<p>{prose(r.randint(4, 40))}</p>{r.choice(['', '<button>ok</button>'])}</{tag}>"
        if kind_ == "side":
            tag = r.choice(["aside", "aside", "div"])
            body = f"<h3>{word()}</h3><ul>{links(r.randint(2, 8))}</ul>" if r.random() < 0.6 else f"<h4>{word()}</h4><p>{prose(r.randint(5, 60))}</p>"
            return f"{named(tag, 'side', 0.4 if tag == 'aside' else 1)}{body}</{tag}>"
        if kind_ == "form":
            return f"{named('form', 'form', 0.5)}<label>{word()}</label><input name=q>{r.choice(['', f'<p>{prose(8)}</p>'])}<button>{word()}</button></form>"
        tag = r.choice(["section", "div", "div", "ol"])  # reader comments
        inner = "li" if tag == "ol" else r.choice(["div", "article", "p"])
        items = "".join(f"{named(inner, 'comment', 0.6)}{r.choice(['', f'<b>{word()}</b> '])}{prose(r.randint(3, 50))}</{inner}>" for _ in range(r.randint(1, 5)))
        return f"{named(tag, 'comment', 1)}{r.choice(['', f'<h3>{word()}</h3>'])}{items}</{tag}>"

    def paragraph():
        x = r.random()
        t = _MARK + prose(r.choice([1, 2, 5, 12, 30, 60, 120]))
        if x < 0.06:
            return f"<ul>{''.join(f'<li>{_MARK}{prose(r.randint(2, 20))}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if x < 0.1:
            return f"<blockquote>{t}</blockquote>"
        if x < 0.16:
            return f"<h{r.randint(2, 4)}>{_MARK}{prose(r.randint(1, 6))}</h2>"
        if x < 0.19:
            return f"<pre>{t}</pre>"
        if x < 0.22:
            return f"<table><tr><td>{_MARK}{word()}<td>{_MARK}{prose(4)}</table>"
        if x < 0.3:
            return f"<p>{t} <a href=/{word()}>{word()}</a> <em>{prose(3)}</em></p>"
        if x < 0.36:
            return f"<p><b>{t}<br>"
        if x < 0.4:
            return f"<div>{t}</div>"
        return f"<p>{t}</p>"

    for _ in range(n):
        body = "".join(paragraph() for _ in range(r.choice([1, 1, 2, 2, 3, 5, 8, 14])))
        if r.random() < 0.8:
            body = f"<h1>{_MARK}{prose(r.randint(1, 9))}</h1>{body}"
        if r.random() < 0.35:
            cut = body.find("<p", len(body) // 2)
            if cut > 0:
                body = body[:cut] + "</b></p>" + boiler(r.choice(["ad", "side", "form"])) + body[cut:]
        if r.random() < 0.15:
            body += "</b></p>" + boiler("comments")
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        body = f"{named(tag, 'content', 0.3 if tag in ('article', 'main') else 0.9)}{body}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            wrap = r.choice(["div", "main", "section"])
            extra = boiler(r.choice(["side", "ad", "notice"])) if r.random() < 0.3 else ""
            body = f"{named(wrap, 'content', 0.4)}{body}{extra}</{wrap}>"
        front = [boiler(k) for k in ("nav", "header", "ad", "notice", "form", "side") if r.random() < 0.45]
        back = [boiler(k) for k in ("side", "comments", "ad", "form", "nav", "notice") if r.random() < 0.25]
        if r.random() < 0.85:
            back.append(boiler("footer"))
        if r.random() < 0.04:
            front, back, body = [], [], _MARK + prose(40)
        yield f"<!DOCTYPE html><html><head><title>{prose(4)}</title><script>var t='</p>';</script></head><body>{''.join(front)}{body}{''.join(back)}</body></html>"


def labelled(html: str) -> tuple[Page, np.ndarray, np.ndarray]:
    """A training page without marks, the share of main text of each element, and its characters."""
    page = Page(html)
    n = len(page.tags)
    main, chars = np.zeros(n), np.zeros(n)
    for e, text, _ in page.blocks:
        chars[e] += len(text)
        main[e] += len(text) * (_MARK in text)
    page.blocks = [(e, t.replace(_MARK, ""), k) for e, t, k in page.blocks]
    for i in range(n - 1, 0, -1):
        main[page.parent[i]] += main[i]
        chars[page.parent[i]] += chars[i]
    return page, main / np.maximum(chars, 1), chars


@cache
def model(pages: int = 900, seed: int = 5) -> BoostedTrees:
    """The trees, trained once a process."""
    x, y, w = [], [], []
    for html in training_pages(pages, seed):
        page, share, chars = labelled(html)
        pure = (chars > 0) & ((share < 0.02) | (share > 0.98))
        pure[0] |= chars[0] > 0
        f = features(page)
        x.append(f[pure])
        y.append((share[pure] > 0.5).astype(float))
        w.append(np.ones(int(pure.sum())))
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y), np.concatenate(w))


def extract(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    """Main text of each page."""
    parsed = [Page(h) if h else None for h in pages]
    rows = [features(p) for p in parsed if p is not None and p.blocks]
    odds = trees.predict(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        if p is None or not p.blocks:
            out.append("")
        else:
            own = odds[at : at + len(p.tags)]
            at += len(p.tags)
            out.append("\n".join(t for _, t, _ in p.blocks) if len(p.tags) == 1 else "\n".join(decode(p, own)))
    return out


def main_text(df, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", pages_at_once: int = 256):
    """Per row: id, url (if given), text, n_chars (its code points)."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(model())
    keep = [id_col] + ([url_col] if url_col else [])
    names = [*keep, "text", "n_chars"]

    def run(batches):
        trees = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, pages_at_once):
                part = batch.slice(lo, pages_at_once)
                texts = extract(part.column(part.num_columns - 1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    ddl = ", ".join(f"`{c}` {kind(df, c)}" for c in keep) + ", text string, n_chars long"
    return df.select(*[F.col(c) for c in keep], F.col(html_col).alias("_html")).mapInArrow(run, ddl)
