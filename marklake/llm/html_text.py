"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the borders of block elements.
A bidirectional LSTM (numpy) reads the sequence of a page's leaves, each as a vector
of its tag path (tags, classes, ids and roles, hashed), its hashed words, and a few
measures; so every leaf is judged with the whole page in view.  Leaves labelled as
content are joined in page order.

The labeller is trained here, on pages that :func:`sample_pages` composes from common
layouts with a fixed seed; it never sees the pages that it works on before it labels
them.

Defined results: a null or empty page has the text ``''``; broken markup is read as
browsers read it in the common cases (unclosed elements, stray ends, quotes left
open); very long and very deep pages take time and memory in proportion to their length;
repeated pages get equal results; an empty table gives an empty result;
further columns are not returned.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import column_bytes, rows_of, words

PATHS = 1024  # places for hashed tokens of the tag path
WORDS = 32
MEASURES = 8
HIDDEN = 16
SEED = 77
TRAIN_PAGES = 900
EPOCHS = 8
RATE = 0.01
STEP_CELLS = 1 << 16  # leaves, with padding, that the network reads at once

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # what HTML reads as mere text up to the end tag
SHOWN = "xmp"  # the one of them whose text a page shows, as it stands; read like ``pre``
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img noscript object canvas svg tspan math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": (("li",),), "dt": (("dt", "dd"),), "dd": (("dt", "dd"),), "tr": (("tr", "td", "th"),), "td": (("td", "th"),), "th": (("td", "th"),), "option": (("option",),), "optgroup": (("option",), ("optgroup",))}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div article section aside main nav body html form footer header select datalist".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"""=\s*+(["'])|>""")  # a quote counts only as the start of a value
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@lru_cache(1 << 14)
def path_ids(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed tokens of one element: its tag and the words of its class, id and role."""
    names = [tag]
    for _, a, b, c in _ATTR.findall(attributes) if attributes else ():
        for w in _PART.findall(a or b or c):
            w = w.lower()
            names.append(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    return tuple(zlib.crc32(w.encode()) % PATHS for w in names)


class Node:
    """An open element: its parent, and the path tokens that none of its ancestors has."""

    __slots__ = ("depth", "fresh", "parent")

    def __init__(self, parent: Node | None, fresh: tuple[int, ...]):
        self.parent, self.fresh, self.depth = parent, fresh, parent.depth + 1 if parent else 1

    def path(self) -> list[int]:
        """All tokens from the root on."""
        chain, node = [], self
        while node:
            chain.append(node.fresh)
            node = node.parent
        return [t for fresh in reversed(chain) for t in fresh]


ROOT = Node(None, (0,))  # stands for the path of text outside all elements


class Marks:
    """Tags of a page in order, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.closed, self.last = page, True, page.rfind(">")

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag; once a value's quote stays open to the end of the page, quotes count no more."""
        page, here = self.page, at
        while self.closed:
            m = _STOP.search(page, here)
            if m is None:
                break
            if not m[1]:
                return m.start()
            close = page.find(m[1], m.end())
            if close < 0:
                self.closed = False
                break
            here = close + 1
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """``(start, end, tag, is an end tag, attributes)`` of the next mark from ``at`` on; the tag is None for comments and the like."""
        page, n = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= n:
                return n, n, None, False, ""
            c = page[start + 1]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else n, None, False, ""
            if start < self.last:
                if c in "!?":
                    return start, page.find(">", start) + 1, None, False, ""
                if m := _NAME.match(page, start + 1):
                    end = self._end(m.end())
                    if end >= 0:
                        return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            at = start + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text of a raw element ends, its end tag included."""
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)


class Stack:
    """The open elements, with the places of each kind, so that no search walks through them."""

    def __init__(self):
        self.tags: list[str] = []
        self.nodes: list[Node] = []
        self.ids: list[tuple[int, ...]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.held: dict[int, int] = defaultdict(int)  # how many open elements have a token
        self.blocks: list[int] = []
        self.holders: list[int] = []

    def push(self, tag: str, ids: tuple[int, ...]) -> None:
        at = len(self.tags)
        self.nodes.append(Node(self.nodes[-1] if self.nodes else None, tuple(dict.fromkeys(t for t in ids if not self.held[t]))))
        self.tags.append(tag)
        self.ids.append(ids)
        self.where[tag].append(at)
        for t in ids:
            self.held[t] += 1
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in HOLDERS:
            self.holders.append(at)

    def pop_to(self, at: int) -> None:
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.nodes.pop()
            self.where[tag].pop()
            for t in self.ids.pop():
                self.held[t] -= 1
        for places in (self.blocks, self.holders):
            while places and places[-1] >= at:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where[t]), default=-1)

    def close(self, tag: str) -> None:
        """An end tag: an inline one reaches no further than the block that it stands in."""
        at = self.last(tag)
        if at >= 0 and (tag not in INLINE or at > (self.blocks[-1] if self.blocks else -1)):
            self.pop_to(at)

    def close_within(self, *tags: str) -> None:
        """End the newest of these elements inside the element that holds them."""
        at = self.last(*tags)
        if at > (self.holders[-1] if self.holders else -1):
            self.pop_to(at)


def _raw_stop(page: str, tag: str, at: int, end: int) -> int:
    """Where the mere text ends that lies before ``end``: at the end tag, if there is one."""
    found = page.rfind("<", at, end)
    return found if found >= 0 and page[found + 1 : found + 2 + len(tag)].lower() == f"/{tag}" else end


def leaves(page: str) -> list[tuple[str, Node, int, int]]:
    """``(text, path, characters inside links, depth)`` of every leaf block with text."""
    out: list = []
    marks, stack = Marks(page), Stack()
    pieces: list[str] = []
    where: Node | None = None
    linked = 0

    def flush():
        nonlocal pieces, where, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, where, linked, 0 if where is ROOT else where.depth))
            pieces, where, linked = [], None, 0

    def put(raw: str, plain: bool = False):
        nonlocal where, linked
        if where is None:
            if not raw.strip():
                return
            where = stack.nodes[-1] if stack.nodes else ROOT
        s = html.unescape(raw) if "&" in raw and not plain else raw
        pieces.append(s)
        if stack.where["a"]:
            linked += len(s)

    at, n = 0, len(page)
    while at < n:
        start, end, tag, ends, attributes = marks.next(at)
        if start > at:
            put(page[at:start])
        at = end
        if tag is None:
            continue
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if not ends and tag in RAW:
            if not (attributes.endswith("/") and (stack.where["svg"] or stack.where["math"])):
                stop = marks.raw_end(tag, at)
                if tag == SHOWN:
                    flush()
                    stack.close_within("p")
                    stack.push("pre", path_ids("pre", attributes))
                    put(page[at : _raw_stop(page, tag, at, stop)], plain=True)
                    flush()
                    stack.close("pre")
                at = stop
            continue
        if tag not in INLINE:
            flush()
        if ends:
            stack.close(tag)
            continue
        if tag in CLOSES_P:
            stack.close_within("p")
        for own in CLOSES_OWN.get(tag, ()):
            stack.close_within(*own)
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.push(tag, path_ids(tag, attributes))
    flush()
    return out


class Pages:
    """Leaves of several pages with the inputs of the network."""

    def __init__(self, pages: list[list]):
        self.count = np.array([len(p) for p in pages], np.int64)
        every = [leaf for p in pages for leaf in p]
        self.texts = [leaf[0] for leaf in every]
        # the elements above the leaves, each once, parents before children
        number: dict[int, int] = {}
        nodes: list[Node] = []
        for leaf in every:
            chain, node = [], leaf[1]
            while node is not None and id(node) not in number:
                number[id(node)] = -1
                chain.append(node)
                node = node.parent
            for node in reversed(chain):
                number[id(node)] = len(nodes)
                nodes.append(node)
        self.node = np.array([number[id(leaf[1])] for leaf in every], np.int64)
        self.parent = np.array([number[id(x.parent)] if x.parent else -1 for x in nodes], np.int64)
        self.fresh = np.array([t for x in nodes for t in x.fresh], np.int64)
        self.fresh_at = np.concatenate(([0], np.cumsum([len(x.fresh) for x in nodes]))).astype(np.int64)
        depth = np.array([x.depth for x in nodes], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        n = len(every)
        data, at = column_bytes(pa.array(self.texts, pa.large_string()))
        h, off, _ = words(data, at)
        bag = np.bincount(rows_of(off) * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS) if n else np.zeros((0, WORDS))
        self.words = (0.5 * bag / np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1)).astype(np.float32)
        size = np.maximum(np.diff(at), 1)
        n_words = np.diff(off)
        page = np.repeat(np.arange(len(pages)), self.count)
        self.paths = [leaf[1] for leaf in every]
        first = np.cumsum(self.count) - self.count
        place = (np.arange(n) - first[page]) / np.maximum(self.count[page] - 1, 1) if n else np.zeros(0)
        stops = np.bincount(rows_of(at)[np.isin(data, [46, 44, 33, 63])], minlength=n) if n else np.zeros(0)
        self.measures = np.stack(
            [np.minimum(np.log1p(n_words) / 5, 1.5), np.minimum([leaf[2] / max(1, len(leaf[0])) for leaf in every], 1), np.minimum([leaf[3] / 10 for leaf in every], 2), place, np.minimum(stops / np.maximum(n_words, 1), 1), np.minimum(np.log1p(size) / 8, 1.5), np.ones(n), np.minimum(np.log1p(self.count[page]) / 6, 1.5)],
            axis=1,
        ).astype(np.float32) if n else np.zeros((0, MEASURES), np.float32)


    def path_sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the vectors of each leaf's path tokens: what an element adds is added to its parent's sum, level by level."""
        sums = np.zeros((len(self.parent), vectors.shape[1]), vectors.dtype)
        some = np.flatnonzero(np.diff(self.fresh_at))
        if len(some):
            sums[some] = np.add.reduceat(vectors[self.fresh], self.fresh_at[some], axis=0)
        for level in self.levels[1:]:
            sums[level] += sums[self.parent[level]]
        return sums[self.node]

    def path_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All path tokens of the leaves, and how many each has (for training, on small pages)."""
        paths = [node.path() for node in self.paths]
        return np.array([t for p in paths for t in p], np.int64), np.array([len(p) for p in paths], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output for each leaf."""

    def __init__(self, rng: np.random.Generator):
        h, small = HIDDEN, 0.1
        self.p = {}
        for d in "fb":
            self.p[f"path_{d}"] = rng.normal(0, small, (PATHS, 4 * h))
            self.p[f"word_{d}"] = rng.normal(0, small, (WORDS, 4 * h))
            self.p[f"measure_{d}"] = rng.normal(0, small, (MEASURES, 4 * h))
            self.p[f"state_{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.p[f"measure_{d}"][6, h : 2 * h] = 1.0  # forget gates start open
        self.p["out"] = rng.normal(0, small, (2 * h + 1,))

    def inputs(self, x: Pages, d: str) -> np.ndarray:
        p = self.p
        return x.path_sums(p[f"path_{d}"]) + x.words @ p[f"word_{d}"] + x.measures @ p[f"measure_{d}"]

    @staticmethod
    def grid(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf numbers laid out as pages x steps, and which cells hold one."""
        steps = int(count.max())
        first = np.cumsum(count) - count
        lane = np.arange(steps)
        real = lane[None, :] < count[:, None]
        return np.where(real, first[:, None] + lane[None, :], 0), real

    def run(self, z: np.ndarray, real: np.ndarray, d: str, keep: bool):
        """States of every cell; backwards for ``b``.  A missing leaf leaves the state as it is."""
        b, steps, h = *real.shape, HIDDEN
        w = self.p[f"state_{d}"]
        hs, c, s = np.zeros((b, steps, h)), np.zeros((b, h)), np.zeros((b, h))
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + s @ w
            i, f, o, g = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            m = real[:, t, None]
            c2 = np.where(m, f * c + i * g, c)
            th = np.tanh(c2)
            s2 = np.where(m, o * th, s)
            if keep:
                saved.append((t, i, f, o, g, c, th, s))
            c, s = c2, s2
            hs[:, t] = s
        return hs, saved

    def logits(self, x: Pages) -> np.ndarray:
        cells, real = self.grid(x.count)
        h = np.concatenate([self.run(self.inputs(x, d)[cells], real, d, False)[0] for d in "fb"], axis=2)
        out = h @ self.p["out"][:-1] + self.p["out"][-1]
        return out[real]

    def step(self, x: Pages, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients over one batch of pages."""
        cells, real = self.grid(x.count)
        runs_ = {d: self.run(self.inputs(x, d)[cells], real, d, True) for d in "fb"}
        h = np.concatenate([runs_[d][0] for d in "fb"], axis=2)
        prob = _sigmoid(h @ self.p["out"][:-1] + self.p["out"][-1])
        target = np.where(real, y[cells], 0)
        n = real.sum()
        loss = -np.where(real, target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9), 0).sum() / n
        delta = np.where(real, prob - target, 0) / n
        grad = {"out": np.append(np.einsum("bt,bth->h", delta, h), delta.sum())}
        dh_all = delta[:, :, None] * self.p["out"][:-1]
        hid = HIDDEN
        tokens, many = x.path_tokens()
        for k, d in enumerate("fb"):
            w = self.p[f"state_{d}"]
            dh_own = dh_all[:, :, k * hid : (k + 1) * hid]
            dz = np.zeros((*real.shape, 4 * hid))
            dw = np.zeros_like(w)
            ds, dc = np.zeros((len(real), hid)), np.zeros((len(real), hid))
            for t, i, f, o, g, c, th, s in reversed(runs_[d][1]):
                m = real[:, t, None]
                total = ds + dh_own[:, t]
                do, dcell = total * th, dc + total * o * (1 - th * th)
                da = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g * g)), axis=1) * m
                dz[:, t] = da
                dw += s.T @ da
                ds = np.where(m, da @ w.T, total)
                dc = np.where(m, dcell * f, dc)
            flat = dz[real]
            gp = np.zeros((PATHS, 4 * hid))
            np.add.at(gp, tokens, np.repeat(flat, many, axis=0))
            grad |= {f"state_{d}": dw, f"path_{d}": gp, f"word_{d}": x.words.T @ flat, f"measure_{d}": x.measures.T @ flat}
        return loss, grad


# Word lists of common page layouts; they are training material of this module.
_CONTENT = "article post entry content story main body text".split()
_OTHER = {
    "nav": "nav menu navbar navigation breadcrumb pagination toc skip".split(),
    "header": "header masthead topbar banner logo branding tagline".split(),
    "footer": "footer copyright legal bottom colophon imprint".split(),
    "aside": "aside sidebar widget related recommended trending popular more teaser".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner commercial".split(),
    "notice": "notice cookie consent alert gdpr banner modal popup message paywall warning overlay".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comment": "comment comments reply replies discussion disqus respond feedback thread".split(),
    "share": "share social follow tags meta byline rating".split(),
}
_TAG = {"nav": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "section", "ins", "p"), "notice": ("div", "section", "aside", "p"), "form": ("form", "div", "section"), "comment": ("section", "div", "ol", "ul", "article"), "share": ("div", "ul", "p")}
CONTENT_MARK, OTHER_MARK = "\ue000", "\ue001"  # private-use characters


def sample_pages(n: int, seed: int) -> list[str]:
    """Pages in random layouts; the first character of each text tells its label."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "ba be do ka lo mi ne or pa ri sa te un vo er an in th".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def text(mark, low, high):
        ws = [word() for _ in range(int(rng.integers(low, high + 1)))]
        if rng.random() < 0.06:
            ws = ws[:1] * len(ws)
        if rng.random() < 0.5:
            ws = [w + pick([",", ".", ""]) if rng.random() < 0.2 else w for w in ws]
        return mark + " ".join(ws).capitalize() + pick([".", ".", "", "!"])

    def attribute(names, telling=False):
        if rng.random() < 0.12 and not telling:
            return f' class="{word()}"' if rng.random() < 0.5 else ""
        own = pick(names)
        style = rng.random()
        if style < 0.25:
            own = f"{own}-{pick(['box', 'area', 'list', 'block', 'wrap', 'inner', word()])}"
        elif style < 0.35:
            own = f"{word()} {own}"
        elif style < 0.4:
            own = f"{pick(['site', 'page', 'top', 'post'])}-{own}"
        return f' {pick(["class", "class", "id"])}="{own}"'

    def paragraphs(mark, low, high, short=False):
        out = []
        for _ in range(int(rng.integers(low, high + 1))):
            t = text(mark, 1, 12) if short or rng.random() < 0.2 else text(mark, 5, 90)
            kind = rng.random()
            if kind < 0.8:
                out.append(f"<p>{t}</p>")
            elif kind < 0.86:
                out.append(f"<p><b>{t}<br>")
            elif kind < 0.92:
                out.append(f"<blockquote>{t}</blockquote>")
            else:
                out.append("<ul>" + "".join(f"<li>{text(mark, 2, 12)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        return "".join(out)

    def other(kind, inside_article=False):
        tag, m = pick(_TAG[kind]), OTHER_MARK
        named = tag in (kind, "nav", "header", "footer", "aside", "form") and not inside_article
        a = attribute(_OTHER[kind], not named) if not named or rng.random() < 0.5 else ""
        if tag == "p":
            body = text(m, 2, 30)
        elif kind in ("nav", "share", "aside") and rng.random() < 0.75 or kind == "nav":
            items = [f'<a href="/{word()}">{text(m, 1, 4)}</a>' for _ in range(int(rng.integers(2, 9)))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)
        elif kind == "form":
            body = f"<label>{text(m, 1, 5)}</label><input name=q><button>{text(m, 1, 2)}</button>" + (f"<p>{text(m, 4, 25)}</p>" if rng.random() < 0.5 else "")
        elif kind == "comment":
            heading = f"<h3>{text(m, 1, 3)}</h3>" if rng.random() < 0.6 else ""
            body = heading + "".join(f'<div{attribute(_OTHER["comment"])}><p>{text(m, 4, 60)}</p></div>' if rng.random() < 0.6 else f"<{x}>{text(m, 4, 60)}</{x}>" for x in [pick(["p", "li"]) for _ in range(int(rng.integers(1, 5)))])
        elif rng.random() < 0.5:
            body = text(m, 2, 30)
        else:
            body = paragraphs(m, 1, 3)
        return f"<{tag}{a}>{body}</{tag}>"

    pages = []
    for _ in range(n):
        before = [other(pick(["nav", "header", "nav", "ad", "notice", "form", "share"])) for _ in range(int(rng.integers(0, 4)))]
        after = [other(pick(["aside", "ad", "footer", "comment", "form", "notice", "share", "comment", "nav"])) for _ in range(int(rng.integers(0, 5)))]
        size = "h1" if rng.random() < 0.8 else pick(["h2", "h3"])
        heading = f"<{size}>{text(CONTENT_MARK, 2, 14)}</{size}>" if rng.random() < 0.88 else ""
        parts = [heading]
        for _ in range(int(rng.integers(1, 5))):
            if rng.random() < 0.3:
                parts.append(f"<h2>{text(CONTENT_MARK, 1, 8)}</h2>")
            parts.append(paragraphs(CONTENT_MARK, 1, 5))
            if rng.random() < 0.25:
                parts.append(other(pick(["ad", "aside", "share", "form", "notice"]), True))
        if rng.random() < 0.15:
            parts.append(other("comment", True))
        body, shape = "".join(parts), rng.random()
        if shape < 0.55:
            body = f"<article{attribute(_CONTENT) if rng.random() < 0.3 else ''}>{body}</article>"
        elif shape < 0.7:
            body = f"<main>{body}</main>"
        elif shape < 0.9:
            body = f"<div{attribute(_CONTENT)}>{body}</div>"
        elif shape < 0.96:  # columns of a table
            side = other(pick(["nav", "aside", "ad"]))
            body = f"<table><tr><td{attribute(_OTHER['nav']) if rng.random() < 0.5 else ''}>{side}</td><td>{body}</td></tr></table>"
        if rng.random() < 0.25:
            body = f"<main>{body}</main>" if rng.random() < 0.5 else f'<div class="{pick(["container", "wrapper", "page", word()])}">{body}</div>'
        footer = f"<footer>{text(OTHER_MARK, 2, 14)}</footer>" if rng.random() < 0.6 else ""
        pages.append(f"<html><head><title>{word()}</title></head><body>{''.join(before)}{body}{''.join(after)}{footer}</body></html>")
    return pages


@lru_cache(2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, fitted by Adam on composed pages; equal for equal parameters."""
    parsed = []
    for page in sample_pages(pages, seed):
        own = [(t[1:], *rest) for t, *rest in leaves(page)] if page else []
        marks = [t[0] == CONTENT_MARK for t, *_ in leaves(page)]
        if own:
            parsed.append((own, np.array(marks, float)))
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    net = Labeller(rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    parsed.sort(key=lambda x: len(x[0]))
    batches = [parsed[i : i + 32] for i in range(0, len(parsed), 32)]
    ready = [(Pages([p for p, _ in b]), np.concatenate([y for _, y in b])) for b in batches]
    turn = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(ready)):
            turn += 1
            _, grad = net.step(*ready[k])
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
            for name, g in grad.items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                net.p[name] -= rate * m[name] / (np.sqrt(v[name]) + 1e-8)
                if name.startswith("path"):
                    net.p[name] *= 1 - 0.002 * RATE
    return net


def main_text(net: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page."""
    cut = [leaves(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(cut[order[end]]) <= STEP_CELLS:
            end += 1
        x = Pages([cut[i] for i in order[at:end]])
        keep = net.logits(x) > 0
        first = 0
        for i in order[at:end]:
            n = len(cut[i])
            out[i] = "\n".join(leaf[0] for leaf, k in zip(cut[i], keep[first : first + n].tolist()) if k)
            first += n
        at = end
    return out


def extract(spark: SparkSession, pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id_col, url_col, text, n_chars``."""
    net = spark.sparkContext.broadcast(trained())
    df = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes[:2]), "text string", "n_chars long"])

    def work(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = main_text(net.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return df.mapInArrow(work, schema)
