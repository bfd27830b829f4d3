"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with its tag path.
Each block becomes a vector of hashed path steps (tag, class, id and role words), hashed words
and a few counts. A bidirectional LSTM in numpy reads the whole sequence of a page and labels
each block as main text or not.

The labeller is fitted on pages that ``SitePages`` writes itself: articles between menus,
adverts, notices, forms, comment lists and footers, in many layouts, with true labels for every
block. No row of the input is used for it; the seed makes it the same on each run and node.

Defined results: a null or empty page gives the empty text; character references are decoded;
white space within a block becomes one space; blocks are joined by one newline in page order;
unclosed tags, stray tags and pages without a body are taken as they come; after a quote that is never
closed tags end at the next >, and a tag without end ends the page; contents of script,
style, title, textarea, template and iframe are no text, and such an element without an end goes to
the end of its block; very long pages are read whole, in one sequence; equal pages give equal texts; other columns pass through unless
they bear a result's name.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 96, 16, 8, 20
TRAIN_PAGES, EPOCHS, SEED = 700, 14, 7

#: Elements that start and end a block.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio canvas template".split())
#: Elements whose content is never text of the page.
_RAW = frozenset("script style template textarea title iframe".split())
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is still open.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}
#: Elements that bound the search for something to close.
_SCOPE = frozenset("html body table td th ul ol dl article section div aside nav footer header main form blockquote".split())

#: A comment, CDATA section, declaration or the start of a tag; a tag with its quoted values; one without regard to quotes.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?(?=[a-zA-Z])", re.S)
_TAG = re.compile(r"</?(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_PLAIN_TAG = re.compile(r"</?[^>]*+>")
#: Steps of a path that are kept at either end.
_STEPS = 32
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
#: Private-use characters that mark main text and other text of a page made for training.
_OWN, _OTHER = "\ue001", "\ue002"


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters within links) of each block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)
    endless: set[str] = set()
    opened: Counter[str] = Counter()
    quotes = True

    def flush() -> None:
        nonlocal linked
        if text:
            body = _WHITE.sub(" ", html.unescape("".join(text))).strip()
            if body:
                near = stack if len(stack) <= 2 * _STEPS else stack[:_STEPS] + stack[-_STEPS:]
                out.append((tuple(x[1] for x in near), body, min(linked, len(body))))
            text.clear()
        linked = 0

    def close(names: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                opened.subtract(x[0] for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in _SCOPE:
                return

    def parent_end(at: int) -> int:
        """Where the first of the open blocks ends after ``at``: by its own end tag, or what closes it if left open."""
        end = n
        for name in {x[0] for x in stack}:
            depth = 1
            for m in re.compile(rf"<(/?){re.escape(name)}(?![^\s/>])", re.I).finditer(page, at, end):
                depth += -1 if m[1] or name in _CLOSES.get(name, ()) else 1
                if not depth:
                    end = m.start()
                    break
        return end

    while at < n:
        m = _MARK.search(page, at)
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        tag, at = m.group(), m.end()
        if tag[1:2] in ("!", "?"):
            if tag.startswith("<![CDATA["):
                text.append(tag[9:].removesuffix("]]>"))
            continue
        # a page with a quote that is never closed has its tags end at the next >, from there on; a tag without end is the last thing
        m = _TAG.match(page, end) if quotes else None
        if not m:
            quotes, m = False, _PLAIN_TAG.match(page, end)
        if not m:
            break
        tag, at = m.group(), m.end()
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in _BLOCK:
                flush()
                if opened[name] > 0:
                    while True:
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
            elif name == "br":
                text.append(" ")
            continue
        if name in _RAW:
            if not tag.endswith("/>"):
                stop = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if not stop:
                    endless.add(name)
                at = stop.end() if stop else parent_end(at)
            text.append(" ") if name not in _BLOCK else flush()
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = 1
        elif name in _BLOCK:
            flush()
            close(_CLOSES.get(name, ()))
            if name not in _VOID and not tag.endswith("/>"):
                marks = [next((v for v in a.groups()[1:] if v), "") if a[1].lower() in ("class", "id", "role", "itemprop") else a[1].lower() + (next((v for v in a.groups()[1:] if v), "")) for a in _ATTR.finditer(tag)] if " " in tag else []
                stack.append((name, " ".join([name, *marks]).lower()))
                opened[name] += 1
    flush()
    return out


def _slot(s: str, dim: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % dim


@functools.lru_cache(maxsize=100_000)
def _step_slots(step: str, depth: int) -> tuple[int, ...]:
    tag, _, marks = step.partition(" ")
    return (_slot(f"t:{tag}", PATH_DIM // 2), *(PATH_DIM // 2 + _slot(f"m:{w}", PATH_DIM // 2) for w in _WORD.findall(marks)))


@functools.lru_cache(maxsize=100_000)
def _word_slot(word: str) -> int:
    return _slot("w:" + word.lower(), WORD_DIM)


def block_vector(path: tuple[str, ...], text: str, linked: int, at: int, of: int) -> np.ndarray:
    v = np.zeros(PATH_DIM + WORD_DIM + EXTRA, dtype=np.float32)
    for d, step in enumerate(path):
        for s in _step_slots(step, 0):
            v[s] = 1.0
    words = text.split(" ")
    v[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(list(map(_word_slot, words)), minlength=WORD_DIM) / len(words)
    n = len(text)
    v[-EXTRA:] = [min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(len(words)) / 6), linked / n, sum(text.count(c) for c in ".!?") / n * 10, at / max(1, of - 1), min(1.0, len(path) / 12), float(text[-1] in ".!?"), 1.0]
    return v


class BlockLabeller:
    """A bidirectional LSTM with one logistic output; arrays only, so it travels in a closure."""

    def __init__(self, seed: int = SEED, dim: int = PATH_DIM + WORD_DIM + EXTRA, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.15, (dim, 4 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = r.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.p[f"b{d}"] = bias
        self.p["o"] = r.normal(0, 0.2, 2 * hidden).astype(np.float32)
        self.p["c"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 0.5 * (np.tanh(0.5 * x) + 1.0)

    def _walk(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (pages, steps, hidden) in reading order of direction ``d``; masked steps carry the state on."""
        n, steps, _ = x.shape
        h, c, k = np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32), self.h
        pre = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        out, trail = np.zeros((n, steps, k), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"u{d}"]
            i, f, o = self._sig(z[:, :k]), self._sig(z[:, k : 2 * k]), self._sig(z[:, 2 * k : 3 * k])
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                trail.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, trail

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._walk(x, mask, "f", False)[0], self._walk(x, mask, "b", False)[0]
        return self._sig(np.concatenate([hf, hb], axis=2) @ self.p["o"] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        (hf, tf), (hb, tb) = self._walk(x, mask, "f", True), self._walk(x, mask, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        err = (self._sig(both @ self.p["o"] + self.p["c"]) - y) * mask / max(1.0, mask.sum())
        grads = {"o": np.einsum("nt,nth->h", err, both), "c": np.array([err.sum()], dtype=np.float32)}
        k = self.h
        for d, trail, part in (("f", tf, slice(0, k)), ("b", tb, slice(k, 2 * k))):
            own = err[:, :, None] * self.p["o"][part]
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            du, dpre = np.zeros_like(self.p[f"u{d}"]), np.zeros((*x.shape[:2], 4 * k), np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(trail):
                dh = dh + own[:, t]
                live = dh * m
                dcc = live * o * (1 - tc**2) + dc * m
                dz = np.concatenate([dcc * g * i * (1 - i), dcc * c * f * (1 - f), live * tc * o * (1 - o), dcc * i * (1 - g**2)], axis=1)
                dpre[:, t] = dz
                du += h.T @ dz
                dh = dh * (1 - m) + dz @ self.p[f"u{d}"].T
                dc = dcc * f + dc * (1 - m)
            grads |= {f"u{d}": du, f"b{d}": dpre.sum(axis=(0, 1)), f"w{d}": np.einsum("ntd,ntk->dk", x, dpre)}
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> BlockLabeller:
        r, m1, m2, step = np.random.default_rng(seed), {}, {}, 0
        for e in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                x, mask, y = padded([pages[i][0] for i in order[at : at + batch]], [pages[i][1] for i in order[at : at + batch]])
                step += 1
                speed = rate * (1.0 if e < epochs * 2 // 3 else 0.25)
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1.get(k, 0) + 0.1 * g
                    m2[k] = 0.999 * m2.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - speed * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(map(len, xs))
    x = np.zeros((len(xs), steps, xs[0].shape[1]), np.float32)
    mask, y = np.zeros((len(xs), steps), np.float32), np.zeros((len(xs), steps), np.float32)
    for i, a in enumerate(xs):
        x[i, : len(a)], mask[i, : len(a)] = a, 1.0
        if ys is not None:
            y[i, : len(a)] = ys[i]
    return x, mask, y


class SitePages:
    """Pages of many invented layouts with the true label of each block."""

    #: Words of class and id attributes for what is not main text, and for what is.
    SIDE = {"nav": "nav menu navbar navigation breadcrumb topbar links pager pagination", "ad": "ad ads advert advertisement sponsored banner promo sponsor", "notice": "cookie notice consent banner alert gdpr newsletter popup modal subscribe", "side": "sidebar aside related widget recommended popular trending rail secondary", "foot": "footer foot copyright legal bottom colophon", "head": "header masthead site-header top logo branding", "comment": "comment comments reply discussion respond thread disqus", "form": "form search login signup subscribe contact", "share": "share social tools meta tags byline toolbar"}
    MAIN = "article content post entry story main text body article-body post-content entry-content main-content"

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)
        self.parts = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouéèöüñ") for _ in range(self.r.randint(1, 2))) for _ in range(400)]

    def words(self, lo: int, hi: int) -> str:
        w = ["".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.1:
            mark = self.r.choice(["###", "$$$", "%%%", "&amp;&amp;", "***", "!!", " |"])
            w = [x + mark for x in w]
        return " ".join(w).capitalize()

    def prose(self, lo: int = 4, hi: int = 90) -> str:
        if self.r.random() < 0.25:
            lo, hi = 1, 6
        s = self.words(lo, hi)
        return s + self.r.choice([".", ".", ".", "!", "?", "", ".&quot;"])

    def mark(self, kind: str) -> str:
        words = (self.MAIN if kind == "main" else self.SIDE[kind]).split()
        pick = self.r.choice(words)
        how = self.r.random()
        return f' class="{pick}"' if how < 0.6 else f' id="{pick}"' if how < 0.8 else f' class="{pick} c{self.r.randint(1, 99)}" id="{self.r.choice(words)}"'

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 3)}</a>' for _ in range(n)]

    def side(self, kind: str) -> str:
        r = self.r
        tags = {"nav": "nav", "ad": "div", "notice": "div", "side": "aside", "foot": "footer", "head": "header", "comment": "section", "form": "form", "share": "div"}
        tag = tags[kind] if r.random() < 0.75 else r.choice(["div", "section"])
        mark = self.mark(kind) if tag == "div" or tag == "section" or r.random() < 0.4 else ""
        if kind in ("nav", "side") and r.random() < 0.8:
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(r.randint(2, 9))) + "</ul>"
            body = (f"<h3>{self.words(1, 3)}</h3>" if kind == "side" and r.random() < 0.6 else "") + body
        elif kind == "comment":
            body = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.7 else "") + "".join(f"<div{self.mark('comment')}><p>{self.prose(3, 60)}</p></div>" if r.random() < 0.6 else f"<p>{self.prose(3, 60)}</p>" if r.random() < 0.5 else f"<li>{self.prose(3, 60)}</li>" for _ in range(r.randint(1, 6)))
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input type=text><select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>"
        elif kind == "foot":
            body = "&copy; " + self.words(1, 3) + " &middot; " + self.prose(1, 16) if r.random() < 0.7 else f"<p>{self.prose(2, 20)}</p>" + "".join(self.links(3))
        elif kind == "head":
            body = r.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "{}"]).format(self.words(1, 5))
        else:
            body = self.prose(2, 24) if r.random() < 0.6 else "".join(f"<p>{self.prose(2, 40)}</p>" for _ in range(r.randint(1, 3)))
        return f"<{tag}{mark}>{body}</{tag}>"

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        """(html, ordered pieces with label): pieces are fed to the cutter one by one to count their blocks."""
        r, out = self.r, []
        for kind in ("notice", "head", "nav", "ad", "form", "side", "share"):
            if r.random() < {"nav": 0.85, "ad": 0.6}.get(kind, 0.35):
                out.append((self.side(kind), 0))
        r.shuffle(out) if r.random() < 0.3 else None
        how = r.random()
        tag, mark = ("article", "") if how < 0.45 else ("article", self.mark("main")) if how < 0.55 else ("main", "") if how < 0.65 else (r.choice(["div", "section"]), self.mark("main"))
        wrap = f"<div{self.mark('main')}>" if r.random() < 0.2 else "<main>" if r.random() < 0.15 and tag != "main" else ""
        out.append((f"{wrap}<{tag}{mark}>", -1))
        title = self.words(1, 10)
        if r.random() < 0.85:
            out.append((f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>" if r.random() < 0.5 else f"<h2>{title}</h2>", 1))
        for _ in range(r.randint(1, 3) if r.random() < 0.3 else r.randint(1, 18)):
            x = r.random()
            out.append((f"<p>{self.prose()}</p>" if x < 0.68 else f"<p><b>{self.prose()}<br>" if x < 0.78 else f"<h2>{self.words(1, 6)}</h2>" if x < 0.83 else "<ul>" + "".join(f"<li>{self.prose(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>" if x < 0.88 else f"<blockquote>{self.prose()}</blockquote>" if x < 0.91 else f"<pre>{self.prose()}</pre>" if x < 0.93 else f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>" if x < 0.96 else f'<p>{self.prose()} <a href="#">{self.words(1, 3)}</a> {self.prose()}</p>', 1))
            if r.random() < 0.05:
                out.append((self.side(r.choice(["ad", "share", "form", "side", "notice", "nav"])), 0))
        if r.random() < 0.05:
            # a long run of the same paragraph, and now and then a long list of links after it
            out += [(f"<p>{self.prose(1, 20)}</p>", 1)] * r.randint(20, 150)
        if r.random() < 0.15:
            out.append((self.side("comment"), 0))
        out.append((f"</{tag}>" + ("</div>" if wrap.startswith("<div") else "</main>" if wrap else ""), -1))
        if r.random() < 0.03:
            out.append((f"<nav><ul>{''.join(f'<li>{x}</li>' for x in self.links(r.randint(20, 100)))}</ul></nav>", 0))
        for kind in ("share", "ad", "side", "comment", "form", "notice", "nav"):
            if r.random() < {"comment": 0.45, "side": 0.4}.get(kind, 0.2):
                out.append((self.side(kind), 0))
        if r.random() < 0.9:
            out.append((self.side("foot"), 0))
        return out

    def labelled(self) -> tuple[list[tuple[tuple[str, ...], str, int]], np.ndarray]:
        """Blocks of one page with their labels; each block carries a mark of its piece while it is cut."""
        pieces = self.page()
        marked = "".join(re.sub(r">(?=[^<>\s])", f">{_OWN if lab else _OTHER}", p) if lab >= 0 else p for p, lab in pieces)
        found = blocks_of(f"<!DOCTYPE html><html><head><title>t</title></head><body>{marked}</body></html>")
        labels = [1.0 if _OWN in b[1] else 0.0 for b in found]
        clean = [(b[0], b[1].replace(_OWN, "").replace(_OTHER, "").strip() or "x", b[2]) for b in found]
        return clean, np.array(labels, dtype=np.float32)


def page_matrix(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    return np.stack([block_vector(p, t, k, i, len(blocks)) for i, (p, t, k) in enumerate(blocks)])


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """The labeller, fitted once in a process."""
    site, data = SitePages(seed), []
    while len(data) < pages:
        blocks, y = site.labelled()
        if blocks:
            data.append((page_matrix(blocks), y))
    return BlockLabeller(seed).fit(data, epochs)


def main_texts(pages: list[str], model: BlockLabeller, cells: int = 60_000) -> list[str]:
    """Main text of each page; pages of similar length share a batch of at most ``cells`` steps (one page at least)."""
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(cut[order[end]]) <= cells and end - at < 256:
            end += 1
        x, mask, _ = padded([page_matrix(cut[i]) for i in order[at:end]])
        good = model.score(x, mask) >= 0.5
        for row, i in enumerate(order[at:end]):
            out[i] = "\n".join(b[1] for b, g in zip(cut[i], good[row]) if g)
        at = end
    return out


def extract(pages: DataFrame, model: BlockLabeller | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, and its length in code points."""
    model = model or trained()
    extra = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    schema = T.StructType([pages.schema[c] for c in extra] + [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = main_texts(b.column(len(extra)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(extra))] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select(*extra, common.text_of(F.col(html_col)).alias("__html")).mapInArrow(run, schema)


def op10_lstm_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
