"""Benchmark decontamination by the q-gram lemma over diagonal bands.

A window of W characters of an item that lies in a document with at most E edits shares at least
W + 1 - q(E + 1) q-grams with it, all within a band of E + 1 neighbouring diagonals. Shared q-grams
are therefore counted in bands of 2(E + 1) diagonals that overlap by half, so that each window's
diagonals lie within one band. Each window of an item whose grams in a band reach the count is a
region; it is verified by banded alignment (the item's window against the document, free ends in
the document), unless its count shows that it has no fewer edits than the best so far.

Texts are compared in a plain form: lower case, each run of white space one space. An item shorter
than W is its own window, with edits in proportion; items under q + 8 characters are sought whole,
without edits (those shorter than a q-gram by hashes of their own length). A document is contaminated
if any region is verified.

The index of the benchmark is broadcast only up to ``max_index`` q-grams; a larger benchmark is dealt
into slices of that size and the documents are scanned once for each.

Defined results: null or empty texts and items match nothing; repeated items each match; a document
with many regions of an item has one row, that of an exact region or else of the fewest edits; very long texts
are scanned whole, repetitive ones in the same memory as others; empty tables give an empty result; columns of the input are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q, WINDOW, EDIT_SHARE, MAX_INDEX = 8, 80, 0.08, 2_000_000
#: Pairs of equal grams of a text and the benchmark that are looked at together.
PAIRS = 1_000_000
_BITS, _BASE = 20, 0x9E3779B97F4A7C15
_HIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("region_start", T.LongType()), T.StructField("region_end", T.LongType())])


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of an array of code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # hashes of 1, 2, 4, ... characters make those of q by the binary digits of q
    part, size, base, out, done = codes.astype(np.uint64) + np.uint64(1), 1, _BASE, None, 0
    while True:
        if q & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(base) + piece
            done += size
        if done == q:
            return out ^ (out >> np.uint64(29))
        part = part[:-size] * np.uint64(base) + part[size:]
        size, base = size * 2, base * base & 0xFFFFFFFFFFFFFFFF


def banded_edits(pattern: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of ``pattern`` in ``text`` with free ends in the text; edits over ``limit`` are given as limit + 1.

    One column of text a step, all pattern rows at once; deletions within a column by a running
    minimum. Starts are carried along. The text is a band's region, so it is short.
    """
    m = len(pattern)
    row = np.arange(m + 1)
    cost, start = row.copy(), np.zeros(m + 1, dtype=np.int64)
    best = (limit + 1, 0, 0)
    for j, c in enumerate(text):
        diag, up = cost[:-1] + (pattern != c), cost[1:] + 1
        inner = np.minimum(diag, up)
        s_in = np.where(diag <= up, start[:-1], start[1:])
        new = np.concatenate([[0], inner])
        s_new = np.concatenate([[j + 1], s_in])
        flat = new - row
        low = np.minimum.accumulate(flat)
        at = np.maximum.accumulate(np.where(flat == low, row, 0))
        cost, start = low + row, s_new[at]
        if cost[m] < best[0]:
            best = (int(cost[m]), int(start[m]), j + 1)
    return best


def fewest_edits(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edits of the best place of ``pattern`` in ``text`` with free ends in the text: columns as bit vectors (Myers)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    more, less, cost, best = full, 0, m, m
    for c in text.tolist():
        eq = masks.get(c, 0)
        x = eq | less
        d = (((eq & more) + more) ^ more) | eq
        up, down = less | (full & ~(d | more)), more & d
        if up & top:
            cost += 1
        elif down & top:
            cost -= 1
            best = min(best, cost)
        up, down = up << 1, down << 1
        more, less = (down | ~(x | up)) & full, up & x
    return best


@dataclass
class Index:
    """Sorted q-grams of a slice of the benchmark with item and position, and a bit map of them."""

    ids: list[int]
    items: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    bits: np.ndarray
    q: int
    window: int
    share: float
    least: np.ndarray
    short: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]

    @staticmethod
    def build(rows: list[tuple[int, str]], q: int, window: int, share: float) -> Index:
        # items shorter than q: (length, sorted hashes, ids, texts) of each length
        short = []
        for n in sorted({len(t) for _, t in rows if 0 < len(t) < q}):
            own = [(i, codes_of(t)) for i, t in rows if len(t) == n]
            key = np.concatenate([grams(c, n) for _, c in own])
            order = np.argsort(key, kind="stable")
            short.append((n, key[order], np.array([i for i, _ in own], dtype=object)[order], [own[k][1] for k in order]))
        rows = [r for r in rows if len(r[1]) >= q]
        ids, items = [r[0] for r in rows], [codes_of(r[1]) for r in rows]
        g = [grams(c, q) for c in items]
        gram = np.concatenate(g) if g else np.zeros(0, np.uint64)
        item, pos = np.repeat(np.arange(len(g)), list(map(len, g))), np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[(gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        out = Index(ids, items, gram[order], item[order], pos[order], bits, q, window, share, np.zeros(0), short)
        out.least = np.array([out.limits(k)[2] for k in range(len(items))], dtype=np.int64)
        return out

    def limits(self, k: int) -> tuple[int, int, int]:
        """(window, edits, least shared q-grams) of item k."""
        w = min(self.window, len(self.items[k]))
        e = int(w * self.share) if w >= self.q + 8 else 0
        return w, e, max(1, w + 1 - self.q * (e + 1))

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each item found in a plain text."""
        return self._long(codes) + self._short(codes)

    def _short(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The items shorter than q, each at its first place."""
        out = []
        for n, key, ids, texts in self.short:
            g, first = np.unique(grams(codes, n), return_index=True)
            lo, hi = np.searchsorted(g, key, "left"), np.searchsorted(g, key, "right")
            for k in np.flatnonzero(lo < hi).tolist():
                at = int(first[lo[k]])
                if np.array_equal(codes[at : at + n], texts[k]):
                    out.append((ids[k], 0, at, at + n))
        return out

    def _long(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The items of q characters or more.

        Pairs of equal grams are looked at for stretches of the text that hold about PAIRS of them; stretches overlap by the
        longest region, so each window's grams lie within one. So a repetitive text takes no more memory than another.
        """
        g = grams(codes, self.q)
        at = np.flatnonzero(self.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return []
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        total = np.cumsum(hi - lo)
        if not total[-1]:
            return []
        reach = self.window + 2 * (int(self.window * self.share) + 1)
        found: dict[int, tuple[int, int, int]] = {}
        seen = _Seen(codes)
        a = 0
        while a < len(at):
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")), int(np.searchsorted(at, at[a] + 2 * reach)))
            self._stretch(codes, at[a:b], lo[a:b], hi[a:b], found, seen)
            if b >= len(at):
                break
            a = max(a + 1, int(np.searchsorted(at, at[b] - reach)))
        return [(self.ids[k], *f) for k, f in sorted(found.items())]

    def _stretch(self, codes: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, found: dict[int, tuple[int, int, int]], seen: _Seen) -> None:
        """Add to ``found`` the best region of each item whose grams are at ``at`` in the text, if it is better than what is there."""
        n = hi - lo
        hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc_at, item, pos = np.repeat(at, n), self.item[hit], self.pos[hit]
        enough = np.bincount(item, minlength=len(self.items)) >= self.least
        if not enough.any():
            return
        some = enough[item]
        doc_at, item, pos = doc_at[some], item[some], pos[some]
        order = np.argsort(item, kind="stable")
        doc_at, item, pos = doc_at[order], item[order], pos[order]
        cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = int(item[a])
            if k in found and not found[k][0]:
                continue
            w, e, least = self.limits(k)
            best = self._item(codes, k, doc_at[a:b], pos[a:b], w, e, least, found.get(k), seen)
            if best:
                found[k] = best

    def _item(self, codes: np.ndarray, k: int, doc_at: np.ndarray, pos: np.ndarray, w: int, e: int, least: int, best: tuple[int, int, int] | None, seen: _Seen) -> tuple[int, int, int] | None:
        """(edits, start, end) of the window of item k with the fewest edits, if any has at most ``e`` and fewer than ``best``, else that.

        Every window whose shared grams within a band reach ``least`` is aligned, those with the most
        grams first, but for windows whose grams show that they have no fewer edits than the best, and for
        those whose characters were refused in a region of the same characters before.
        """
        text, step = self.items[k], e + 1
        diag, whole = doc_at - pos, w - self.q + 1
        for shift in (0, step):
            band = (diag + shift) // (2 * step)
            order = np.argsort(band, kind="stable")
            edge = np.flatnonzero(np.r_[True, band[order][1:] != band[order][:-1], True])
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a < least:
                    continue
                # the band's shared grams in the window at each position of the item
                shared = np.zeros(len(text) - self.q + 2, dtype=np.int64)
                shared[pos[order[a:b]] + 1] = 1
                shared = shared.cumsum()
                count = shared[whole:] - shared[: len(shared) - whole]
                heads = np.flatnonzero(count >= least)
                if not len(heads):
                    continue
                first = int(band[order[a]]) * 2 * step - shift
                heads, keys = seen.new(k, text, heads[np.argsort(-count[heads], kind="stable")], w, first, 2 * step)
                for head, key in zip(heads.tolist(), keys):
                    # an edit spoils at most q grams of a window
                    if best is not None and -((count[head] - whole) // self.q) >= best[0]:
                        break
                    start = max(0, head + first)
                    region = codes[start : head + first + w + 2 * step]
                    pattern = text[head : head + w]
                    if fewest_edits(pattern, region) > (e if best is None else best[0] - 1):
                        seen.refused.add(key)
                        continue
                    edits, s, t = banded_edits(pattern, region, e)
                    best = (edits, start + s, start + t)
                    if not edits:
                        return best
        return best


class _Seen:
    """Windows and regions of one text by their characters: pairs that were refused need no second look."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.refused = codes, set()
        self.windows: dict[int, np.ndarray] = {}
        self.regions: dict[int, np.ndarray] = {}

    def new(self, k: int, text: np.ndarray, heads: np.ndarray, w: int, first: int, more: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Of windows at ``heads`` those whose pair with their region is not refused, one of each pair, in the order given; and the pairs."""
        if k not in self.windows:
            self.windows[k] = grams(text, w)
        size = w + more
        if size not in self.regions:
            self.regions[size] = grams(self.codes, size)
        own, start = self.regions[size], heads + first
        inside = (start >= 0) & (start < len(own))
        # a region cut off by an end of the text is known by its place
        there = np.where(inside, own[np.clip(start, 0, max(0, len(own) - 1))] if len(own) else np.uint64(0), start.astype(np.uint64))
        here = self.windows[k][heads]
        order = np.lexsort((np.arange(len(heads)), there, here))
        same = np.r_[False, (here[order][1:] == here[order][:-1]) & (there[order][1:] == there[order][:-1])]
        pick = np.sort(order[~same])
        pairs = list(zip(here[pick].tolist(), there[pick].tolist()))
        left = [i for i, p in enumerate(pairs) if p not in self.refused]
        return heads[pick[left]], [pairs[i] for i in left]


def slices(benchmark: DataFrame, max_index: int) -> Iterator[list[tuple[int, str]]]:
    """Items in slices of at most ``max_index`` q-grams (one item at least); rows come one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id").toLocalIterator():
        text = plain(r[1])
        if not text:
            continue
        if held and size + len(text) > max_index:
            yield held
            held, size = [], 0
        held.append((r[0], text))
        size += len(text)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, window: int = WINDOW, share: float = EDIT_SHARE, max_index: int = MAX_INDEX) -> DataFrame:
    """(doc_id, item_id, edits, region_start, region_end) of each item found in a document; offsets are those of the plain text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    out = spark.createDataFrame([], _HIT)
    for part in slices(benchmark, max_index):
        index = spark.sparkContext.broadcast(Index.build(part, q, window, share))  # at most max_index q-grams

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                hits = [(d, *h) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in own.search(codes_of(plain(t)))]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=_HIT.names)

        out = out.unionByName(rows.mapInArrow(run, _HIT))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    id_col = options.get("id_col", "doc_id")
    bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")


def op4_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
