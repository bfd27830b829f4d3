"""N-gram Jaccard join: an exact join in the metric space of Jaccard distance.

Unrelated documents are all at distance 1 from each other, so pivots cannot part them. Documents
are therefore first routed by keys that no linked pair can miss: at Jaccard similarity t, sets
of sizes a and b differ in at most (a + b)(1 - t)/(1 + t) shingles, so if shingles are dealt by
hash into more classes than that, some class is equal in both, and more than the spare ones if
classes without a shingle that is rare in the corpus are left out. The hash of each class is a key;
sets with too few such classes also use their first shingles, rare ones first, of which linked sets share one.
The documents that share a key are a region; every pair that links lies in one. Regions of the same
documents are joined once. Which shingles count as common only decides how much work there is, not
the result.

Each region has a pivot. The distances of its documents to the pivot link what is near it, and by
the triangle inequality a pair can only link if its distances to the pivot differ by no more than
the radius; so the region is cut into rings as wide as the radius, each document goes to its own
ring and is replicated to the next, and the rings are regions of the next round, less those whose
documents are already connected. After ``ROUNDS`` of this a region that fits a task is joined there,
with pivots and windows in memory. Larger ones go to the Voronoi regions of several pivots and,
within a window of twice the radius, to further ones, are split again with new pivots, and what does
not shrink is joined block by block. All steps are exact; only connections are kept, pairs are
not written out.

Equal sets are one class; of each a task passes on one document only, and these are connected from
the start. Shingles are 64-bit hashes.

Defined results: null, empty or blank texts have an empty set and link with nothing; fewer words
than a shingle are one shingle; very long texts have all their shingles; an empty table gives an
empty result; ids are unique; further columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

WORDS, PERCENT = 4, 85
#: Documents and shingles that one task joins at most, pivots of a large region, levels of splitting, and copies of a region's documents that are too many for one.
REGION_DOCS, REGION_SHINGLES, PIVOTS, LEVELS, SPREAD = 256, 600_000, 16, 4, 1.5
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Rounds of pivots and rings before regions are joined; documents compared with a pivot by one task.
ROUNDS, PIVOT_DOCS = 1, 256
#: Bits of the filter of routed ids; common shingles wanted at most; least count of one.
FILTER_BITS, COMMON_MOST, COMMON_LEAST = 1 << 24, 1 << 21, 8
#: Bits of the maps of common shingles; the next map holds those that are LEVEL_STEP times as frequent.
LEVEL_BITS, LEVEL_STEP = (1 << 25, 1 << 23, 1 << 22, 1 << 22), 8
#: Bytes of text cut into words at once; documents of a key held at once; posting entries walked at once; sets that a task remembers.
_AT_ONCE, _HELD, _POSTS, _SEEN = 1 << 18, 20_000, 4_000_000, 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a byte is part of a word, its value with A-Z as a-z, powers of the base and of its inverse)."""
    inside = np.ones(256, dtype=bool)
    inside[[ord(c) for c in common.SPACES]] = False
    byte = np.arange(256, dtype=np.uint64)
    value = _mix(np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte) + np.uint64(1))
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return inside, value, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of bytes; no word goes on over a cut. A word's hash is a polynomial of its bytes, from sums over all of them."""
    inside, value, up, down = _powers(max(_AT_ONCE, 1 << len(raw).bit_length()))
    own = inside[raw]
    before, after = np.r_[False, own[:-1]], np.r_[own[1:], False]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    total = np.r_[np.uint64(0), np.cumsum(value[raw] * up[: len(raw)], dtype=np.uint64)]
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the word n-grams of each text, A-Z lower-cased; null as empty.

    Texts are read from the array's buffers, about _AT_ONCE bytes at a time; a longer text in pieces that end at white space.
    """
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, "right")) - 1)
        own, cuts = raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        parts, done = [], 0
        while len(own) - done > 2 * _AT_ONCE:
            spaces = np.flatnonzero(~_powers(_AT_ONCE)[0][own[done + _AT_ONCE : done + 2 * _AT_ONCE]])
            if not len(spaces):
                break
            stop = done + _AT_ONCE + int(spaces[0]) + 1
            parts.append(_words(own[done:stop], cuts[:0])[0])
            done = stop
        h, start = _words(own[done:], cuts[1:-1] - done)
        if parts:
            h, counts = np.concatenate([*parts, h]), [0, sum(map(len, parts)) + len(h)]
        else:
            counts = [0, *np.searchsorted(start, cuts[1:]).tolist()]
        # n-grams of all texts at once; those that reach into the next text are not used
        full = _grams(h, words) if len(h) >= words else h[:0]
        for begin, end in zip(counts[:-1], counts[1:]):
            m = min(words, end - begin)
            yield np.zeros(0, np.uint64) if not m else np.unique(full[begin : end - m + 1] if m == words else _grams(h[begin:end], m))
        at = to


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out + h[k : len(h) - n + 1 + k])
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), words))


class CommonLevels:
    """How common a shingle is in the corpus: 0 for a rare one, else the number of maps that it is in."""

    def __init__(self, maps: list[bytes]):
        self.maps = maps

    def of(self, s: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(s), np.uint8), np.arange(len(s))
        for bits in self.maps:
            slot = s[live] >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
            hit = np.frombuffer(bits, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
            live = live[hit.astype(bool)]
            out[live] += 1
        return out


class Routes:
    """Keys of sets: equal for at least one key of any two sets that link.

    Sizes are cut into intervals such that sets that link are in one interval or in neighbours; a set
    emits the keys of its own interval's group and of the group below.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def start(self, i: int) -> int:
        while len(self.starts) <= i:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return self.starts[i]

    @functools.lru_cache(maxsize=100_000)  # noqa: B019
    def group(self, g: int) -> tuple[int, int]:
        """(classes, of which so many may be empty in a set that needs no further keys)."""
        top = self.start(g + 1) - 1
        differ = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        best, size = (1.0, 0), self.start(g)
        for spare in range(13 if size < 200 else 40):
            classes = differ + 1 + spare
            mean = classes * math.exp(-size / classes)
            tail, term = 1.0, math.exp(-mean)
            for k in range(spare + 1):
                tail -= term
                term *= mean / (k + 1)
            if differ == 0 or tail < 1e-4:
                return classes, spare
            best = min(best, (tail, spare))
        return differ + 1 + best[1], best[1]

    def interval(self, n: int) -> int:
        i = 0
        while self.start(i + 1) <= n:
            i += 1
        return i

    def keys(self, s: np.ndarray, levels: CommonLevels) -> np.ndarray:
        """A hash of all of each class that holds a rare shingle, and the first shingles where too few classes do."""
        n, out = len(s), []
        level = levels.of(s)
        i = self.interval(n)
        for g in (i, i - 1) if i else (i,):
            classes, spare = self.group(g)
            salt = np.uint64((g + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            mixed = _mix(s ^ salt)
            at = (mixed % np.uint64(classes)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            some = np.minimum.reduceat(level[order], first) == 0
            whole = np.add.reduceat(_mix(mixed[order] + np.uint64(1)), first) + _mix(at[first].astype(np.uint64) + salt)
            out.append(_mix(whole[some]))
            if classes - some.sum() > spare:
                # of two sets that link and both come here, the first shingles of one order meet
                keep = n - -(-self.percent * n // 100) + 1
                out.append(_mix(s[np.lexsort((s, level))[:keep]] + ~salt))
        return np.unique(np.concatenate(out))


def links(overlap: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


class _Index:
    """Inverted index over the sets of one task."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens, self.token = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.token = self.token.astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.token, kind="stable")
        self.posts = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.token, minlength=len(tokens)))])

    def overlap(self, i: int) -> np.ndarray:
        """Shared shingles of document i with each document."""
        t = self.token[self.begin[i] : self.begin[i + 1]]
        lo, n = self.first[t], self.first[t + 1] - self.first[t]
        out, step = np.zeros(len(self.sizes), dtype=np.int64), max(1, _POSTS // len(self.sizes))
        for k in range(0, len(t), step):
            a, m = lo[k : k + step], n[k : k + step]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            out += np.bincount(self.posts[at], minlength=len(self.sizes))
        return out


def join_sets(sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT, halves: np.ndarray | None = None) -> np.ndarray:
    """Labels after joining all pairs that link; equal labels at the start count as connected.

    Documents are pivots in turn. One is passed over when each document that is left and not yet
    connected to it is outside its window for some earlier pivot. ``halves``: only pairs of
    different halves are left to join.
    """
    m, radius = len(sets), 1 - percent / 100 + 1e-12
    label = np.unique(labels, return_inverse=True)[1].astype(np.int64)
    if m < 2 or label.max() == 0:
        return label
    index, left, seen = _Index(sets), np.arange(m), np.zeros((0, m))
    while len(left) > 1:
        own = label[left]
        if (own == own[0]).all():
            break
        # a document of the smallest tree among the next ones keeps large trees from being walked
        z = int(left[0])
        left = left[1:]
        rest = left[label[left] != label[z]]
        if halves is not None:
            rest = rest[halves[rest] != halves[z]]
        if len(rest) and len(seen):
            rest = rest[(np.abs(seen[:, rest] - seen[:, z : z + 1]) <= radius).all(axis=0)]
        if not len(rest):
            continue
        o = index.overlap(z)
        near = rest[links(o[rest], index.sizes[z], index.sizes[rest], percent)]
        if halves is None:
            near = np.flatnonzero(links(o, index.sizes[z], index.sizes, percent))
        if len(seen) < 16:
            seen = np.vstack([seen, 1 - o / (index.sizes[z] + index.sizes - o)])
        roots = np.unique(np.r_[label[near], label[z]])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return label


_DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_SET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_MEET = T.StructType([T.StructField("region", T.LongType()), T.StructField("part", T.LongType()), T.StructField("p_id", T.LongType()), T.StructField("docs", T.ArrayType(T.LongType()))])
_DIST = T.StructType([T.StructField("p_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("near", T.BooleanType()), T.StructField("ring", T.IntegerType())])
_CELL = T.StructType([T.StructField("region", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("a", T.LongType()), T.StructField("pivot", T.IntegerType()), T.StructField("home", T.BooleanType())])


def common_shingles(docs: DataFrame, words: int, held: int = 1_500_000) -> CommonLevels:
    """Bit maps of the hashes of shingles that recur: LEVEL_BITS bits whatever the input.

    Tasks count about ``held`` shingles at a time and pass on those they met twice; the least count is
    raised until no more than COMMON_MOST are left.
    """
    schema = T.StructType([T.StructField("s", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def counted() -> pa.RecordBatch:
            s = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            parts.clear()
            s.sort()
            first = np.flatnonzero(np.r_[len(s) > 0, s[1:] != s[:-1]][: len(s)])
            s, n = s[first], np.diff(np.r_[first, len(s)])
            again = n > 1
            return pa.RecordBatch.from_arrays([pa.array(s[again].view(np.int64)), pa.array(n[again])], names=schema.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for s in shingle_sets(batch.column(0).slice(at, 500), words):
                    parts.append(s)
                    size += len(s)
                    if size >= held:
                        yield counted()
                        size = 0
        yield counted()
        common.give_back()

    counts = docs.select("text").mapInArrow(run, schema).groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    counts = common.stage(counts, "common")
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()  # one row per quarter power of two
    least, total = 1 << 62, 0
    for r in steps:
        total += r["c"]
        if total > COMMON_MOST:
            break
        least = r["n"]
    maps = []
    for k, bits in enumerate(LEVEL_BITS):
        shift = 64 - bits.bit_length() + 1
        maps.append(_bit_map(counts.where(F.col("n") >= min(1 << 62, least * LEVEL_STEP**k)).select(F.shiftrightunsigned("s", shift).alias("s")), bits))
    common.release(counts)
    return CommonLevels(maps)


def _bit_map(slots: DataFrame, bits: int) -> bytes:
    """A map of ``bits`` bits with those in column s set; one row of 4 KB for each 32,768 bits."""
    maps = slots.groupBy(F.expr("s div 32768").alias("k")).agg(F.bitmap_construct_agg((F.col("s") % 32768).cast("long")).alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in maps:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["bits"]
    return bytes(out)


def _sketch(words: int, percent: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, levels, seen = Routes(percent), often.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                n, f1, f2, keys = [], [], [], []
                for s in shingle_sets(b.column(1), words):
                    f = xxhash.xxh128_intdigest(s.tobytes())
                    n.append(len(s))
                    f1.append((f & (1 << 64) - 1) - (1 << 63))
                    f2.append((f >> 64) - (1 << 63))
                    # one of a task's equal sets speaks for all
                    keys.append(routes.keys(s, levels).view(np.int64) if len(s) and f not in seen else np.zeros(0, np.int64))
                    if len(seen) > _SEEN:
                        seen.clear()
                    seen.add(f)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=_DOC.names)

    return run


def _id_slot(col):
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, col: str) -> bytes:
    """A bit map of FILTER_BITS bits of hashed ids: 2 MB whatever the input."""
    return _bit_map(ids.select(_id_slot(F.col(col)).alias("s")), FILTER_BITS)


def region_sets(docs: DataFrame, bits: bytes, words: int) -> DataFrame:
    """(doc_id, n, counts, shingles) of the documents whose id is in the filter, and of a few others.

    counts: how many shingles fall into each of a power of two of about n / 4 classes, a byte each; empty if one holds over 255.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(bits, np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            some = np.flatnonzero(mask[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            for at in range(0, len(some), 500):
                b = batch.take(pa.array(some[at : at + 500]))
                n, counts, sets = [], [], []
                for s in shingle_sets(b.column(1), words):
                    k = max(1, len(s) // 4).bit_length()
                    c = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
                    n.append(len(s))
                    counts.append(c.astype(np.uint8).tobytes() if c.max() < 256 else b"")
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(counts, pa.binary()), pa.array(sets, pa.binary())], names=_SET.names)

    return docs.select("doc_id", "text", _id_slot(F.col("doc_id")).alias("slot")).mapInArrow(run, _SET)


def _marked(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """``rows`` with __hit: whether their ``col`` may be in ``ids``; a bit map of FILTER_BITS bits, 2 MB, is broadcast."""
    slot = _id_slot(F.col(col))
    maps = ids.select(slot.alias("s")).groupBy(F.expr("s div 32768").alias("__block")).agg(F.bitmap_construct_agg((F.col("s") % 32768).cast("long")).alias("__bits"))
    rows = rows.withColumn("__s", slot).withColumn("__block", F.expr("__s div 32768")).join(F.broadcast(maps), "__block", "left")
    bit = F.expr("(conv(hex(substring(__bits, cast((__s % 32768) div 8 as int) + 1, 1)), 16, 10) >> cast(__s % 8 as int)) & 1 = 1")
    return rows.withColumn("__hit", F.coalesce(bit, F.lit(False)))


def only(rows: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """Rows whose ``col`` may be in ``ids``."""
    return _marked(rows, ids, col).where("__hit").select(*rows.columns)


def less(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids ``gone``; only rows that the bit map cannot tell from those are shuffled. Rows without an id stay."""
    marked = _marked(docs, gone, "doc_id")
    unsure = marked.where("__hit").select(*docs.columns).join(gone.hint("merge"), "doc_id", "left_anti")
    return marked.where("NOT __hit").select(*docs.columns).unionByName(unsure.select(*docs.columns))


def may_link(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (p_id, doc_id) whose classes' counts allow a link: the sum of their differences is no more than that of the sets.

    The classes are pivots of a kind: each bounds the distance of two sets by the triangle inequality.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (m, n, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in range(2, 6)))):
                if x and y:
                    u, v = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
                    k = min(len(u), len(v))
                    differ = int(np.abs(u.reshape(k, -1).sum(axis=1) - v.reshape(k, -1).sum(axis=1)).sum())
                    if differ * (100 + percent) > (m + n) * (100 - percent):
                        continue
                keep.append(i)
            some = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["p_id", "doc_id"])

    own = pairs.join(counts.select(F.col("doc_id").alias("p_id"), F.col("n").alias("m"), F.col("counts").alias("p_counts")), "p_id").join(counts, "doc_id")
    return own.select("p_id", "doc_id", "m", "n", "p_counts", "counts").mapInArrow(run, "p_id long, doc_id long")


def _edges(ids: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from each document to the first one of its label."""
    order = np.lexsort((ids, label))
    first = np.r_[True, label[order][1:] != label[order][:-1]]
    head = ids[order][first][np.cumsum(first) - 1]
    rest = ~first
    return ids[order][rest].tolist(), head[rest].tolist()


def meetings(keyed: DataFrame) -> DataFrame:
    """(region, doc_id, p_id) of (key, doc_id): the documents that share a key, and the region's pivot.

    Keys are streamed in order; the pivot is the document of the smallest hash. Keys of the same documents
    make one region, named by their documents, so far as a task holds the documents of a key at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        key, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begun: tuple[int, int] | None = None  # key and pivot of a region that is already partly written

        def whole(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
            """Regions of complete keys."""
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            name = _mix(np.add.reduceat(_mix(doc.view(np.uint64) + np.uint64(0x51ED270B)), first) + size.astype(np.uint64))
            pick = np.zeros(len(first), bool)
            pick[np.unique(name, return_index=True)[1]] = True
            pick &= size > 1
            at = np.flatnonzero(pick)
            new = np.array([x not in seen for x in name[at].tolist()], dtype=bool)
            at = at[new] if len(at) else at
            if len(seen) > 500_000:
                seen.clear()
            seen.update(name[at].tolist())
            docs = pa.array([doc[a : a + m] for a, m in zip(first[at].tolist(), size[at].tolist())], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), pa.array(np.zeros(len(at), np.int64)), pa.array(doc[first[at]]), docs], names=_MEET.names)

        def part(key: int, pivot: int, doc: np.ndarray) -> pa.RecordBatch:
            """Some documents of a key of very many; parts are named by their last document."""
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([int(doc[-1])]), pa.array([pivot]), pa.array([doc], pa.list_(pa.int64()))], names=_MEET.names)

        for b in batches:
            key, doc = np.r_[key, b.column(0).to_numpy()], np.r_[doc, b.column(1).to_numpy()]
            if begun:
                own = int(np.searchsorted(key != begun[0], True))
                if own:
                    yield part(*begun, doc[:own])
                key, doc = key[own:], doc[own:]
                if len(key):
                    begun = None
            if not len(key):
                continue
            # the last key may go on in the next batch
            cut = len(key) - int(np.searchsorted(key[::-1] != key[-1], True))
            if cut:
                yield whole(key[:cut], doc[:cut])
                key, doc = key[cut:], doc[cut:]
            if len(key) > _HELD:
                begun = (int(key[0]), int(doc[0]))
                yield part(*begun, doc)
                key, doc = key[:0], doc[:0]
        if len(key):
            yield whole(key, doc)

    rows = keyed.select("key", "doc_id").repartition("key").sortWithinPartitions("key", F.xxhash64("doc_id"), "doc_id")
    rows = rows.mapInArrow(run, _MEET).groupBy("region", "part").agg(F.first("p_id").alias("p_id"), F.first("docs").alias("docs"))
    return rows.select("region", "p_id", F.explode("docs").alias("doc_id"))


def pivot_distances(pairs: DataFrame, sets: DataFrame, percent: int, most: int = PIVOT_DOCS) -> DataFrame:
    """(p_id, doc_id, near, ring) of (p_id, doc_id): whether they link, and the distance in whole radii.

    A pivot of many documents is copied to several tasks; sets are streamed, a pivot's before those that it meets.
    """
    radius = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for p, is_doc, doc, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not is_doc:
                    pivot = s
                    continue
                shared = int((pivot[np.minimum(np.searchsorted(pivot, s), len(pivot) - 1)] == s).sum())
                union = len(s) + len(pivot) - shared
                for o, v in zip(out, (p, doc, 100 * shared >= percent * union, int((1 - shared / union) / radius))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int32()))], names=_DIST.names)

    load = pairs.groupBy("p_id").agg(F.ceil(F.count("*") / most).cast("int").alias("salts"))
    docs = pairs.join(load, "p_id").select("p_id", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("is_doc"), "doc_id")
    pivots = load.select("p_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("is_doc"), F.col("p_id").alias("doc_id"))
    needed = only(sets.select("doc_id", "shingles"), docs.select("doc_id").unionByName(pivots.select("doc_id")))
    rows = docs.unionByName(pivots).join(needed, "doc_id").select("p_id", "salt", "is_doc", "doc_id", "shingles")
    return rows.repartition("p_id", "salt").sortWithinPartitions("p_id", "salt", "is_doc", "doc_id").mapInArrow(run, _DIST)


def rings(meet: DataFrame, dist: DataFrame, label: DataFrame) -> DataFrame:
    """(region, doc_id, label) of the next round, without the pivots: each document in its ring and, as a visitor, in the next one.

    A region stays whole if some of its documents are too far from the pivot for their distance to be known.
    """
    rows = common.stage(meet.where("doc_id <> p_id").join(dist, ["p_id", "doc_id"], "left").select("region", "doc_id", "ring"), "measured")
    far = rows.where("ring IS NULL").select("region").distinct().hint("merge")
    ringed = rows.join(far, "region", "left_anti").select("region", "doc_id", F.explode(F.array(F.struct(F.col("ring").alias("ring"), F.lit(1).alias("home")), F.struct((F.col("ring") + 1).alias("ring"), F.lit(0).alias("home")))).alias("r"))
    ringed = ringed.select(F.xxhash64("region", "r.ring").alias("region"), "doc_id", "r.home")
    whole = rows.join(far, "region", "left_semi").select("region", "doc_id", F.lit(1).alias("home"))
    named = ringed.unionByName(whole).join(label.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    live = named.groupBy("region").agg(F.max("home").alias("h"), F.min("label").alias("x"), F.max("label").alias("y")).where("h = 1 and x <> y").select("region")
    out = common.stage(named.join(live.hint("merge"), "region", "left_semi").select("region", "doc_id", "label"), "rings")  # a merge join splits a region of many documents
    common.release(rows)
    return out


def join_small(rows: DataFrame, percent: int) -> DataFrame:
    """Join each region of (region, label, doc_id, shingles) within a task; edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def solve() -> tuple[list[int], list[int]]:
            if len(held) < 2:
                return [], []
            ids = np.array([h[0] for h in held])
            sets = [np.frombuffer(h[2], np.uint64) for h in held]
            return _edges(ids, join_sets(sets, np.array([h[1] for h in held]), percent))

        for batch in batches:
            a, b = [], []
            for region, label, doc, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if region != at:
                    x, y = solve()
                    a, b = a + x, b + y
                    held.clear()
                    at = region
                held.append((doc, label, s))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_EDGE.names)
        a, b = solve()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_EDGE.names)

    rows = rows.select("region", "label", "doc_id", "shingles")
    return rows.repartition("region").sortWithinPartitions("region", "doc_id").mapInArrow(run, _EDGE)


def voronoi(rows: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(region, doc_id, a, pivot, home): the pivots that each document links with (home null) and the regions it goes to."""
    radius = 1 - percent / 100 + 1e-12

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs = left.column("doc_id").to_numpy(), [np.frombuffer(x, np.uint64) for x in left.column("shingles").to_pylist()]
        p_ids, p_sets = right.column("p_id").to_pylist(), [np.frombuffer(x, np.uint64) for x in right.column("p_set").to_pylist()]
        if not docs or not p_sets:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.bool_())], names=_CELL.names)
        index = _Index(docs + p_sets)
        m, out = len(docs), ([], [], [], [])
        dist = np.zeros((len(p_sets), m))

        def put(which: np.ndarray, a: int | None, pivot: int, home: np.ndarray | None) -> None:
            out[0].extend(ids[which].tolist())
            out[1].extend([a] * len(which))
            out[2].extend([pivot] * len(which))
            out[3].extend([None] * len(which) if home is None else home.tolist())

        for k, p in enumerate(p_ids):
            o = index.overlap(m + k)[:m]
            size = len(p_sets[k])
            dist[k] = 1 - o / (size + index.sizes[:m] - o)
            put(np.flatnonzero(links(o, size, index.sizes[:m], percent)), p, k, None)
        home = dist.argmin(axis=0)
        near = dist <= dist[home, np.arange(m)] + 2 * radius
        for k in range(len(p_ids)):
            which = np.flatnonzero(near[k])
            put(which, None, k, home[which] == k)
        return pa.table([pa.array([key[0].as_py()] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_())], names=_CELL.names)

    return rows.groupBy("region", "part").cogroup(pivots.groupBy("p_region", "p_part")).applyInArrow(run, _CELL)


def join_blocks(rows: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """All pairs of blocks of each region (region, label, doc_id, shingles, part), a task for each."""
    pairs = rows.join(parts, "region").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def run(key: tuple, t: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        label = join_sets(sets, t.column("label").to_numpy(), percent, None if same else t.column("part").to_numpy())
        a, b = _edges(t.column("doc_id").to_numpy(), label)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_EDGE.names)

    return pairs.groupBy("region", "lo", "hi").applyInArrow(run, _EDGE)


def merged(rows: DataFrame, sizes: DataFrame, max_docs: int, max_shingles: int) -> DataFrame:
    """Regions (region, doc_id, label) that overlap as one where that is less work; the others as they are, those of the same documents once.

    It is where all the documents that hang together fit a task, or make no more pairs than their regions do one by one.
    """
    whole = rows.groupBy("region").agg(F.min("doc_id").alias("h"), F.count("*").alias("m"), F.sum(F.shiftright(F.xxhash64("doc_id"), 20)).alias("s"))
    whole = common.stage(whole.groupBy("m", "s").agg(F.min(F.struct("region", "h")).alias("r")).select("r.region", "r.h", "m"), "whole")
    rows = common.stage(rows.join(whole.select("region", "h").hint("merge"), "region"), "single")
    hang = common.stage(components(rows.select(F.col("doc_id").alias("a"), F.col("h").alias("b"))), "hang")
    docs = rows.select("doc_id", "label").distinct().join(hang.withColumnRenamed("node", "doc_id"), "doc_id").join(sizes, "doc_id")
    alone = whole.join(hang.withColumnRenamed("node", "h"), "h").groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    fits = docs.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("weight")).join(alone, "component")
    fits = fits.where(((F.col("docs") <= max_docs) & (F.col("weight") <= max_shingles)) | (F.col("docs") * F.col("docs") <= F.col("pairs"))).select("component").hint("merge")
    joined = docs.join(fits, "component").select(F.xxhash64(F.lit("all"), "component").alias("region"), "doc_id", "label")
    loose = rows.join(hang.select(F.col("node").alias("doc_id"), "component").join(fits, "component", "left_anti"), "doc_id").select("region", "doc_id", "label")
    out = common.stage(joined.unionByName(loose), "open")
    for old in (whole, rows, hang):
        common.release(old)
    return out


def link_edges(rows: DataFrame, percent: int, max_docs: int, max_shingles: int) -> list[DataFrame]:
    """Edges that connect what links within each region of (region, doc_id, shingles, label)."""
    found: list[DataFrame] = []
    for level in range(LEVELS + 1):
        size = rows.groupBy("region").agg(F.count("*").alias("docs"), F.sum(F.octet_length("shingles") / 8).alias("weight"))
        parts = F.greatest(F.ceil(F.col("docs") / max_docs), F.ceil(F.col("weight") / max_shingles)).cast("int")
        size = common.stage(size.withColumn("parts", parts), "regions")
        big = size.where("parts > 1").select("region", "parts")
        found.append(common.stage(join_small(rows.join(size.where("parts = 1").select("region"), "region", "left_semi"), percent), "links"))
        if big.isEmpty():
            common.release(size)
            break
        large = only(rows, big, "region").join(big.hint("merge"), "region").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("parts")).cast("int"))
        large = common.stage(large, "large")
        if level == LEVELS:
            found.append(common.stage(join_blocks(large.drop("parts"), big, percent), "links"))
            break
        # the pivots: in each part the documents with the smallest hash, then of the region those
        drawn = large.groupBy("region", "part").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(level + 100)).alias("h"), "doc_id")).alias("p"))
        few = drawn.groupBy("region").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.count("*").alias("parts")).withColumn("ps", F.slice("ps", 1, PIVOTS))
        chosen = few.select("region", "parts", F.explode("ps.doc_id").alias("doc_id")).join(large.select("region", "doc_id", "shingles"), ["region", "doc_id"])
        pivots = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).select(F.col("region").alias("p_region"), F.col("part").alias("p_part"), F.col("doc_id").alias("p_id"), F.col("shingles").alias("p_set"))
        cells = common.stage(voronoi(large.select("region", "part", "doc_id", "shingles"), pivots, percent), "voronoi")
        edges = common.stage(cells.where("home IS NULL").select(F.col("doc_id").alias("a"), F.col("a").alias("b")), "links")
        found.append(edges)
        # regions that the pivots do not part are joined block by block
        spread = cells.where("home IS NOT NULL").groupBy("region").agg(F.count("*").alias("copies")).join(size, "region")
        dense = common.stage(spread.where(F.col("copies") > F.col("docs") * SPREAD).select("region", "parts"), "dense")
        found.append(common.stage(join_blocks(large.drop("parts"), dense, percent), "links"))
        cells = cells.join(dense.select("region"), "region", "left_anti")
        label = components(edges).withColumnRenamed("node", "doc_id")
        region = F.xxhash64("parent", "pivot")
        cells = cells.where("home IS NOT NULL").select(F.col("region").alias("parent"), "doc_id", "pivot")
        own = large.select(F.col("region").alias("parent"), "doc_id", "shingles", "label")
        nxt = own.join(cells, ["parent", "doc_id"]).join(label, "doc_id", "left")
        nxt = nxt.select(region.alias("region"), "doc_id", "shingles", F.coalesce("component", "label").alias("label"))
        nxt = common.stage(nxt, "next")
        open_ = nxt.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("region")
        rows = common.stage(nxt.join(open_, "region", "left_semi"), "cells")
        common.release(large)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, max_docs: int = REGION_DOCS, max_shingles: int = REGION_SHINGLES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id it is connected with)."""
    with common.batches_of(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, id_col, text_col, words, percent, max_docs, max_shingles, rounds)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, max_docs: int, max_shingles: int, rounds: int) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))  # LEVEL_BITS / 8 bytes
    sketch = common.stage(docs.mapInArrow(_sketch(words, percent, often), _DOC), "sketch")
    speaks = F.size("keys") > 0
    classes = sketch.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min(F.when(speaks, F.col("doc_id"))).alias("node"))
    classes = common.stage(classes, "classes")
    meet = common.stage(meetings(sketch.select(F.explode("keys").alias("key"), "doc_id")), "meet")
    # a class is one node, its smallest document that speaks for it
    named = sketch.where(speaks).select("doc_id", "f1", "f2").join(classes.drop("rep"), ["f1", "f2"]).where("doc_id <> node").select("doc_id", "node")
    named = common.stage(named, "named")
    old, p_named = meet, named.withColumnsRenamed({"doc_id": "p_id", "node": "p_node"})
    meet = meet.join(named, "doc_id", "left").join(p_named, "p_id", "left").select("region", F.coalesce("node", "doc_id").alias("doc_id"), F.coalesce("p_node", "p_id").alias("p_id")).distinct()
    meet = common.stage(meet, "meet")
    common.release(old)
    common.release(named)
    members = sketch.select("doc_id", "n", "f1", "f2").join(classes.drop("rep"), ["f1", "f2"], "left").select("doc_id", "n", "node")
    members = common.stage(members, "members")
    common.release(sketch)
    routed = meet.select("doc_id").distinct()
    sets = common.stage(region_sets(docs, id_filter(routed, "doc_id"), words), "sets")
    found: list[DataFrame] = []
    for level in range(rounds):
        pairs = meet.where("doc_id <> p_id").select("p_id", "doc_id").distinct()
        pairs = common.stage(may_link(pairs, sets.select("doc_id", "n", "counts"), percent), "pairs")
        dist = common.stage(pivot_distances(pairs, sets, percent), "distances")
        common.release(pairs)
        found.append(common.stage(dist.where("near").select(F.col("doc_id").alias("a"), F.col("p_id").alias("b")), "links"))
        label = components(functools.reduce(DataFrame.unionByName, found))
        rows = rings(meet, dist, label)
        for old in (meet, dist):
            common.release(old)
        if level < rounds - 1:
            first = rows.groupBy("region").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(level)), "doc_id"))["doc_id"].alias("p_id"))
            meet = common.stage(rows.join(first.hint("merge"), "region").select("region", "doc_id", "p_id"), "meet")
            common.release(rows)
    rows = merged(rows, members.select("doc_id", "n"), max_docs, max_shingles)
    filled = common.stage(rows.join(only(sets, rows.select("doc_id").distinct()), "doc_id").select("region", "doc_id", "shingles", "label"), "filled")
    found += link_edges(filled, percent, max_docs, max_shingles)
    # a component's name is the smallest document of all its classes
    parts = classes.join(components(functools.reduce(DataFrame.unionByName, found)), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    parts = common.stage(parts, "parts")
    parts = parts.join(parts.groupBy("part").agg(F.min("rep").alias("first")), "part").select("node", "first")
    out = members.join(parts, "node", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    out = common.stage(out, "groups")
    for old in (sets, rows, filled, members, classes, *found):
        common.release(old)
    return out


def op9_jaccard_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
