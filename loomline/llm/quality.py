"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone. Trees have a fixed depth and are stored as flat
arrays (split feature and threshold of each inner node, value of each leaf), so a batch walks
all trees with a few numpy steps.

The model is fitted on at most ``max_rows`` labelled documents, those with the smallest hash of
their id, out of the rows outside the held-out fold.

Defined results: a null text is the empty text and is scored like any other; without labelled
rows each score is 0.5; of several labels of a document the largest counts; equal texts get
equal scores; an empty table gives an empty result; other columns pass through unless they bear
a result's name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FOLDS, MAX_ROWS, ACCEPT = 5, 20_000, 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.2, 1.0, 5.0

FEATURES = ["chars", "words", "lines", "word_length", "long_words", "short_words", "distinct_words", "distinct_lines", "line_length", "lower", "upper", "digit", "space", "high", "stops", "commas", "hashes", "dollars", "percents", "ampersands", "stars", "bars", "bangs", "marks", "brackets", "odd_words", "caps_words", "full_lines", "commonest_word", "entropy"]


def _classes() -> np.ndarray:
    """byte -> one column for each class of bytes."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", common.SPACES, None, ".", ",", "#", "$", "%", "&", "*", "|", "!", "?;:'\"-", "()[]{}<>"]
    out = np.zeros((256, len(kinds)))
    for i, k in enumerate(kinds):
        out[list(range(128, 256)) if k is None else [ord(c) for c in k], i] = 1
    return out


_CLASSES = _classes()


def statistics(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        n = counts.sum()
        share = counts @ _CLASSES / n
        words, lines = text.split(), text.split("\n")
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        m = max(1, len(words))
        distinct = Counter(words)
        p = counts[counts > 0] / n
        odd = sum(1 for w in distinct if not w.strip(".,").isalpha())
        caps = sum(1 for w in distinct if len(w) > 2 and w.isupper())
        stats = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), (sizes > 12).mean(), (sizes < 4).mean(), len(distinct) / m, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines))]
        full = sum(1 for x in lines if x.rstrip()[-1:] in (".", "!", "?")) / len(lines)
        out[i] = [*stats, *share, odd / max(1, len(distinct)), caps / max(1, len(distinct)), full, max(distinct.values(), default=0) / m, -(p * np.log2(p)).sum()]
    return out


@dataclass
class Forest:
    """``feature`` and ``cut`` (trees, 2**depth - 1), ``leaf`` (trees, 2**depth), and the base log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            flat_feature, flat_cut, flat_leaf = self.feature.ravel(), self.cut.ravel(), self.leaf.ravel()
            root, row = np.arange(trees)[None, :] * inner, np.arange(len(x))[:, None]
            node = np.zeros((len(x), trees), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = root + node
                node = 2 * node + 1 + (x[row, flat_feature[at]] > flat_cut[at])
            total = total + flat_leaf[np.arange(trees)[None, :] * (inner + 1) + node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Log-loss boosting; splits are searched over histograms of quantile bins, level by level."""
    inner, n_features = 2**depth - 1, x.shape[1] if x.ndim == 2 else len(FEATURES)
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)
    out_f, out_c, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for d in range(depth):
            width, first = 2**d, 2**d - 1
            best_gain, best = np.zeros(width), [(0, bins, np.inf)] * width
            for f in range(n_features):
                key = (node - first) * bins + code[:, f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
                gain[(h < LEAST / 4) | (ht - h < LEAST / 4)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best_gain + 1e-9):
                    best_gain[k], best[k] = gain[k, top[k]], (f, int(top[k]), float(edges[f][top[k]]))
            fs, bs = np.array([b[0] for b in best]), np.array([b[1] for b in best])
            out_f[t, first : first + width], out_c[t, first : first + width] = fs, [b[2] for b in best]
            node = 2 * node + 1 + (code[np.arange(len(y)), fs[node - first]] > bs[node - first])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        out_l[t] = -rate * g / (h + L2)
        margin += out_l[t][node - inner]
    return Forest(out_f, out_c, out_l, base)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, target: str = "quality") -> Forest:
    """Fit on labelled documents outside the held-out fold; at most ``max_rows`` come to the driver."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(fold(F.col("doc_id")) != 0)
    chosen = chosen.groupBy("doc_id").agg(F.max(target).cast("int").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", common.text_of(F.col("text")).alias("text"), "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = rows.select(F.col("doc_id").cast("long"), "text", "__y").mapInArrow(run, schema).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return fit(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, accept: float = ACCEPT, keep_text: bool = True) -> DataFrame:
    """``docs`` with held_out, score and predicted; rows stay where they are, nothing is shuffled."""
    taken = {"held_out", "score", "predicted"}
    extra = [c for c in docs.columns if c not in taken and (keep_text or c != "text")]
    schema = T.StructType([docs.schema[c] for c in extra] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics([t or "" for t in b.column(len(extra)).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(extra))] + [pa.array(forest.score(x))], names=schema.names)

    (own,) = common.unused(docs, "__text")
    rows = docs.select(*extra, F.col("text").cast("string").alias(own)).mapInArrow(run, schema)
    return rows.withColumns({"held_out": fold(F.col("doc_id")) == 0, "predicted": (F.col("score") >= accept).cast("int")})


def op7_gbdt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, train(docs, labels), keep_text=False).select("doc_id", "held_out", "score", "predicted")
