"""Alignment of the tokens of two tokenizers over the same texts.

A byte-level BPE (A) and a piece model (B) cut each text, with a space before it, into byte ranges. Byte offsets at which
tokens of both end cut them into groups; tokens whose ranges overlap are linked. Over the whole corpus
each pair of linked ids is counted by the documents that hold it.

One pass in Arrow batches makes a row a document with its distinct pairs; the pairs are counted in
two shuffles, salted first, so that no pair meets in one task before it is a few partial sums. The counts
go back to the documents by a look-up in sorted arrays, which each worker holds, while there are at most
``MOST_PAIRS`` of them; beyond that by a join of each document's pairs with the counts.

Defined results: texts that are null, empty or not what their tokens spell in either vocabulary (such as one
with the piece model's own space mark) have no tokens; the strings of special tokens are plain text; equal
texts and repeated rows are documents each; ids may be null or repeat; an empty table gives an empty
result; other columns, of any name, are passed through unless they bear a result's name; very long
texts are cut as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import byte_chars

#: Pairs up to which all counts go to each worker (16 bytes a pair), salts of the first shuffle, and documents that are cut at once.
MOST_PAIRS, SALTS, AT_ONCE = 4_000_000, 16, 64
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_SPACE_MARK = "▁"
_RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class ByteTokens:
    """A byte-level BPE of the tokenizers library's files, run by its merge order."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("ids must be in the order of the merges")
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token
        if not {bytes([b]) for b in range(256)} <= vocab.keys():
            raise ValueError("the vocabulary lacks a byte")


class PieceTokens:
    """A piece model with byte fallback; it puts the space before the text itself."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode_all = functools.partial(model.encode, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    def __init__(self, byte_path: str, pattern: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path, pattern), PieceTokens(piece_path)
        self.sizes = [np.array(list(map(len, t.bytes_of)), dtype=np.int64) for t in (self.a, self.b)]
        #: each id's digits with what can follow them
        self.digits = [[b"%d%s" % (i, end) for end in (b",", close) for i in range(len(t.bytes_of))] for t, close in ((self.a, b"|"), (self.b, b";"))]
        self.after = len(self.digits[0])
        self.digits = self.digits[0] + self.digits[1]

    def cut(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """(ids of A, ids of B) of each text, both empty if B's do not spell a space and the text.

        A's vocabulary has every byte and its pattern every character, so its tokens always do.
        """
        out = []
        for text, b in zip(texts, self.b.encode_all(texts)):
            if not text:
                out.append(([], []))
                continue
            good = b"".join(map(self.b.bytes_of.__getitem__, b)) == (" " + text).encode()
            out.append((self.a.encode(" " + text), b) if good else ([], []))
        return out

    def align(self, a_ids: list[int], b_ids: list[int]) -> tuple:
        """(groups, links, groups as text, distinct pairs a << 32 | b ascending, links of each)."""
        if not a_ids:
            return 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int32)
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        # groups as text: A's tokens of a group before B's
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        a_last, b_last = cuts[a_group] == a_end, cuts[b_group] == b_end
        codes[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + a_last * len(self.sizes[0])
        codes[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = self.after + b + b_last * len(self.sizes[1])
        text = b"".join(map(self.digits.__getitem__, codes.tolist()))[:-1]
        # links: of each token of A all of B that end after its start and start before its end
        low = np.searchsorted(b_end, np.r_[0, a_end[:-1]], "right")
        many = np.searchsorted(b_end, a_end, "left") - low + 1
        first = np.cumsum(many) - many
        at = np.repeat(low - first, many) + np.arange(int(many.sum()))
        pairs, times = np.unique(np.repeat(a, many) << 32 | b[at], return_counts=True)
        return len(cuts), len(at), text, pairs, times.astype(np.int32)


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, pattern: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, pattern, piece_path)


_ALIGNED = T.StructType([T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))


def aligned(texts: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """(row, text) to (row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)."""
    schema = T.StructType([texts.schema["row"], *_ALIGNED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, pattern, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = []
                for a, b in aligner.cut([t or "" for t in part.column("text").to_pylist()]):
                    groups, links, text, pairs, times = aligner.align(a, b)
                    rows.append((len(a), len(b), groups, links, hashlib.sha256(text).hexdigest() if a else "", pairs, times))
                numbers = list(zip(*rows))
                made = [pa.array(c, pa.int64()) for c in numbers[:4]] + [pa.array(numbers[4], pa.string()), _lists(numbers[5], pa.int64()), _lists(numbers[6], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=schema.names)
        common.give_back()

    return texts.mapInArrow(run, schema)


def pair_counts(found: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, docs, best): how many rows hold each pair, and whether no pair of its A id is in more."""
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    parts = found.select(F.explode("pairs").alias("pair"), salt).groupBy("pair", "salt").agg(F.count("*").alias("docs"))
    counts = parts.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most as many pairs as B's vocabulary has entries
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(found: DataFrame, counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``found`` less its pairs, with n_best and count_sum."""
    spark, kept = found.sparkSession, [c for c in found.columns if c not in ("pairs", "times")]
    if counts.limit(most + 1).count() > most:
        each = found.select("rid", F.inline(F.arrays_zip("pairs", "times"))).join(counts, F.col("pairs") == F.col("pair"))
        sums = each.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return found.select(*kept).join(sums, "rid", "left").select(*kept, zero("n_best"), zero("count_sum"))
    table = counts.toArrow()
    order = np.argsort(keys := table.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast((keys[order], table.column("docs").to_numpy()[order], table.column("best").to_numpy()[order]))
    schema = T.StructType([*(found.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            ends = np.cumsum(np.r_[0, pairs.value_lengths().to_numpy()])
            at = np.searchsorted(keys, pairs.flatten().to_numpy())
            sums = [np.diff(np.r_[0, np.cumsum(times * x[at], dtype=np.int64)][ends]) for x in (best, docs)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(s, pa.int64()) for s in sums], names=schema.names)

    return found.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PAIRS, carry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``docs``, or their ids only, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; the corpus's pairs as a_id, b_id, docs, best)."""
    names = [c for c in docs.columns if c not in _RESULTS] if carry else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), common.text_of(F.col(text_col)).alias("text"))
    found = common.stage(aligned(rows, byte_path, pattern, piece_path).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = common.stage(pair_counts(found), "pairs")
    out = scored(found, counts, most).select(*[F.col("row").getField(c).alias(c) for c in names], *_RESULTS)
    return out, counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "docs", "best")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokens(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN, tokenizers.path("piece_bpe_32k.model"), carry=False)[0]
