"""Token-id files in canonical length-limited Huffman codes.

One code is made for the whole set of files from the global counts of ids. A file holds blocks
of ``BLOCK`` ids; the bit offset of each block is stored, so blocks decode independently, and
the decoder walks all blocks of a file in step with one table lookup per id and block.

File: magic ``LTOK1``, then little-endian: id width of the table (u32), number of ids (u64),
number of documents (u64), first id position (u64), the code length of each id (u8 each), the
documents' ids (i64 each) and id counts (u32 each), block bit offsets (u64 each), the number of
code words (u64) and the bits as big-endian 32-bit words.

Defined results: a null text is the empty text, so its document has the end id only; an empty
table gives no file and an empty result; documents are in ascending id order, equal texts are
stored each; very long texts span blocks like any other; further columns are not written.
"""

from __future__ import annotations

import array
import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .alignment import ByteTokens

BLOCK, MAX_BITS, FILE_IDS, MAGIC = 512, 20, 2_000_000, b"LTOK1\0\0\0"
#: Files that a task reads, and documents of a part at which one is planned.
FILES_A_TASK, PART_DOCS = 8, 50_000
_HEAD = struct.Struct("<8sIQQQ")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of a best prefix code with no word over ``limit`` bits, by package merge; 0 for ids without count.

    Packages are kept as (weight, how many of the lightest leaves and packages they hold), so a
    level needs two sorted arrays only.
    """
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError("too many ids for the length limit")
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, packed = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packed])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(leaf))
        merged = both[at]
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by (length, id), each the last plus one, shifted as lengths grow."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        at = np.flatnonzero(lengths == size)
        codes[at] = code + np.arange(len(at), dtype=np.uint64)
        code += len(at)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """id << 5 | length for each possible run of the next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32), 1 << (bits - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << bits) - len(table), dtype=np.uint32)]), bits


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words, bit offset of each block)."""
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size, dtype=np.uint64)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    # a code of up to 32 bits lies in two neighbouring words; bits never overlap, so sums are unions
    wide = codes[ids] << (np.uint64(64) - size - (start & np.uint64(31)))
    at = (start >> np.uint64(5)).astype(np.int64)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4"), start[::BLOCK]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The ids; one step decodes the next id of every block."""
    w = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    out = np.zeros((len(offsets), BLOCK), dtype=np.uint32)
    at = offsets.astype(np.uint64).copy()
    left = n - (len(offsets) - 1) * BLOCK if n else 0
    last = np.uint64(len(words) * 32)
    shift = np.uint64(64 - bits)
    for k in range(BLOCK):
        live = slice(None) if k < left else slice(0, len(offsets) - 1)
        pos = np.minimum(at[live], last)
        word = (pos >> np.uint64(5)).astype(np.int64)
        window = ((w[word] << np.uint64(32) | w[word + 1]) << (pos & np.uint64(31))) >> shift
        hit = table[window.astype(np.int64)]
        out[live, k] = hit >> np.uint32(5)
        at[live] = pos + (hit & np.uint32(31))
    return out.reshape(-1)[:n]


def file_bytes(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, first: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, offsets = pack(ids, lengths, codes)
    head = _HEAD.pack(MAGIC, len(lengths), len(ids), len(doc_ids), first)
    return b"".join([head, lengths.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), struct.pack("<Q", len(words)), words.tobytes()])


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document ids, id counts, ids, position of the first id)."""
    magic, width, n, docs, first = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    parts = []
    for kind, count in (("u1", width), ("<i8", docs), ("<u4", docs), ("<u8", -(-n // BLOCK))):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    (m,) = struct.unpack_from("<Q", data, at)
    lengths, doc_ids, sizes, offsets = parts
    ids = unpack(np.frombuffer(data, ">u4", m, at + 8), offsets, n, *_table(lengths.tobytes()))
    return doc_ids, sizes, ids, first


@functools.lru_cache(maxsize=1)
def _table(lengths: bytes) -> tuple[np.ndarray, int]:
    return decode_table(np.frombuffer(lengths, "u1"))


class LibraryEncoder:
    """The tokenizers library's byte-level BPE. Texts without special tokens are cut by their merges' ranks, which gives the same ids sooner."""

    #: Fixed value: the pattern of byte-level words.
    WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.cut = ByteTokens(path, self.WORDS).encode
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.kind = "H" if self.lib.get_vocab_size() <= 1 << 16 else "I"  # unsigned 16 or 32 bits

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as integers of ``kind``."""
        return [array.array(self.kind, self.lib.encode(t, add_special_tokens=False).ids if any(s in t for s in self.special) else self.cut(t)).tobytes() for t in texts]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_TEXT_IDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
_IDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("used", T.BinaryType()), T.StructField("times", T.BinaryType())])
_COUNT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])
_FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_bytes", T.LongType())])
_DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def encode_documents(docs: DataFrame, path: str, end_id: int, parts: int, file_ids: int) -> DataFrame:
    """Chunks of about ``file_ids`` ids, range-sorted by doc_id.

    part grows with doc_id; seq and before count the chunks and ids of the part so far; docs (i64),
    sizes (u32), ids (u16, or u32 for large vocabularies), the ids used (u32) and how many times (u32) are
    little-endian arrays. Texts are encoded where they lie, so ids are shuffled; bounds come from the doc_id column alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        end = array.array(enc.kind, [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cut = batch.slice(at, 500)
                ids = [i + end for i in enc.encode(cut.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(ids, pa.binary())], names=_TEXT_IDS.names)
        common.give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(library_encoder(path).kind).itemsize
        part, docs, ids, seq, before, held = None, [], [], 0, 0, 0

        def chunk() -> pa.RecordBatch:
            sizes, raw = np.array([len(i) // wide for i in ids], dtype="<u4"), b"".join(ids)
            counts = np.bincount(np.frombuffer(raw, f"<u{wide}"))
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([np.array(docs, dtype="<i8").tobytes()]), pa.array([sizes.tobytes()]), pa.array([raw]), pa.array([used.astype("<u4").tobytes()]), pa.array([counts[used].astype("<u4").tobytes()])], names=_IDS.names)

        for batch in batches:
            for p, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if docs and (p != part or held >= file_ids):
                    yield chunk()
                    docs, ids, seq, before, held = [], [], (seq + 1 if p == part else 0), (before + held if p == part else 0), 0
                part = p
                docs.append(doc)
                ids.append(raw)
                held += len(raw) // wide
        if docs:
            yield chunk()

    own = docs.select(F.col("doc_id").cast("long"), common.text_of(F.col("text")).alias("text"))
    bounds = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] if parts > 1 else None
    rows = own.select(common.range_index(F.coalesce("doc_id", F.lit(-(1 << 63))), [b + 1 for b in bounds or []]).alias("part"), "doc_id", "text")
    rows = rows.mapInArrow(encode, _TEXT_IDS)
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id").mapInArrow(gather, _IDS)


def _ids(chunk: pa.BinaryScalar, n: int) -> np.ndarray:
    raw = chunk.as_buffer()
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def count_ids(encoded: DataFrame, width: int) -> DataFrame:
    """(id, n): each task adds its chunks' counts in one array, then sums are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for used, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(used, "<u4")] += np.frombuffer(times, "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=_COUNT.names)

    return encoded.select("used", "times").mapInArrow(run, _COUNT).groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, uri: str, path: str, end_id: int, parts: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files under ``uri``; the manifest, also at ``uri``/manifest."""
    spark = docs.sparkSession
    width = library_encoder(path).lib.get_vocab_size()
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_DOCS)
    encoded = common.stage(encode_documents(docs, path, end_id, parts, file_ids), "ids")
    counts = np.zeros(width, dtype=np.int64)
    for r in count_ids(encoded, width).collect():  # at most one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    starts, at = {}, 0
    for r in encoded.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per part
        starts[r["part"]] = at
        at += r["n"]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(uri)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        files = []
        for batch in batches:
            for r in range(batch.num_rows):
                part, seq, before, n = (batch.column(i)[r].as_py() for i in range(4))
                doc_ids, sizes = np.frombuffer(batch.column(4)[r].as_buffer(), "<i8"), np.frombuffer(batch.column(5)[r].as_buffer(), "<u4")
                data = file_bytes(doc_ids, sizes, _ids(batch.column(6)[r], n), starts[part] + before, lengths, codes)
                name = f"part-{part:06d}-{seq:05d}.ltok"
                temp = f"{folder}/_tmp-{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(data)
                fs.move(temp, f"{folder}/{name}")
                files.append((name, len(doc_ids), n, starts[part] + before, len(data)))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate([pa.string()] + [pa.int64()] * 4)], names=_FILE.names)

    encoded.drop("used", "times").mapInArrow(run, _FILE).write.parquet(f"{uri}/_manifest")
    common.rename(spark, f"{uri}/_manifest", f"{uri}/manifest")
    common.release(encoded)
    return spark.read.schema(_FILE).parquet(f"{uri}/manifest")


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    files = spark.read.schema(_FILE).parquet(f"{uri}/manifest").select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    docs, sizes, ids, first = parse_file(f.read())
                ends = np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs.astype(np.int64)), pa.array(begins + first), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=_DOC.names)

    return files.repartition(max(1, -(-files.count() // FILES_A_TASK))).mapInArrow(run, _DOC)


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    uri = common.new_path(spark, "tokens")
    write_token_files(docs, uri, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, uri)
