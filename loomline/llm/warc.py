"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id, written as gzip members into files that roll by compressed
size, and committed by renaming: each file is written under a temporary name and moved to its
final name, then the manifest (one row per file) is moved into place last. Headers and digests
are made from the payload alone, so a task that runs again writes the same bytes under the same
names. The reader takes the files from the manifest and checks lengths and digests.

Records with equal payloads of at least ``min_revisit`` bytes: that of the smallest id is the
response, the others are revisits, whose HTTP header keeps the payload's length and whose
WARC-Payload-Digest names it.

Defined results: a null payload is an empty one; an empty table gives an archive with an empty
manifest; ids are unique integers, ties cannot occur; further columns are not written.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_REVISIT, FILE_BYTES, SHARD_BYTES, PER_SHARD = 100, 64 << 20, 64 << 20, 64
_MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("file_crc32", T.LongType())])
_RECORD = T.StructType([T.StructField("record_key", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])
_ID = "urn:uuid:"


def record_id(key: int) -> str:
    """A name-based id, the same on each run; the key itself is in its own header."""
    return _ID + str(uuid.uuid5(uuid.NAMESPACE_URL, f"record:{key}"))


def record_bytes(key: int, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record: WARC header, HTTP header and, for a response, the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "").replace("\r", "").replace("\n", "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(key)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Record-Key: {key}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Key: {refers_to}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def deflated(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes members into files of about ``limit`` compressed bytes, each under a temporary name first."""

    def __init__(self, uri: str, limit: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(uri)
        self.limit, self.out = limit, None

    def put(self, shard: int, key: int, member: bytes) -> Iterator[tuple]:
        if self.out is not None and (shard != self.shard or (self.size and self.size + len(member) > self.limit)):
            yield self.close()
        if self.out is None:
            self.seq = self.seq + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.first, self.size, self.n, self.crc = shard, key, 0, 0, 0
            task = TaskContext.get()
            self.temp = f"{self.dir}/_tmp-{shard:06d}-{self.seq:05d}-{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(member)
        self.last, self.size, self.n, self.crc = key, self.size + len(member), self.n + 1, zlib.crc32(member, self.crc)

    def close(self) -> tuple:
        self.out.close()
        name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.dir}/{name}")
        self.out = None
        return (name, self.n, self.size, self.first, self.last, self.crc)


def with_revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(key, payload_bytes, payload_digest, refers_to) of (key, url, payload); refers_to is null for a response.

    One row per digest is made by a partial aggregation; the join is an ordinary one that can split
    a partition of many copies.
    """
    rows = records.select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= min_revisit).groupBy(F.col("payload_digest").alias("__digest")).agg(F.min("key").alias("__first"), F.count("*").alias("__n"))
    first = first.where(F.col("__n") > 1).select("__digest", "__first")
    rows = rows.join(first, rows["payload_digest"] == first["__digest"], "left")
    return rows.withColumn("refers_to", F.when(F.col("__first") < F.col("key"), F.col("__first"))).drop("__digest", "__first")


def shard_bounds(records: DataFrame, shard_bytes: int, per_shard: int = PER_SHARD) -> list[int]:
    """Id boundaries of the shards, from the ids with the smallest hashes: the same on each run."""
    total = records.agg(F.sum(F.octet_length("payload") + 512)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ids = sorted(r[0] for r in records.select("key").orderBy(F.xxhash64("key"), "key").limit(shards * per_shard).collect())
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def write_warc(records: DataFrame, uri: str, date: datetime.datetime = datetime.datetime(2024, 1, 1), file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit: int = MIN_REVISIT, level: int = 6) -> DataFrame:
    """Write (key, url, payload) as an archive under ``uri``; the manifest, also at ``uri``/manifest."""
    spark = records.sparkSession
    records = records.select(F.col("key").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    bounds, stamp = shard_bounds(records, shard_bytes), date.strftime("%Y-%m-%dT%H:%M:%SZ")
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    shard = common.range_index(F.col("key"), bounds)
    marks = with_revisits(records, min_revisit).where(F.col("refers_to").isNotNull()).select(shard.alias("shard"), "key", "refers_to")
    # payloads are shuffled once; a revisit's mark sorts just before its record
    rows = records.select(shard.alias("shard"), "key", F.lit(None).cast("long").alias("refers_to"), "url", "payload", F.sha2("payload", 256).alias("payload_digest"))
    rows = rows.unionByName(marks, allowMissingColumns=True)
    rows = rows.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", F.col("refers_to").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, files, mark = _Roller(uri, file_bytes), [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["refers_to"] is not None:
                    mark = (r["key"], r["refers_to"])
                    continue
                refers_to = mark[1] if mark and mark[0] == r["key"] else None
                data = record_bytes(r["key"], r["url"], r["payload"], r["payload_digest"], len(r["payload"]), refers_to, stamp)
                files += roller.put(r["shard"], r["key"], deflated(data, level))
        if roller.out is not None:
            files.append(roller.close())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate([pa.string()] + [pa.int64()] * 5)], names=_MANIFEST.names)

    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{uri}/_manifest")
    common.rename(spark, f"{uri}/_manifest", f"{uri}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest")


def parse_records(data: Iterator[bytes]) -> Iterator[dict]:
    """Records of a stream of gzip members; lengths and digests are checked."""
    z, buf = zlib.decompressobj(31), bytearray()
    for chunk in data:
        while chunk:
            buf += z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                if buf:
                    yield _parse(bytes(buf))
                z, buf = zlib.decompressobj(31), bytearray()
    if buf:
        raise ValueError("the archive ends within a record")


def _parse(rec: bytes) -> dict:
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload is damaged")
    return {"record_key": int(fields["X-Record-Key"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(fields["X-Refers-To-Key"]) if revisit else None, "payload": None if revisit else payload}


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """Records of an archive by its manifest: record_key, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    files = spark.read.schema(_MANIFEST).parquet(f"{uri}/manifest").select("file")
    names = [f for f in _RECORD.names if with_payload or f != "payload"]
    schema = T.StructType([_RECORD[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(uri)
        kinds = pa.schema([("record_key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        kinds = pa.schema([kinds.field(n) for n in names])
        rows, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    for r in parse_records(iter(lambda: f.read(1 << 20), b"")):
                        rows.append({n: r[n] for n in names})
                        size += 300 + (len(r["payload"] or b"") if with_payload else 0)
                        if size > batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, kinds)

    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(run, schema)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    uri = common.new_path(spark, "warc")
    # SHARD_BYTES is meant for large archives; the smaller of it and a task's read size keeps all cores busy
    size = min(SHARD_BYTES, 16 << 20)
    write_warc(pages.select(F.col("page_id").alias("key"), "url", F.encode(common.text_of(F.col("html")), "UTF-8").alias("payload")), uri, shard_bytes=size)
    out = read_warc(spark, uri, with_payload=False)
    return out.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d
"""
