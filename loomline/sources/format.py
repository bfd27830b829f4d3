"""``spark.read.format("loomline")``: compressed tables as a data source that gives points.

A table is a folder of Parquet files, one a writing task, with a manifest that has each file's range of the first
key and of indices. Written are compressed rows: key columns, chunk (optional), method, n, payload. Read are points: the keys, idx and
value. A read schema without value decodes nothing. As ``loomline_pushed`` (see ``read_points``) filters on the first key and
idx leave out files by the manifest, and rows before they are decoded. Writers leave files under names of their own; they are part of
the table once the manifest that names them is in place.

Options: ``path`` (a URI that pyarrow's file systems know), ``chunk`` (points of a chunk, when writing).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..kernels import codec

_MANIFEST = "_points.json"
_OWN = ("chunk", "method", "n", "payload")
#: Compressed rows that are decoded at once.
_BATCH = 256


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Compressed)
    spark.dataSource.register(Pushed)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A frame of the points of a table, for one query, whose filters leave out files and chunks.

    Spark keeps what a reader made of pushed filters with the loaded frame and uses it again for a query whose filters it
    cannot push, which would then lack rows. So this frame serves one query; one of the format ``loomline`` serves many.
    """
    return spark.read.format("loomline_pushed").option("path", path).load()


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifest(path: str) -> dict:
    fs, at = _place(path)
    with fs.open_input_stream(f"{at}/{_MANIFEST}") as f:
        return json.loads(f.read())


def _schema_of(keys: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(keys))


class Compressed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomline"

    def schema(self) -> T.StructType:
        keys = _schema_of(_manifest(self.options["path"])["keys"])
        return T.StructType([*keys.fields, T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType())])

    def reader(self, schema: T.StructType) -> PointReader:
        return PointReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> CompressedWriter:
        return CompressedWriter(self.options["path"], schema, overwrite, int(self.options.get("chunk", 0)))


@dataclass
class _Written(WriterCommitMessage):
    files: list


@dataclass
class _File(InputPartition):
    name: str
    chunk: int


class CompressedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, chunk: int):
        missing = {"method", "n", "payload", *(["chunk"] if chunk else [])} - set(schema.names)
        if missing:
            raise ValueError(f"compressed rows need {sorted(missing)}")
        self.path, self.schema, self.overwrite, self.chunk = path, schema, overwrite, chunk
        self.keys = T.StructType([f for f in schema if f.name not in _OWN])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _place(self.path)
        rows = pa.Table.from_batches(list(iterator), schema=to_arrow_schema(self.schema))
        if not rows.num_rows:
            return _Written([])
        first = self.keys.names[0]
        rows = rows.sort_by([(k, "ascending") for k in [*self.keys.names, *(["chunk"] if self.chunk else [])]])
        fs.create_dir(at, recursive=True)
        name = f"rows-{uuid.uuid4().hex}.parquet"
        pq.write_table(rows, f"{at}/{name}", filesystem=fs, row_group_size=4096)
        ends = pc.min_max(rows.column(first)).as_py()
        known = rows.column(first).null_count == 0 and isinstance(ends["min"], (int, float, str))
        base = pc.multiply(rows.column("chunk"), self.chunk) if self.chunk else None
        low = pc.min(base).as_py() if self.chunk else 0
        high = pc.max(pc.add(base, rows.column("n")) if self.chunk else rows.column("n")).as_py()
        return _Written([{"name": name, "low": ends["min"] if known else None, "high": ends["max"] if known else None, "from": low, "until": high, "methods": pc.unique(rows.column("method")).to_pylist(), "chunk": self.chunk}])

    def commit(self, messages: list[_Written | None]) -> None:
        fs, at = _place(self.path)
        old = [] if self.overwrite or fs.get_file_info(f"{at}/{_MANIFEST}").type == pafs.FileType.NotFound else _manifest(self.path)["files"]
        stale = [f.base_name for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))] if self.overwrite else []
        files = [*old, *(f for m in messages if m for f in m.files)]
        fs.create_dir(at, recursive=True)
        work = f"{at}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(work) as f:
            f.write(json.dumps({"keys": self.keys.json(), "files": files}).encode())
        fs.move(work, f"{at}/{_MANIFEST}")
        own = {f["name"] for f in files}
        for name in stale:
            if name.startswith("rows-") and name not in own:
                fs.delete_file(f"{at}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, at = _place(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{at}/{f['name']}")


class PointReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.fields = path, schema
        self.manifest = _manifest(path)
        self.key = _schema_of(self.manifest["keys"]).names[0]
        self.tests: list[tuple[str, str, object]] = []

    def _may(self, low, high, column: str) -> bool:
        """Whether a value from ``low`` to ``high`` can pass the tests of a column."""
        for name, op, v in self.tests:
            if name != column or low is None:
                continue
            if op == "in":
                if not any(low <= x <= high for x in v if x is not None):
                    return False
            elif (op == "==" and not low <= v <= high) or (op in (">", ">=") and (high < v or (op == ">" and high == v))) or (op in ("<", "<=") and (low > v or (op == "<" and low == v))):
                return False
        return True

    def partitions(self) -> list[_File]:
        return [_File(f["name"], f["chunk"]) for f in self.manifest["files"] if self._may(f["low"], f["high"], self.key) and self._may(f["from"], f["until"] - 1, "idx")]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        fs, at = _place(self.path)
        chosen = [(n, op, list(v) if op == "in" else v) for n, op, v in self.tests if n == self.key]
        keys = [n for n in self.fields.names if n not in ("idx", "value")]
        columns = [*dict.fromkeys([*keys, self.key]), "n", *(["chunk"] if partition.chunk else []), *(["payload"] if "value" in self.fields.names else [])]
        rows = pq.read_table(f"{at}/{partition.name}", filesystem=fs, columns=columns, filters=chosen or None)
        schema = to_arrow_schema(self.fields)
        for batch in rows.to_batches(max_chunksize=_BATCH):
            n = batch.column("n").to_numpy()
            start = batch.column("chunk").to_numpy() * partition.chunk if partition.chunk else np.zeros(len(n), np.int64)
            own = np.flatnonzero([self._may(a, a + k - 1, "idx") for a, k in zip(start.tolist(), n.tolist())])
            made = {k: batch.column(k).take(pa.array(np.repeat(own, n[own]))) for k in keys}
            made["idx"] = np.concatenate([np.arange(start[i], start[i] + n[i]) for i in own]) if len(own) else np.zeros(0, np.int64)
            if "value" in self.fields.names:
                payloads = batch.column("payload")
                made["value"] = np.concatenate([codec.decompress(payloads[int(i)].as_py() or b"") for i in own]) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name] for f in schema], schema=schema)


class PushedReader(PointReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the first key and idx are used here, and left to Spark as well where they do not settle each row."""
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in kinds and column in (self.key, "idx"):
                self.tests.append((column, kinds[type(f)], f.value))
            yield f


class Pushed(Compressed):
    @classmethod
    def name(cls) -> str:
        return "loomline_pushed"

    def reader(self, schema: T.StructType) -> PushedReader:
        return PushedReader(self.options["path"], schema)
