"""SQL functions over packed series: ts_compress, ts_decompress, ts_extract and ts_rebuild; null gives null.

``ts_points`` is a table function, for LATERAL: the points of a payload; null and empty payloads have none. It goes row by row,
as Spark has no lateral join with Arrow functions; ``register_points`` makes one for tables of given keys that goes
in Arrow batches. ``ts_pack`` is an aggregate: the payload of a group's values in order of
their index; it holds a group in one task, as any aggregate of its kind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import codec

_NUMBERS = T.ArrayType(T.DoubleType())
_EXTRACTED = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("coefficients", _NUMBERS)])


def _compress(values: pd.Series, method: pd.Series, config: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else codec.compress(v, m, c) for v, m, c in zip(values, method, config)], dtype=object)


def _decompress(payload: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else codec.decompress(p) for p in payload], dtype=object)


def _extract(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if p is None else codec.extract(p) for p in payload], columns=_EXTRACTED.names)


def _rebuild(indices: pd.Series, coefficients: pd.Series, method: pd.Series) -> pd.Series:
    return pd.Series([None if i is None or c is None else codec.rebuild(i, c, m) for i, c, m in zip(indices, coefficients, method)], dtype=object)


def _pack(idx: pd.Series, value: pd.Series, method: pd.Series, config: pd.Series) -> bytes:
    if value.isna().all() and idx.isna().all():
        return None
    return codec.compress(value.to_numpy(dtype=np.float64)[np.argsort(idx.to_numpy(), kind="stable")], method.iloc[0], config.iloc[0])


@F.udtf(returnType="idx bigint, value double", useArrow=False)
class _Points:
    def eval(self, payload: bytes):
        if payload:
            yield from enumerate(codec.decompress(bytes(payload)).tolist())


class _PointsOf:
    def eval(self, rows: pa.RecordBatch):
        found = [codec.decompress(p.as_py() or b"") for p in rows.column("payload")]
        many = np.array([len(v) for v in found], dtype=np.int64)
        at = pa.array(np.repeat(np.arange(len(many)), many))
        kept = {n: rows.column(n).take(at) for n in rows.schema.names if n != "payload"}
        starts = np.repeat(np.cumsum(many) - many, many)
        yield pa.table({**kept, "idx": pa.array(np.arange(len(starts)) - starts, pa.int64()), "value": pa.array(np.concatenate([*found, np.zeros(0)]))})


def register_points(spark: SparkSession, name: str, keys: str) -> None:
    """A table function ``name(TABLE(SELECT keys, payload ...))`` that gives keys, idx and value in Arrow batches; ``keys`` as in a schema."""
    spark.udtf.register(name, F.arrow_udtf(type("PointsOf", (_PointsOf,), {}), returnType=f"{keys}, idx bigint, value double"))


def register(spark: SparkSession) -> None:
    for name, f, kind in (("ts_compress", _compress, T.BinaryType()), ("ts_decompress", _decompress, _NUMBERS), ("ts_extract", _extract, _EXTRACTED), ("ts_rebuild", _rebuild, T.BinaryType())):
        spark.udf.register(name, F.pandas_udf(f, kind))
    spark.udf.register("ts_pack", F.pandas_udf(_pack, T.BinaryType()))
    spark.udtf.register("ts_points", _Points)
