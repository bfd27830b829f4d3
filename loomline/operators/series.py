"""The four verbs over DataFrames of series.

A series is the rows of one key in a given order. Long form: keys, idx, value; packed form: keys,
values (array). Packing is one shuffle by key with JVM-side collection; kernels then run over
Arrow batches of packed series, without a further shuffle. ``chunk`` cuts long series into pieces
of that many points, each compressed by itself (the piece number joins the keys), so no task holds
an unbounded series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import codec
from ..methods import Method, SeriesError, method_of, parse_config

CHUNK = "chunk"
_PAYLOAD = [T.StructField("method", T.ByteType()), T.StructField("n", T.LongType()), T.StructField("payload", T.BinaryType())]
#: Absolute and relative tolerance of nearly_equal.
ABS_TOLERANCE, REL_TOLERANCE = 1e-12, 1e-15


def to_points(df: DataFrame, keys: list[str], order: list[str], value: str = "value", nulls: str = "raise") -> DataFrame:
    """keys, idx (from 0), value as double. Null values raise, or are dropped before indexing."""
    v = F.col(value).cast("double")
    if nulls == "drop":
        df = df.where(F.col(value).isNotNull())
    else:
        v = F.when(v.isNull(), F.raise_error(F.lit("a series holds a null value")).cast("double")).otherwise(v)
    idx = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.select(*keys, idx.cast("long").alias("idx"), v.alias("value"))


def present(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; a null in a key raises, for plans that join on keys."""
    return df.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key {k}")).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k in keys})


def pack(points: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """keys (and chunk), values: each series, or piece of one, as an array in order."""
    by = list(keys)
    if chunk:
        points = points.withColumn(CHUNK, F.expr(f"idx div {int(chunk)}"))
        by.append(CHUNK)
    rows = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("p"))
    return rows.select(*by, F.col("p.value").alias("values"))


def unpack(packed: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """Points of packed series."""
    rows = packed.select(*keys, *([CHUNK] if chunk else []), F.posexplode("values").alias("i", "value"))
    idx = F.col("i").cast("long") + (F.col(CHUNK) * int(chunk) if chunk else F.lit(0))
    return rows.select(*keys, idx.alias("idx"), "value")


def _mapped(df: DataFrame, reads: list[str], fields: list[T.StructField], step: Callable[[dict], tuple | list[tuple]], keep: list[str] = (), many: bool = False) -> DataFrame:
    """``df`` with ``fields`` that ``step`` makes from the columns ``reads`` of a row, which go unless they are in ``keep``; ``many``: a list of rows for each.

    On the result of another such step, unless that is cached, both run in one pass: a chain of verbs has one Python worker a task, and nothing goes back to the JVM between them.
    """
    kept = [c for c in df.columns if (c not in reads or c in keep) and c not in {f.name for f in fields}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    source, before = (df, None) if df.is_cached else getattr(df, "_mapped_from", (df, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for b in batches if before is None else before(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                rows = [step({c: cols[c][i] for c in reads}) for i in range(part.num_rows)]
                beside = [cols[c] for c in kept]
                if many:
                    at_row = pa.array([i for i, own in enumerate(rows) for _ in own], pa.int32())
                    beside, rows = [c.take(at_row) for c in beside], [r for own in rows for r in own]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(beside + made, names=schema.names)

    out = source.mapInArrow(run, schema)
    out._mapped_from = source, run
    return out


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return np.asarray(x.values, dtype=np.float64) if x.is_valid else np.zeros(0)


def nearly_equal(a: Column, b: Column) -> Column:
    """Whether two doubles differ by no more than either tolerance; infinities equal themselves only, NaN equals nothing, null gives null."""
    gap, size = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    close = (size < F.lit(float("inf"))) & ((gap <= ABS_TOLERANCE) | (gap <= size * REL_TOLERANCE))
    return F.when(a.isNotNull() & b.isNotNull(), ~F.isnan(a) & ~F.isnan(b) & ((a == b) | close))


def compress(packed: DataFrame, method: Method | int | str, config: dict | str | None = None, permissive: bool = False) -> DataFrame:
    """Packed series to (…, method, n, payload); the configuration is checked before any job starts.

    Permissive: a series that the method refuses gets a null payload and its error_code.
    """
    method = method_of(method)
    parse_config(method, config)

    code = (0,) if permissive else ()

    def step(r: dict) -> tuple:
        x = _numbers(r["values"])
        try:
            return int(method), len(x), codec.compress(x, method, config), *code
        except SeriesError as e:
            if not permissive:
                raise
            return int(method), len(x), None, e.code

    return _mapped(packed, ["values"], [*_PAYLOAD, *[T.StructField("error_code", T.IntegerType())] * permissive], step)


def compress_each(packed: DataFrame, configs: dict[Method, dict]) -> DataFrame:
    """As ``compress``, with one row for each series and method: one pass over the series for all methods."""
    for method, config in configs.items():
        parse_config(method, config)

    def step(r: dict) -> list[tuple]:
        x = _numbers(r["values"])
        return [(int(m), len(x), codec.compress(x, m, c)) for m, c in configs.items()]

    return _mapped(packed, ["values"], _PAYLOAD, step, many=True)


def _guarded(df: DataFrame, reads: list[str], fields: list[T.StructField], step, permissive: bool, keep: list[str] = ()) -> DataFrame:
    """Rows mapped by ``step``; permissive: a refused row gets nulls and its error_code, others the code 0.

    A row that has an error_code already, as of a series refused before, keeps it.
    """
    code, known = "error_code", "error_code" in df.columns

    def guarded(r: dict) -> tuple:
        if known and r[code].as_py():
            return (*[None] * len(fields), r[code].as_py())
        try:
            return (*step(r), 0)
        except SeriesError as e:
            return (*[None] * len(fields), e.code)

    if not permissive:
        return _mapped(df, reads, fields, step, keep)
    return _mapped(df, [*reads, *[code] * known], [*fields, T.StructField(code, T.IntegerType())], guarded, keep)


def decompress(compressed: DataFrame, permissive: bool = False, keep: bool = False) -> DataFrame:
    """(…, payload) to (…, values), with the payload beside them if ``keep``; a null payload, as of a refused series, has null values."""
    return _guarded(compressed, ["payload"], [T.StructField("values", T.ArrayType(T.DoubleType()))], lambda r: (codec.decompress(r["payload"].as_py()) if r["payload"].is_valid else None,), permissive, ["payload"] * keep)


def extract(compressed: DataFrame, permissive: bool = False, keep: bool = False) -> DataFrame:
    """(…, payload) to (…, indices, coefficients), with the payload beside them if ``keep``.

    A series of one point is stored raw and has neither: it is refused, or null if permissive.
    """
    fields = [T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("coefficients", T.ArrayType(T.DoubleType()))]
    return _guarded(compressed, ["payload"], fields, lambda r: codec.extract(r["payload"].as_py() or b""), permissive, ["payload"] * keep)


def rebuild(extracted: DataFrame, method: Method | int | str | None = None, permissive: bool = False, into: str = "payload") -> DataFrame:
    """(…, indices, coefficients) to (…, payload), under the name ``into``; without a method, each row's own one from its column."""
    fixed = None if method is None else method_of(method)

    def step(r: dict) -> tuple:
        return (codec.rebuild(r["indices"].as_py() or [], r["coefficients"].as_py() or [], r["method"].as_py() if fixed is None else fixed),)

    own = ["method"] if fixed is None else []
    return _guarded(extracted, ["indices", "coefficients", *own], [T.StructField(into, T.BinaryType())], step, permissive, own)


def evaluate(points: DataFrame, decoded: DataFrame, keys: list[str], bound: float | None = None) -> DataFrame:
    """keys, n, n_decoded, max_abs_err, rmse (and within_bound) of decoded points against the raw ones."""
    both = points.join(decoded.withColumnRenamed("value", "decoded"), [*keys, "idx"], "full_outer")
    gap = F.abs(F.col("value") - F.col("decoded"))
    out = both.groupBy(*keys).agg(F.count("value").alias("n"), F.count("decoded").alias("n_decoded"), F.max(gap).alias("max_abs_err"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    if bound is None:
        return out
    return out.withColumn("within_bound", (F.col("n") == F.col("n_decoded")) & (F.col("max_abs_err") <= F.lit(bound)))
