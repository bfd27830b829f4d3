"""Reading series from tables and keeping compressed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..methods import Method, method_of
from ..operators import series
from ..operators.series import to_points
from ..plans import native

#: Series of the driver's tables: key columns, order columns and value.
SERIES = {
    "events": (["user_id"], ["ts", "event_id"], "value"),
    "lineitem": (["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], "l_quantity"),
    "orders": (["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice"),
}


def read_points(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """Points of the series of a table; only key, order and value columns are read."""
    keys, order, value = SERIES[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*dict.fromkeys([*keys, *order, value]))
    return to_points(df, keys, order, value)


def write_compressed(compressed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Payloads by method, so that a reader of one method reads only its files."""
    compressed.write.mode(mode).partitionBy("method").parquet(path)


def read_compressed(spark: SparkSession, path: str, method: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if method is None else df.where(df["method"] == int(method))


def zoned(packed: DataFrame, keys: list[str], method: Method | int | str, config: dict | None = None) -> DataFrame:
    """Packed series compressed, with the least and most of each row's decoded values beside the payload.

    Constants and lines between end values have their extremes in their coefficients; other methods are decoded once here.
    A row with a NaN has it as its most, which is above every number.
    """
    method = method_of(method)
    rows = series.compress(packed, method, config)
    if method in native._SEGMENTED:
        rows = series.extract(rows, permissive=True, keep=True).withColumnRenamed("payload", "kept")
        # a single value is stored raw and has no model
        rows = series.decompress(rows.withColumn("payload", F.when(F.col("error_code") != 0, F.col("kept"))))
        seen = F.coalesce(F.when(F.size("coefficients") > 0, F.col("coefficients")), F.col("values"))
        rows = rows.withColumn("seen", seen).drop("indices", "coefficients", "error_code", "values").withColumnRenamed("kept", "payload")
    else:
        rows = series.decompress(rows, keep=True).withColumnRenamed("values", "seen")
    return rows.select(*[c for c in packed.columns if c != "values"], "method", "n", "payload", F.array_min("seen").alias("least"), F.array_max("seen").alias("most"))


def may_hold(compressed: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The rows of a zoned table that can hold a value from ``low`` to ``high``: plain comparisons, which reach the Parquet reader."""
    if low is not None:
        compressed = compressed.where(F.col("most") >= F.lit(low))
    if high is not None:
        compressed = compressed.where(F.col("least") <= F.lit(high))
    return compressed


def values_between(compressed: DataFrame, keys: list[str], low: float | None = None, high: float | None = None, chunk: int | None = None) -> DataFrame:
    """Points of a zoned table with a value from ``low`` to ``high``; only rows that can hold one are decoded. NaN is above every number."""
    columns = [*keys, *([series.CHUNK] if chunk else []), "payload"]
    points = series.unpack(series.decompress(may_hold(compressed, low, high).select(*columns)), keys, chunk)
    if low is not None:
        points = points.where(F.col("value") >= F.lit(low))
    return points if high is None else points.where(F.col("value") <= F.lit(high))
