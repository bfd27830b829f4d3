"""As-of joins and multivariate series: each row with the last known value of other series.

The rows of both sides are put on one time axis and the last row of the right side is carried along in a window. A key's axis
is cut into spans of ``width``, so that a window holds a span, not a key: what a span begins with is the last right row of the spans
before it, found over one row a span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LEFT, _RIGHT = "__left", "__right"


def _carried(rows: DataFrame, keys: list[str], width, held: dict[str, Column]) -> DataFrame:
    """``rows`` (keys, t, side, …) with each column of ``held`` as the last struct (t, …) up to their place; side orders rows of one time."""
    rows = rows.withColumns({**held, "__span": F.floor(F.col("t") / F.lit(width)) if width else F.lit(0)})
    # the last value of each span, and for each span that of all before it
    ends = rows.groupBy(*keys, "__span").agg(*(F.max(c).alias(c) for c in held))
    before = W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "__span", *(F.max(c).over(before).alias(c) for c in held)).where(" OR ".join(f"`{c}` IS NOT NULL" for c in held))
    start = ends.withColumn("side", F.lit(-1))
    rows = rows.unionByName(start, allowMissingColumns=True)
    order = W.partitionBy(*keys, "__span").orderBy(F.col("t").asc_nulls_first(), "side").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in held}).where("side >= 0").drop("__span")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, columns: dict[str, str], tolerance=None, width=None, time: str | None = None) -> DataFrame:
    """``left`` with ``columns`` (right's name: new name) of the last row of ``right`` at or before its ``on``.

    ``on`` is a number on both sides; ``tolerance`` is how far back a row counts; ``time`` names a column for the time
    of the row that was found. No row, or none near enough, gives nulls. Of right rows of one time the one with the largest
    values counts. Left rows with a null in ``on`` find nothing; right ones are not found. Keys are equal as in a
    group: null finds null. Other columns of ``left``, of any name, are passed through.
    """
    names, kept = list(columns), list(left.columns)
    value = F.struct(F.col(on).alias("t"), *(F.col(c).alias(c) for c in names))
    a = left.select(*keys, F.col(on).alias("t"), F.lit(1).alias("side"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias(_LEFT))
    b = right.where(F.col(on).isNotNull()).select(*keys, F.col(on).alias("t"), F.lit(0).alias("side"), value.alias(_RIGHT))
    # with rows of one time and side the largest is the last
    rows = b.groupBy(*keys, "t", "side").agg(F.max(_RIGHT).alias(_RIGHT)).unionByName(a, allowMissingColumns=True)
    rows = _carried(rows, keys, width, {_RIGHT: F.col(_RIGHT)}).where("side = 1")
    near = F.col("t").isNotNull() & F.col(_RIGHT).isNotNull()
    if tolerance is not None:
        near &= F.col("t") - F.col(_RIGHT)["t"] <= F.lit(tolerance)
    found = [F.when(near, F.col(_RIGHT)[c]).alias(columns[c]) for c in names] + ([F.when(near, F.col(_RIGHT)["t"]).alias(time)] if time else [])
    return rows.select(*(F.col(_LEFT)[c].alias(c) for c in kept), *found)


def align_series(series: dict[str, DataFrame], keys: list[str], on: str, value: str, tolerance=None, width=None) -> DataFrame:
    """One row for each key and time of any of the series (keys, ``on``, ``value``), with the last known value of each as a column.

    A time that a series has twice counts with its larger value; null values and times are left out. A value older than ``tolerance`` is null.
    """
    parts = [df.where(F.col(on).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(on).alias("t"), F.col(value).alias(f"v_{i}")) for i, df in enumerate(series.values())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.groupBy(*keys, "t").agg(*(F.max(f"v_{i}").alias(f"v_{i}") for i in range(len(parts)))).withColumn("side", F.lit(0))
    held = {f"__h{i}": F.when(F.col(f"v_{i}").isNotNull(), F.struct(F.col("t").alias("t"), F.col(f"v_{i}").alias("v"))) for i in range(len(parts))}
    rows = _carried(rows, keys, width, held)
    fresh = lambda c: F.lit(True) if tolerance is None else F.col("t") - c["t"] <= F.lit(tolerance)
    return rows.select(*keys, F.col("t").alias(on), *(F.when(fresh(F.col(f"__h{i}")), F.col(f"__h{i}")["v"]).alias(n) for i, n in enumerate(series)))
