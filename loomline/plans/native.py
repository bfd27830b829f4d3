"""Closed-form methods and operations on segment tables as DataFrame plans: no Python on the executors.

A segment table has keys, seg, start_idx, end_idx (past the last point), c0 and c1 (values at the first
and last point).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels.values import FRACTION_BITS, bucket
from ..methods import Method, SeriesError, bound32, method_of
from ..operators import series

M = Method


def runs(points: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal values as constant segments; a NaN equals nothing."""
    order = W.partitionBy(*keys).orderBy("idx")
    before = F.lag("value").over(order)
    new = before.isNull() | (before != F.col("value")) | F.isnan("value")
    rows = points.withColumn("new", new.cast("int")).withColumn("seg", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    out = rows.groupBy(*keys, "seg").agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.min("value").alias("c0"))
    return out.select(*keys, "seg", "start_idx", "end_idx", "c0", F.col("c0").alias("c1"))


def decode(segments: DataFrame, keys: list[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Points of a segment table; with a range of indices only the segments that meet it are expanded."""
    first, stop = F.col("start_idx"), F.col("end_idx")
    if lo is not None:
        segments, first = segments.where(stop > lo), F.greatest(first, F.lit(lo))
    if hi is not None:
        segments, stop = segments.where(F.col("start_idx") < hi), F.least(stop, F.lit(hi))
    rows = segments.select(*keys, "start_idx", "end_idx", "c0", "c1", F.explode(F.sequence(first, stop - 1)).alias("idx"))
    span = F.col("end_idx") - F.col("start_idx") - 1
    value = F.when(F.col("idx") == F.col("start_idx"), F.col("c0")).when(F.col("idx") == F.col("end_idx") - 1, F.col("c1"))
    return rows.select(*keys, "idx", value.otherwise(F.col("c0") + (F.col("c1") - F.col("c0")) / span * (F.col("idx") - F.col("start_idx"))).alias("value"))


def aggregate(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, total, least, most of the decoded points, from the segments alone."""
    n = F.col("end_idx") - F.col("start_idx")
    return segments.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * (F.col("c0") + F.col("c1")) / 2).alias("total"), F.min(F.least("c0", "c1")).alias("least"), F.max(F.greatest("c0", "c1")).alias("most"))


_SEGMENTED = frozenset({M.PoorMansCompressionMidrange, M.PoorMansCompressionMean, M.PiecewiseConstantHistogram, M.PiecewiseLinearHistogram, M.SwingFilter, M.SwingFilterDisconnected, M.SlideFilter, M.SlidingWindow, M.BottomUp, M.VisvalingamWhyatt, M.LargestTriangleThreeBuckets})


def segment_table(extracted: DataFrame, keys: list[str], method: Method | int | str) -> DataFrame:
    """Segment table of extracted constants, chained lines or disjoint lines; other models are refused."""
    if method_of(method) not in _SEGMENTED:
        raise SeriesError("UnsupportedMethod", f"{method_of(method).name} has no table of lines between end values")
    method, ends, c = method_of(method), F.col("indices"), F.col("coefficients")
    incl = 1 if method in (M.SlidingWindow, M.BottomUp, M.VisvalingamWhyatt, M.LargestTriangleThreeBuckets) else 0
    if method in (M.PoorMansCompressionMidrange, M.PoorMansCompressionMean, M.PiecewiseConstantHistogram):
        seg = F.transform(ends, lambda e, i: F.struct(i.alias("seg"), e.alias("end_idx"), F.get(c, i).alias("c0"), F.get(c, i).alias("c1")))
        start = F.coalesce(F.get(ends, F.col("seg") - 1), F.lit(0))
    elif method in (M.SwingFilter, M.VisvalingamWhyatt, M.LargestTriangleThreeBuckets):
        # the start of a chained line is the end of the one before: its first point is that one's last
        seg = F.transform(ends, lambda e, i: F.struct(i.alias("seg"), (e + incl).alias("end_idx"), F.get(c, i).alias("c0"), F.get(c, i + 1).alias("c1")))
        start = F.coalesce(F.get(ends, F.col("seg") - 1) + incl - 1, F.lit(0))
    else:
        seg = F.transform(ends, lambda e, i: F.struct(i.alias("seg"), (e + incl).alias("end_idx"), F.get(c, 2 * i).alias("c0"), F.get(c, 2 * i + 1).alias("c1")))
        start = F.coalesce(F.get(ends, F.col("seg") - 1) + incl, F.lit(0))
    rows = extracted.select(*keys, "indices", F.inline(seg))
    return rows.select(*keys, F.col("seg").cast("long").alias("seg"), start.cast("long").alias("start_idx"), "end_idx", "c0", "c1")


def segments(compressed: DataFrame, keys: list[str], method: Method | int | str) -> DataFrame:
    """The segment table of compressed series; a series of one value, which is stored raw, is one constant segment."""
    rows = compressed.select(*keys, "payload")
    many = segment_table(series.extract(rows.where(F.octet_length("payload") > 9)), keys, method)
    one = series.decompress(rows.where(F.octet_length("payload") == 9)).withColumn("c0", F.get("values", 0))
    return many.unionByName(one.select(*keys, F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("start_idx"), F.lit(1).cast("long").alias("end_idx"), "c0", F.col("c0").alias("c1")))


def quantized(points: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """keys, idx, q, decoded, bits: codes of the packed quantisation and their width."""
    step = bucket(bound)
    least = F.min("value").over(W.partitionBy(*keys))
    q = F.round((F.col("value") - least) / F.lit(step)).cast("long")
    bits = F.when(F.col("q") < 1 << 8, 10).when(F.col("q") < 1 << 16, 18).when(F.col("q") < 1 << 32, 34).otherwise(66)
    rows = points.withColumns({"least": least, "q": q})
    return rows.select(*keys, "idx", "q", (F.col("least") + F.col("q") * F.lit(step)).alias("decoded"), bits.cast("long").alias("bits"))


def fixed_point(value: Column, places: int) -> Column:
    """The value that the bounded fixed-point method gives back."""
    scale = F.lit(float(1 << FRACTION_BITS[places - 1]))
    size = F.abs(value)
    kept = F.floor(size) + F.floor((size - F.floor(size)) * scale) / scale
    return F.when(value < 0, -kept).otherwise(kept)


def shortened(value: Column, bound: float) -> Column:
    """The value that shortening its mantissa within the bound gives back (the bound itself, then one more bit)."""
    eb = F.lit(bound32(bound))
    size = F.abs(value)
    power = F.floor(F.log2(size))
    unit = F.pow(F.lit(2.0), power)
    power = F.when(unit > size, power - 1).when(unit * 2 <= size, power + 1).otherwise(power)
    keep = F.greatest(F.floor(-F.log2(eb / F.pow(F.lit(2.0), power))), F.lit(0))

    def cut(k: Column) -> Column:
        grid = F.pow(F.lit(2.0), power - k)
        return F.signum(value) * F.floor(size / grid) * grid

    return F.when(size == 0, value).when(F.abs(cut(keep) - value) <= eb, cut(keep)).otherwise(cut(keep + 1))


def scaled_deltas(points: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """keys, idx, delta, bits: packed differences of decimal-scaled values above the least one."""
    order, all_ = W.partitionBy(*keys).orderBy("idx"), W.partitionBy(*keys)
    x = F.round(F.col("value") * scale).cast("long")
    rows = points.withColumn("x", x).withColumn("d", F.col("x") - F.lag("x").over(order)).withColumn("delta", F.col("d") - F.min("d").over(all_))
    bits = F.when(F.col("delta") < 1 << 8, 10).when(F.col("delta") < 1 << 16, 18).when(F.col("delta") < 1 << 32, 34).otherwise(66)
    return rows.where("d IS NOT NULL").select(*keys, "idx", "delta", bits.cast("long").alias("bits"))


def first_areas(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, area of the triangle of each inner point with its neighbours."""
    order = W.partitionBy(*keys).orderBy("idx")
    rows = points.withColumns({"a": F.lag("value").over(order), "b": F.lead("value").over(order)}).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select(*keys, "idx", (F.abs(F.col("a") - 2 * F.col("value") + F.col("b")) / 2).alias("area"))


def bucket_means(points: DataFrame, keys: list[str], target: int) -> DataFrame:
    """keys, bucket, n, mean of the inner points of the downsampling buckets."""
    n = F.count("*").over(W.partitionBy(*keys))
    rows = points.withColumn("n", n).where("idx > 0 AND idx < n - 1")
    m, t = F.col("n") - 2, target - 2
    # bucket b covers inner positions floor(b m / t) up to floor((b + 1) m / t)
    b = F.floor(((F.col("idx") - 1) * t + t - 1) / m)
    b = F.when(F.floor(b * m / t) > F.col("idx") - 1, b - 1).otherwise(b)
    return rows.groupBy(*keys, b.cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
