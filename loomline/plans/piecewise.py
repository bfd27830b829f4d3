"""Piece tables: the models that are no lines between end values as rows, with decoding and sums as plans.

A piece has keys, seg, start_idx, end_idx (past the last point), family, slope, intercept, first_x and shift. Its value at
an index is that of its family at x = idx - start_idx + first_x, less shift: 1 slope x, 2 slope x², 5 slope √x, each
plus intercept; 3 and 4 the exponential of intercept plus slope x or slope ln x.

Grouped layouts store starts as differences within groups; a step over each extracted model adds them up and
sorts the pieces by start. All else is columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.codec import _Streams
from ..kernels.pieces import walk_mix, walk_sim
from ..methods import Method, SeriesError, method_of
from ..operators.series import _mapped

M = Method
_FIELDS = [T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("families", T.ArrayType(T.IntegerType())), T.StructField("slopes", T.ArrayType(T.DoubleType())), T.StructField("intercepts", T.ArrayType(T.DoubleType())), T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("shift", T.DoubleType()), T.StructField("n", T.LongType())]
#: First terms of a sum of powers that are added one by one, before the series for the rest.
_HEAD = 24


def _grouped(method: Method, u: np.ndarray, f: np.ndarray) -> tuple:
    s = _Streams(u.tolist(), f.tolist())
    found, n = (walk_sim if method is M.SimPiece else walk_mix)(s.take_u, s.take_f, lambda: s.j < len(f))
    found.sort()
    starts, slopes, intercepts = zip(*found)
    return starts, [1] * len(starts), slopes, intercepts, [0] * len(starts), 0.0, n


def _fitted(method: Method, u: np.ndarray, f: np.ndarray) -> tuple:
    if method is M.NonLinearApproximation:
        k = int(u[0])
        ends = u[1 + k :]
        return np.r_[0, ends[:-1]], u[1 : 1 + k].astype(np.int32), f[1::2], f[2::2], np.ones(k, np.int64), float(f[0]), int(ends[-1])
    # lines over the whole series' indices; a segment of two points holds its values
    ends = u + 1
    starts, a, b = np.r_[0, ends[:-1]], f[::2], f[1::2]
    raw = ends - starts == 2
    return starts, np.ones(len(u), np.int32), np.where(raw, b - a, a), np.where(raw, a, b), np.where(raw, 0, starts), 0.0, int(ends[-1])


def piece_table(extracted: DataFrame, keys: list[str], method: Method | int | str) -> DataFrame:
    """Pieces of extracted grouped pieces, fitted families or lines over indices."""
    method = method_of(method)
    if method not in (M.SimPiece, M.MixPiece, M.NonLinearApproximation, M.ABCLinearApproximation):
        raise SeriesError("UnsupportedMethod", f"{method.name} has no pieces; see segment_table")
    read = _grouped if method in (M.SimPiece, M.MixPiece) else _fitted
    rows = _mapped(extracted.select(*keys, "indices", "coefficients"), ["indices", "coefficients"], _FIELDS, lambda r: read(method, np.asarray(r["indices"].values), np.asarray(r["coefficients"].values)))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(1))), F.array("n"))
    cols = F.arrays_zip(F.col("starts"), ends.alias("ends"), F.col("families"), F.col("slopes"), F.col("intercepts"), F.col("firsts"))
    rows = rows.select(*keys, "shift", F.posexplode(cols).alias("seg", "p"))
    return rows.select(*keys, F.col("seg").cast("long").alias("seg"), F.col("p.starts").alias("start_idx"), F.col("p.ends").alias("end_idx"), F.col("p.families").alias("family"), F.col("p.slopes").alias("slope"), F.col("p.intercepts").alias("intercept"), F.col("p.firsts").alias("first_x"), "shift")


def value_at(idx: Column) -> Column:
    """The value of a piece at an index within it."""
    x = (idx - F.col("start_idx") + F.col("first_x")).cast("double")
    family, a, b = F.col("family"), F.col("slope"), F.col("intercept")
    flat = F.when(family == 1, a * x).when(family == 2, a * x * x).otherwise(a * F.sqrt(x)) + b
    return F.when(family.isin(3, 4), F.exp(b + a * F.when(family == 3, x).otherwise(F.log(x)))).otherwise(flat) - F.col("shift")


def decode(pieces: DataFrame, keys: list[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Points of a piece table; with a range of indices only pieces that meet it are expanded."""
    first, stop = F.col("start_idx"), F.col("end_idx")
    if lo is not None:
        pieces, first = pieces.where(stop > lo), F.greatest(first, F.lit(lo))
    if hi is not None:
        pieces, stop = pieces.where(F.col("start_idx") < hi), F.least(stop, F.lit(hi))
    rows = pieces.withColumn("idx", F.explode(F.sequence(first, stop - 1)))
    return rows.select(*keys, "idx", value_at(F.col("idx")).alias("value"))


def _power_sum(p: Column, q: Column, s: Column) -> Column:
    """Sum of x^s for x from p >= 1 to q: the first terms one by one, the rest by the Euler-Maclaurin series."""
    head = F.least(q, p + (_HEAD - 1))
    some = F.aggregate(F.sequence(p, head), F.lit(0.0), lambda t, x: t + F.pow(x.cast("double"), s))
    a, b = (head + 1).cast("double"), q.cast("double")
    whole = F.when(F.abs(s + 1) < 1e-9, F.log(b) - F.log(a)).otherwise((F.pow(b, s + 1) - F.pow(a, s + 1)) / (s + 1))
    slope = lambda x, k: F.pow(x, s - k)
    d1, d3, d5 = s, s * (s - 1) * (s - 2), s * (s - 1) * (s - 2) * (s - 3) * (s - 4)
    ends = (F.pow(a, s) + F.pow(b, s)) / 2 + d1 * (slope(b, 1) - slope(a, 1)) / 12 - d3 * (slope(b, 3) - slope(a, 3)) / 720 + d5 * (slope(b, 5) - slope(a, 5)) / 30240
    return some + F.when(q > head, whole + ends).otherwise(0.0)


def piece_sum() -> Column:
    """The sum of a piece's values, from its row alone."""
    n = (F.col("end_idx") - F.col("start_idx")).cast("double")
    p, q = F.col("first_x"), F.col("first_x") + F.col("end_idx") - F.col("start_idx") - 1
    low, high = p.cast("double"), q.cast("double")
    a, b, family = F.col("slope"), F.col("intercept"), F.col("family")
    squares = lambda x: x * (x + 1) * (2 * x + 1) / 6
    line = a * (low + high) * n / 2 + b * n
    square = a * (squares(high) - squares(low - 1)) + b * n
    geometric = F.exp(b + a * low) * F.when(F.abs(a) < 1e-14, n).otherwise(F.expm1(a * n) / F.expm1(a))
    total = F.when(family == 1, line).when(family == 2, square).when(family == 3, geometric)
    total = total.when(family == 4, F.exp(b) * _power_sum(p, q, a)).otherwise(a * _power_sum(p, q, F.lit(0.5)) + b * n)
    return total - F.col("shift") * n


def aggregate(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, total, least, most of the decoded points: all families rise or fall throughout, so extremes are at ends."""
    first, last = value_at(F.col("start_idx")), value_at(F.col("end_idx") - 1)
    return pieces.groupBy(*keys).agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("n"), F.sum(piece_sum()).alias("total"), F.min(F.least(first, last)).alias("least"), F.max(F.greatest(first, last)).alias("most"))
