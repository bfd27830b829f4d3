"""Fourier transforms of series of any length over partitions, and queries on kept terms without the series.

``transform`` takes the index as a table of n1 rows and n2 columns: columns are transformed, multiplied by their twiddle factors, and rows are
transformed, which is two shuffles of n rows. n1 is the largest divisor of n up to its root. Where that leaves
rows longer than ``most``, as for a large prime, the transform is a convolution with a chirp in a power of two.

A term table has keys, n, k, re, im: k from 0 to n div 2. ``values`` and ``range_sums`` need those rows only; each term
but the first and, for even n, the last stands for its mirror image as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import _mapped, present
from ..sources.staging import Staging

#: Values of a row that one task may hold, and those of a series that is a row as it is.
MOST, SMALL = 1 << 20, 4096
#: Frequencies among which the strongest are picked first, before those of a whole series.
_SPAN = 1 << 16


def _turn(turns: Column) -> tuple[Column, Column]:
    """Cosine and sine of a fraction of a turn."""
    return F.cos(2 * F.pi() * turns), F.sin(2 * F.pi() * turns)


def _times(re: Column, im: Column, other: tuple[Column, Column]) -> tuple[Column, Column]:
    return re * other[0] - im * other[1], re * other[1] + im * other[0]


def _lines(rows: DataFrame, by: list[str], at: str, out: str) -> DataFrame:
    """Transform of the values of each group of ``by`` in order of ``at``; the frequency is ``out``."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, "re", "im"))).alias("p")).select(*by, F.col("p.re").alias("re"), F.col("p.im").alias("im"))
    doubles = T.ArrayType(T.DoubleType())

    def step(r: dict) -> tuple:
        c = np.fft.fft(np.asarray(r["re"].values) + 1j * np.asarray(r["im"].values))
        return c.real, c.imag

    made = _mapped(packed, ["re", "im"], [T.StructField("a", doubles), T.StructField("b", doubles)], step)
    made = made.select(*by, F.posexplode(F.arrays_zip("a", "b")).alias(out, "c"))
    return made.select(*by, F.col(out).cast("long").alias(out), F.col("c.a").alias("re"), F.col("c.b").alias("im"))


def _two_steps(values: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """(keys, n, k, re, im) of values (keys, idx, re, im); ``sizes`` has n, n1 and n2 of each key."""
    rows = values.join(sizes, keys).withColumns({"j1": F.expr("idx div n2"), "j2": F.expr("idx % n2")})
    rows = _lines(rows, [*keys, "n", "n1", "j2"], "j1", "k1")
    # j2 * k1 stays under n
    re, im = _times(F.col("re"), F.col("im"), _turn(-(F.col("j2") * F.col("k1")) / F.col("n")))
    rows = rows.select(*keys, "n", "n1", "k1", "j2", re.alias("re"), im.alias("im"))
    rows = _lines(rows, [*keys, "n", "n1", "k1"], "j2", "k2")
    return rows.select(*keys, "n", (F.col("k1") + F.col("n1") * F.col("k2")).alias("k"), "re", "im")


def _chirp(i: Column, n: Column) -> tuple[Column, Column]:
    """exp(-i pi j^2 / n), the square taken in whole numbers modulo 2 n."""
    square = (i.cast("decimal(20,0)") * i.cast("decimal(18,0)")) % (2 * n).cast("decimal(20,0)")
    return _turn(-square.cast("double") / (2 * n))


def transform(values: DataFrame, keys: list[str], most: int = MOST, small: int = SMALL) -> DataFrame:
    """(keys, n, k, re, im) for k from 0 to n - 1 of complex values (keys, idx from 0, re, im), which are staged.

    Series of up to ``small`` values are one row each. A null in a key raises.
    """
    staging, n = Staging(values.sparkSession), F.col("n")
    values = staging.put(present(values.select(*keys, "idx", "re", "im"), keys))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n1", F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt("n"))), lambda d: n % d == 0)).cast("long")).withColumn("n2", F.expr("n div n1"))
    sizes = staging.put(sizes)
    short, wide, hard = sizes.where(n <= small), sizes.where((n > small) & (F.col("n2") <= most)), sizes.where((n > small) & (F.col("n2") > most))
    out = _lines(values.join(short.select(*keys, "n"), keys), [*keys, "n"], "idx", "k").select(*keys, "n", "k", "re", "im")
    if not wide.isEmpty():
        out = out.unionByName(_two_steps(values, keys, wide))
    return out if hard.isEmpty() else out.unionByName(_by_chirp(values, keys, hard.select(*keys, "n")))


def _by_chirp(values: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """As ``transform``, by a convolution with the chirp in a power of two of at least 2 n values."""
    n = F.col("n")
    hard = sizes.withColumn("m", F.pow(F.lit(2.0), F.ceil(F.log2((2 * n).cast("double")))).cast("long"))
    root = F.expr("shiftleft(1L, CAST((length(bin(m)) - 1) div 2 AS INT))")
    padded = hard.select(*keys, F.col("m").alias("n"), root.alias("n1")).withColumn("n2", F.expr("n div n1"))
    own = values.join(hard, keys)
    re, im = _times(F.col("re"), F.col("im"), _chirp(F.col("idx"), n))
    each = hard.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    zero = F.lit(0.0)
    filled = own.select(*keys, "idx", re.alias("re"), im.alias("im")).unionByName(each.where("idx >= n").select(*keys, "idx", zero.alias("re"), zero.alias("im")))
    back = F.least("idx", F.col("m") - F.col("idx"))
    cos, sin = _chirp(back, n)
    inside = back < n
    filter_ = each.select(*keys, "idx", F.when(inside, cos).otherwise(0.0).alias("re"), F.when(inside, -sin).otherwise(0.0).alias("im"))
    a, b = _two_steps(filled, keys, padded), _two_steps(filter_, keys, padded)
    both = a.join(b.select(*keys, "k", F.col("re").alias("fre"), F.col("im").alias("fim")), [*keys, "k"])
    re, im = _times(F.col("re"), F.col("im"), (F.col("fre"), F.col("fim")))
    # the inverse is the transform of the conjugate, conjugated, over m
    turned = _two_steps(both.select(*keys, F.col("k").alias("idx"), re.alias("re"), (-im).alias("im")), keys, padded)
    turned = turned.drop("n").join(hard, keys).where(F.col("k") < n)
    re, im = _times(F.col("re") / F.col("m"), -F.col("im") / F.col("m"), _chirp(F.col("k"), n))
    return turned.select(*keys, "n", "k", re.alias("re"), im.alias("im"))


def terms(points: DataFrame, keys: list[str], most: int = MOST, small: int = SMALL) -> DataFrame:
    """The term table of all frequencies of points (keys, idx, value)."""
    found = transform(points.select(*keys, "idx", F.col("value").alias("re"), F.lit(0.0).alias("im")), keys, most, small)
    return found.where(F.col("k") <= F.expr("n div 2"))


def strongest(table: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The mean's term and the ``count`` - 1 of most power; lower frequencies win ties (of power to four places)."""
    power = F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 4)
    order = [(F.col("k") > 0).cast("int"), power.desc(), F.col("k")]
    rows = table.withColumn("part", F.expr(f"k div {_SPAN}"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order))).where(F.col("rank") <= count)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= count)
    return rows.select(*table.columns)


def term_table(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """The term table of extracted transforms: their arrays as rows."""
    u, f = F.col("indices"), F.col("coefficients")
    rest = F.transform(F.slice(u, 3, F.size(u) - 2), lambda k, i: F.struct(k.alias("k"), F.get(f, 1 + 2 * i).alias("re"), F.get(f, 2 + 2 * i).alias("im")))
    first = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.get(f, 0).alias("re"), F.lit(0.0).alias("im")))
    return extracted.select(*keys, F.get(u, 1).alias("n"), F.inline(F.concat(first, rest)))


def _weight() -> Column:
    return F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0)


def values(table: DataFrame, keys: list[str], lo: int = 0, hi: int | None = None) -> DataFrame:
    """(keys, idx, value) for indices from ``lo`` until ``hi``: each is a sum over the key's terms.

    Terms are dealt by key and frequency, so that a key with many is not one task; sums are begun before the shuffle.
    """
    stop = F.col("n") if hi is None else F.least("n", F.lit(hi))
    rows = table.where(stop > lo).withColumn("idx", F.explode(F.sequence(F.lit(lo).cast("long"), stop - 1)))
    # whole turns are taken off in whole numbers
    cos, sin = _turn((F.col("k") * F.col("idx") % F.col("n")) / F.col("n"))
    part = _weight() * (F.col("re") * cos - F.col("im") * sin) / F.col("n")
    return rows.groupBy(*keys, "idx").agg(F.sum(part).alias("value"))


def range_sums(table: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """(keys, count, total) of the values at indices from ``lo`` until ``hi``, by the geometric series of each term."""
    stop = F.least("n", F.lit(hi))
    m, k, n = (stop - lo).cast("double"), F.col("k"), F.col("n")
    wide = F.sin(F.pi() * (k * (stop - lo) % (2 * n)) / n) / F.sin(F.pi() * k / n)
    cos, sin = _turn((k * (stop - 1 + lo) % (2 * n)) / (2 * n))
    total = F.when(k == 0, F.col("re") * m).otherwise(_weight() * wide * (F.col("re") * cos - F.col("im") * sin)) / n
    return table.where(stop > lo).groupBy(*keys).agg(F.max(stop - lo).alias("count"), F.sum(total).alias("total"))


def lost(table: DataFrame, keys: list[str], energy: DataFrame) -> DataFrame:
    """(keys, n, rmse) of the kept terms, from the series' sum of squares (keys, energy): what the terms have of it is not lost."""
    kept = table.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(_weight() * (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("kept"))
    return kept.join(energy, keys).select(*keys, "n", F.sqrt(F.greatest(F.col("energy") - F.col("kept"), F.lit(0.0)) / F.col("n")).alias("rmse"))
