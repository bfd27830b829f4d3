"""Exact payload sizes of the lossless methods as column expressions: nothing is encoded.

A size is a sum of bits a value, which follow from the value's bits, its predecessor's and, for the codes with
windows, from what the predecessor stored. Bits of a double come from its sign, exponent and mantissa, decimal digits from the least power of ten
that makes a whole number which gives the value back. Series must fit a task for ``Elf``, whose
window is carried along an array; the other methods are windows and sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels.lossless import _KEY_BITS, _LEAST_TRAILING, _RING, _RING_BITS, LEADING_STEPS
from ..methods import Method

M = Method


def _power2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def exponent(a: Column) -> Column:
    """The power of two at or below a positive double."""
    e = F.floor(F.log2(a))
    return F.when(_power2(e) > a, e - 1).when(_power2(e) * 2 <= a, e + 1).otherwise(e)


def _minus_zero(v: Column) -> Column:
    return (v == 0) & (v.cast("string") == "-0.0")


def double_bits(v: Column) -> Column:
    """The 64 bits of a double as a long."""
    a = F.abs(v)
    e = exponent(a)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / _power2(e) - 1) * float(1 << 52)).cast("long")
    tiny = (a * float(2.0**537) * float(2.0**537)).cast("long")
    size = F.when(a == 0, 0).when(F.isnan(a), 0x7FF8 << 48).when(a == float("inf"), 0x7FF0 << 48).when(a < 2.0**-1022, tiny).otherwise(normal)
    negative = (v < 0) | _minus_zero(v)
    return size.cast("long").bitwiseOR(F.when(negative, F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))


def bits_double(raw: Column) -> Column:
    """The finite normal double of 64 bits."""
    e = F.shiftright(raw.bitwiseAND(F.lit(0x7FF0 << 48).cast("long")), 52) - 1023
    size = _power2(e) * (1 + raw.bitwiseAND(F.lit((1 << 52) - 1).cast("long")) / float(1 << 52))
    return F.when(raw < 0, -size).otherwise(size)


def _zeros(x: Column) -> tuple[Column, Column]:
    """(leading, trailing) zeros of a long that is not zero."""
    text = F.bin(x)
    return F.lit(64) - F.length(text), F.length(text) - F.length(F.rtrim(text, F.lit("0")))


def _step(lead: Column) -> Column:
    """The number of leading zeros cut down to one of the steps."""
    out = F.lit(LEADING_STEPS[0])
    for s in LEADING_STEPS[1:]:
        out = F.when(lead >= s, s).otherwise(out)
    return out


def decimals(v: Column) -> Column:
    """(places, digits) of the shortest decimal form; places below 0 are trailing zeros. Null if it has more than 15 digits."""
    a = F.abs(v)
    whole = lambda p: F.rint(a * F.pow(F.lit(10.0), p))
    fits = F.filter(F.sequence(F.lit(0), F.lit(20)), lambda p: (whole(p) < float(1 << 53)) & (whole(p) / F.pow(F.lit(10.0), p) == a))
    p = F.get(fits, 0)
    text = whole(p).cast("long").cast("string")
    cut = F.when(p == 0, F.length(text) - F.length(F.rtrim(text, F.lit("0")))).otherwise(0)
    digits = F.length(text) - cut
    return F.when((a > 0) & (a < float("inf")) & p.isNotNull() & (digits <= 15), F.struct((p - cut).alias("places"), digits.alias("digits")))


def _tagged(u: Column) -> Column:
    """Bits of an unsigned number with its tag of two."""
    return F.when(u < 1 << 8, 10).when(u < 1 << 16, 18).when(u < 1 << 32, 34).otherwise(66)


def _bytes(head: int, bits: Column) -> Column:
    return F.lit(head + 1) + F.ceil(bits / 8)


def _sized(rows: DataFrame, keys: list[str], method: Method, full: Column) -> DataFrame:
    """A series of one value is stored raw, in nine bytes."""
    return rows.select(*keys, F.lit(int(method)).alias("method"), "n", F.when(F.col("n") == 1, 9).otherwise(full).cast("long").alias("bytes"))


def _run_size(points: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("idx"))
    rows = points.withColumn("new", (before.isNull() | (before != F.col("value")) | F.isnan("value")).cast("int"))
    return _sized(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("new").alias("runs")), keys, M.RunLengthEncoding, F.col("runs") * 16 + 1)


def _xor_size(raw: DataFrame, keys: list[str], ring: bool) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("idx")
    least, slot = _LEAST_TRAILING + (_RING_BITS if ring else 0), _RING_BITS if ring else 0
    rows = raw
    if ring:
        low = F.col("raw").bitwiseAND(F.lit((1 << _KEY_BITS) - 1).cast("long"))
        rows = rows.withColumn("low", low).withColumn("same", F.lag(F.struct("idx", "raw")).over(W.partitionBy(*keys, "low").orderBy("idx")))
    rows = rows.withColumn("before", F.lag("raw").over(order))
    x = F.col("before").bitwiseXOR(F.col("raw"))
    if ring:
        same = F.coalesce(F.col("same"), F.struct(F.lit(0).cast("long").alias("idx"), F.first("raw").over(order).alias("raw")))
        rows = rows.withColumn("same", same)
        far = F.col("same.raw").bitwiseXOR(F.col("raw"))
        used = (F.col("idx") - 1 - F.col("same.idx") < _RING) & ((far == 0) | (_zeros(far)[1] > least))
        rows = rows.withColumns({"x": F.when(used, far).otherwise(x), "cut": used})
    else:
        rows = rows.withColumn("x", x).withColumn("cut", (F.col("x") != 0) & (_zeros(F.col("x"))[1] > least))
    lead, trail = _zeros(F.col("x"))
    rows = rows.withColumn("body", 64 - _step(lead)).withColumn("trail", trail)
    # at index 0, which is stored in full, x is null or 0, so nothing is held after it
    held = F.lag(F.when((F.col("x") != 0) & ~F.col("cut"), F.col("body"))).over(order)
    rows = rows.withColumn("held", held)
    bits = F.when(F.col("x") == 0, 2 + slot).when(F.col("cut"), 11 + slot + F.col("body") - F.col("trail")).when(F.coalesce(F.col("held") == F.col("body"), F.lit(False)), 2 + F.col("body")).otherwise(5 + F.col("body"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("idx") > 0, bits)).alias("bits"))
    return _sized(sums, keys, M.Chimp128 if ring else M.Chimp64, _bytes(8, F.col("bits") + 11 + slot))


def _delta_size(points: DataFrame, keys: list[str]) -> DataFrame:
    """Scaled whole numbers as packed differences, others raw."""
    own = W.partitionBy(*keys)
    # of numbers too small for the search it matters only whether they have few digits
    text = F.substring_index(F.abs("value").cast("string"), "E", 1)
    tiny = (F.abs("value") < 1e-5) & (F.length(F.rtrim(F.replace(text, F.lit("."), F.lit("")), F.lit("0"))).between(1, 15))
    places = F.coalesce(decimals(F.col("value"))["places"], F.when(tiny, 20))
    rows = points.withColumn("places", F.greatest(places, F.lit(0)))
    rows = rows.withColumn("scale", F.pow(F.lit(10.0), F.least(F.coalesce(F.max("places").over(own), F.lit(0)), F.lit(15))))
    scaled = F.col("value") * F.col("scale")
    kept = (F.abs(scaled) < float(1 << 53)) & (F.rint(scaled) / F.col("scale") == F.col("value")) & ~_minus_zero(F.col("value"))
    rows = rows.withColumn("whole", F.when(kept, F.rint(scaled).cast("long")))
    # the whole number before, whatever lies between
    before = F.last("whole", ignorenulls=True).over(own.orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("step", F.col("whole") - before)
    rows = rows.withColumn("bits", _tagged(F.col("step") - F.min("step").over(own)))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("whole").alias("good"), F.sum(F.when(F.col("step").isNotNull(), F.col("bits"))).alias("bits"))
    mixed = F.when(F.col("good") < F.col("n"), 4 + F.ceil(F.col("n") / 8)).otherwise(0)
    stored = F.when(F.col("good") > 0, 16 + F.ceil(F.coalesce("bits", F.lit(0)) / 8)).otherwise(0)
    return _sized(sums, keys, M.BitPackedDeltaEncoding, 13 + mixed + stored + 8 * (F.col("n") - F.col("good")))


def _erased(points: DataFrame) -> DataFrame:
    """``points`` (with raw) with stored, the bits that are kept of a value, and marked, whether it is restored from its digits."""
    rows = points.withColumn("d", decimals(F.col("value")))
    places, digits = F.col("d.places"), F.col("d.digits")
    e = F.shiftright(F.col("raw").bitwiseAND(F.lit(0x7FF0 << 48).cast("long")), 52) - 1023
    rows = rows.withColumn("cut", 52 - F.ceil(places * F.log2(F.lit(10.0))) - e)
    may = (places >= 0) & (F.col("cut") > 4) & (F.col("cut") < 64)
    rows = rows.withColumn("short", F.when(may, F.expr("shiftleft(shiftrightunsigned(raw, int(cut)), int(cut))")))
    back = bits_double(F.col("short"))
    size = F.abs(back)
    ten = lambda k: F.pow(F.lit(10.0), k)
    first = F.floor(F.log10(size))
    first = F.when(ten(first) > size, first - 1).when(ten(first + 1) <= size, first + 1).otherwise(first)
    rows = rows.withColumns({"back": back, "first": first})
    power = (digits == 1) & (places > 0) & (F.abs("value") == ten(-places))
    scale = ten(digits - F.col("first") - 1)
    plain = F.when(F.col("back") < 0, F.floor(F.col("back") * scale)).otherwise(F.ceil(F.col("back") * scale)) / scale
    restored = F.when(power, F.signum("back") * ten(F.col("first") + 1)).when((digits - F.col("first") - 1).between(0, 300), plain)
    marked = F.coalesce((F.col("short") != F.col("raw")) & (restored == F.col("value")), F.lit(False))
    return rows.select(*points.columns, marked.alias("marked"), F.when(marked, F.col("short")).otherwise(F.col("raw")).alias("stored"))


def _elf_size(raw: DataFrame, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("idx")
    rows = _erased(raw).withColumn("stored", F.when(F.col("idx") == 0, F.col("raw")).otherwise(F.col("stored")))
    x = F.lag("stored").over(order).bitwiseXOR(F.col("stored"))
    rows = rows.withColumn("x", x)
    lead, trail = _zeros(F.col("x"))
    each = F.when((F.col("idx") > 0) & (F.col("x") != 0), F.struct("idx", _step(lead).alias("lead"), trail.alias("trail")))
    fixed = F.when(F.col("idx") == 0, 0).otherwise(F.when(F.col("marked"), 5).otherwise(1) + F.when(F.col("x") == 0, 2).otherwise(0))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(fixed).alias("fixed"), F.sort_array(F.collect_list(each)).alias("codes"))
    none = F.lit(-1)

    def carry(s: Column, c: Column) -> Column:
        again = (s["lead"] == c["lead"]) & (c["trail"] >= s["trail"])
        wide = 64 - c["lead"] - c["trail"]
        fresh = F.when(wide <= 16, 8 + wide).otherwise(10 + wide)
        return F.struct(c["lead"].alias("lead"), F.when(again, s["trail"]).otherwise(c["trail"]).alias("trail"), (s["bits"] + F.when(again, 66 - s["lead"] - s["trail"]).otherwise(fresh)).cast("long").alias("bits"))

    start = F.struct(none.alias("lead"), none.alias("trail"), F.lit(0).cast("long").alias("bits"))
    bits = F.aggregate("codes", start, carry, lambda s: s["bits"])
    return _sized(sums.withColumn("bits", bits + F.col("fixed")), keys, M.Elf, _bytes(8, F.col("bits") + 12))


def lossless_sizes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, n, bytes) of each lossless method on each series of points (keys, idx, value).

    Sizes are dealt by key and method, so each method is a stage of its own: Spark would put those of the same keys in one task, with the sorts of all methods in its memory.
    """
    raw = points.withColumn("raw", double_bits(F.col("value")))
    plain = _sized(points.groupBy(*keys).agg(F.count("*").alias("n")), keys, M.Uncompressed, F.col("n") * 8 + 1)
    each = [plain, _run_size(points, keys), _xor_size(raw, keys, False), _xor_size(raw, keys, True), _delta_size(points, keys), _elf_size(raw, keys)]
    return reduce(DataFrame.unionByName, [x.repartition(*keys, "method") for x in each])
