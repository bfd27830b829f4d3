"""Two compressed series put together by their segments, without their points.

Both tables are cut at multiples of ``block`` indices, so that a pair of long segments is dealt over many tasks and each
task holds a block of a key. Within a block a sweep over the starts of both sides gives the pieces on which
both are one line; sums, differences and products of a piece follow from its four end values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def _at(i: Column) -> Column:
    """The value of a segment at index ``i``."""
    span = F.col("end_idx") - F.col("start_idx") - 1
    return F.when(span > 0, F.col("c0") + (F.col("c1") - F.col("c0")) / span * (i - F.col("start_idx"))).otherwise(F.col("c0"))


def disjoint(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that share no point: a chained line gives its first point to the one before."""
    first = F.col("seg") == 0
    shared = ~first & (F.col("start_idx") < F.lag("end_idx").over(W.partitionBy(*keys).orderBy("seg")))
    rows = segments.withColumn("shared", F.coalesce(shared, F.lit(False))).where("NOT shared OR end_idx - start_idx > 1")
    return rows.select(*keys, "seg", (F.col("start_idx") + F.col("shared").cast("int")).alias("start_idx"), "end_idx", F.when(F.col("shared"), _at(F.col("start_idx") + 1)).otherwise(F.col("c0")).alias("c0"), "c1")


def _blocks(segments: DataFrame, keys: list[str], block: int, side: str) -> DataFrame:
    """Segments cut at the borders of blocks, as rows (keys, block, start_idx, side)."""
    rows = segments.select(*keys, "start_idx", "end_idx", "c0", "c1", F.explode(F.sequence(F.expr(f"start_idx div {block}"), F.expr(f"(end_idx - 1) div {block}"))).alias("block"))
    low, high = F.greatest("start_idx", F.col("block") * block), F.least("end_idx", (F.col("block") + 1) * block)
    own = F.struct(low.alias("low"), high.alias("high"), _at(low).alias("first"), _at(high - 1).alias("last"))
    return rows.select(*keys, "block", low.alias("start_idx"), own.alias(side))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, start_idx, end_idx, l0, l1, r0, r1): the pieces that lie in a segment of both tables, with both sides' values at their ends.

    Segments of a table must not share points (see ``disjoint``) but may leave gaps; pieces also end at borders of blocks.
    """
    empty = lambda df, c: df.withColumn(c, F.lit(None).cast(df.schema["l" if c == "r" else "r"].dataType))
    rows = empty(_blocks(left, keys, block, "l"), "r").unionByName(empty(_blocks(right, keys, block, "r"), "l"))
    rows = rows.groupBy(*keys, "block", "start_idx").agg(F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))
    order = W.partitionBy(*keys, "block").orderBy("start_idx")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(*keys, "start_idx", F.lead("start_idx").over(order).alias("next"), F.last("l", ignorenulls=True).over(so_far).alias("l"), F.last("r", ignorenulls=True).over(so_far).alias("r"))
    rows = rows.withColumn("end_idx", F.least("next", "l.high", "r.high")).where("l IS NOT NULL AND r IS NOT NULL AND end_idx > start_idx AND start_idx < l.high AND start_idx < r.high")

    def value(side: str, i: Column) -> Column:
        s = F.col(side)
        span = s["high"] - s["low"] - 1
        return F.when(span > 0, s["first"] + (s["last"] - s["first"]) / span * (i - s["low"])).otherwise(s["first"])

    last = F.col("end_idx") - 1
    return rows.select(*keys, "start_idx", "end_idx", value("l", F.col("start_idx")).alias("l0"), value("l", last).alias("l1"), value("r", F.col("start_idx")).alias("r0"), value("r", last).alias("r1"))


def combine(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_idx, end_idx) with q0 + q1 t + q2 t² of the product, and the lines of sum and difference, t from the start of a piece."""
    span = F.greatest(F.col("end_idx") - F.col("start_idx") - 1, F.lit(1))
    dl, dr = (F.col("l1") - F.col("l0")) / span, (F.col("r1") - F.col("r0")) / span
    lines = {"s0": F.col("l0") + F.col("r0"), "s1": dl + dr, "d0": F.col("l0") - F.col("r0"), "d1": dl - dr}
    product = {"q0": F.col("l0") * F.col("r0"), "q1": F.col("l0") * dr + F.col("r0") * dl, "q2": dl * dr}
    return pieces.select(*keys, "start_idx", "end_idx", *(c.alias(n) for n, c in (lines | product).items()))


def combined_points(combined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, total, difference, product) of each index of the pieces."""
    rows = combined.withColumn("idx", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)))
    t = F.col("idx") - F.col("start_idx")
    return rows.select(*keys, "idx", (F.col("s0") + F.col("s1") * t).alias("total"), (F.col("d0") + F.col("d1") * t).alias("difference"), (F.col("q0") + F.col("q1") * t + F.col("q2") * t * t).alias("product"))


def combined_sums(combined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total, difference, product) summed over all indices of the pieces, in closed form."""
    n = (F.col("end_idx") - F.col("start_idx")).cast("double")
    t1, t2 = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    return combined.groupBy(*keys).agg(
        F.sum(F.col("end_idx") - F.col("start_idx")).alias("n"),
        F.sum(F.col("s0") * n + F.col("s1") * t1).alias("total"),
        F.sum(F.col("d0") * n + F.col("d1") * t1).alias("difference"),
        F.sum(F.col("q0") * n + F.col("q1") * t1 + F.col("q2") * t2).alias("product"),
    )
