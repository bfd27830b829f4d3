"""Greedy constant segments of series of any length, in parallel over blocks of one series.

A series may be one key with all rows: no window, array or task holds it. Its points are numbered by a
range sort, packed into blocks and then

1. each block is looked at by itself: for each point, where the segment that starts there would end, if
   within the block, and which open end a chain of segments from it leads to. Open ends of the same range
   are one class;
2. each class finds the point where it ends: the first later block that breaks its range, by a walk over a
   tree of blocks' ranges, then the point in it. Ends ascend with starts, so a block's classes meet few blocks;
3. classes and the points where they end are a graph of few nodes a block. Which are reached from point 0 is marked
   by doubling: pointers of 1, 2, 4, … steps;
4. each block that is reached at a point writes its segments from there.

Steps 1, 3 and 4 are linear in the points, whatever their values; a plan has a shuffle of the points (to pack
blocks), one of blocks, and shuffles of a few rows a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.segments import no_nan
from ..methods import bound32
from ..operators.series import _mapped, present
from ..sources.staging import Staging

#: Points of a block.
BLOCK = 4096
_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())


def numbered(df: DataFrame, keys: list[str], order: list[str], value: str = "value", staging: Staging | None = None) -> DataFrame:
    """keys, idx, value as ``to_points`` gives them, without a window over a series.

    Rows are sorted by range; a part's rows of a key are numbered after those of the parts before.
    Nulls in keys or value raise; rows must differ in keys and order.
    """
    v = F.col(value).cast("double")
    v = F.when(v.isNull(), F.raise_error(F.lit("a series holds a null value")).cast("double")).otherwise(v)
    by = [*keys, *(c for c in order if c not in keys)]
    rows = present(df, keys).select(*by, v.alias("__v")).repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, F.col("__v").alias("value"), F.monotonically_increasing_id().alias("at"))
    rows = (staging or Staging(df.sparkSession)).put(rows)
    part = F.shiftright("at", 33).alias("part")
    cells = rows.groupBy(*keys, part).agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*keys, "part", (before - F.col("low")).alias("shift"))
    return rows.withColumn("part", part).join(cells, [*keys, "part"]).select(*keys, (F.col("at") + F.col("shift")).alias("idx"), "value")


def next_starts(v: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, least, most) of the longest segment from each point whose values span no more than ``limit``; an end at the last point is len(v).

    Ranges of 1, 2, 4, … points are made by halves, then each point takes the largest that still fit, longest first.
    """
    n, lows, highs = len(v), [v], [v]
    while 2 << (len(lows) - 1) <= n:
        half = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
        highs.append(np.maximum(highs[-1][:-half], highs[-1][half:]))
    end, lo, hi = np.arange(n) + 1, v.copy(), v.copy()
    for k in reversed(range(len(lows))):
        at = np.minimum(end, len(lows[k]) - 1)
        a, b = np.minimum(lo, lows[k][at]), np.maximum(hi, highs[k][at])
        fits = (end + (1 << k) <= n) & (b - a <= limit)
        end, lo, hi = np.where(fits, end + (1 << k), end), np.where(fits, a, lo), np.where(fits, b, hi)
    return end, lo, hi


def _shape(v: np.ndarray, limit: float) -> tuple:
    """(n, lo, hi, class of the open end that each point leads to, lo and hi of the classes, points where the range from the block's start grows, lo and hi there)."""
    no_nan(v)
    n = len(v)
    end, lo, hi = next_starts(v, limit)
    to = np.where(end < n, np.minimum(end, n - 1), np.arange(n))
    while (on := to[to] != to).any():
        to = np.where(on, to[to], to)
    opened = np.flatnonzero(end == n)
    new = np.r_[True, (np.diff(lo[opened]) != 0) | (np.diff(hi[opened]) != 0)]
    of = np.zeros(n, dtype=np.int32)
    of[opened] = np.cumsum(new) - 1
    low, high = np.minimum.accumulate(v), np.maximum.accumulate(v)
    grown = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0)])
    return n, float(low[-1]), float(high[-1]), of[to], lo[opened][new], hi[opened][new], grown.astype(np.int32), low[grown], high[grown]


def _first_break(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, limit: float) -> tuple:
    """For each open range (lo, hi): the first point of a block that breaks it, and the range before that."""
    left, right = np.zeros(len(lo), dtype=np.int64), np.full(len(lo), len(at) - 1)
    while (left < right).any():
        mid = (left + right) // 2
        breaks = np.maximum(hi, high[mid]) - np.minimum(lo, low[mid]) > limit
        left, right = np.where(breaks, left, np.minimum(mid + 1, right)), np.where(breaks, mid, right)
    before = np.maximum(left - 1, 0)
    some = left > 0
    return at[left], np.where(some, np.minimum(lo, low[before]), lo), np.where(some, np.maximum(hi, high[before]), hi)


def _array(x) -> np.ndarray:
    return np.asarray(x.values)


def midrange_segments(points: DataFrame, keys: list[str], bound: float, block: int = BLOCK, staging: Staging | None = None) -> DataFrame:
    """(keys, start_idx, end_idx, lo, hi) of the midrange segments of points (keys, idx from 0, value).

    Equal to the segments of the midrange method; its value is the middle of lo and hi. An empty table has none.
    """
    limit = float(np.float32(2) * np.float32(bound32(bound)))
    own = staging or Staging(points.sparkSession)
    packed = present(points, keys).groupBy(*keys, F.expr(f"idx div {block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("p"))
    blocks = own.put(packed.select(*keys, "block", F.col("p.value").alias("values")))
    shapes = own.put(_shapes(blocks, keys, limit, block))
    edges = own.put(_ends(shapes, keys, limit, own))
    nodes = own.put(_entries(shapes, edges, keys))
    reached = own.put(_reached(nodes, keys, own))
    rows = reached.join(blocks, [*keys, "block"])
    fields = [T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("lows", _DOUBLES), T.StructField("highs", _DOUBLES)]

    def cut(r: dict) -> tuple:
        v, at, base = np.asarray(r["values"].values), r["entry"].as_py(), r["block"].as_py() * block
        end, lo, hi = next_starts(v, limit)
        starts, follow = [at], end.tolist()
        while follow[at] < len(v):
            at = follow[at]
            starts.append(at)
        ends = end[starts] + base
        ends[-1] = r["next_idx"].as_py()
        return np.array(starts) + base, ends, np.r_[lo[starts[:-1]], r["lo"].as_py()], np.r_[hi[starts[:-1]], r["hi"].as_py()]

    rows = _mapped(rows.select(*keys, "block", "values", "entry", "next_idx", "lo", "hi"), ["block", "values", "entry", "next_idx", "lo", "hi"], fields, cut)
    out = own.put(rows.select(*keys, F.inline(F.arrays_zip("starts", "ends", "lows", "highs")).alias("start_idx", "end_idx", "lo", "hi")))
    own.clear(out)
    return out


def _shapes(blocks: DataFrame, keys: list[str], limit: float, block: int) -> DataFrame:
    """Blocks as step 1 sees them, and one past the end of each series that breaks every range."""
    names = ["n", "lo", "hi", "chain", "open_lo", "open_hi", "grow_at", "grow_lo", "grow_hi"]
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType(), _INTS, _DOUBLES, _DOUBLES, _INTS, _DOUBLES, _DOUBLES]
    found = _mapped(blocks, ["values"], [T.StructField(*x) for x in zip(names, kinds)], lambda r: _shape(_array(r["values"]), limit))
    found = found.withColumn("start", F.col("block") * block)
    inf, none = F.lit(float("inf")), F.array().cast(_DOUBLES)
    last = blocks.groupBy(*keys).agg((F.max("block") + 1).alias("block"), F.max(F.col("block") * block + F.size("values")).alias("start"))
    stop = last.select(*keys, "block", F.lit(0).cast("long").alias("n"), (-inf).alias("lo"), inf.alias("hi"), F.array().cast(_INTS).alias("chain"), none.alias("open_lo"), none.alias("open_hi"), F.array(F.lit(0)).alias("grow_at"), F.array(-inf).alias("grow_lo"), F.array(inf).alias("grow_hi"), "start")
    return found.unionByName(stop)


def _ends(shapes: DataFrame, keys: list[str], limit: float, own: Staging) -> DataFrame:
    """(keys, block, class, lo, hi, next_block, next_entry, next_idx) of each class: where it ends, and its range until there."""
    opened = shapes.select(*keys, "block", F.posexplode(F.arrays_zip("open_lo", "open_hi")).alias("class", "o")).select(*keys, "block", "class", F.col("o.open_lo").alias("lo"), F.col("o.open_hi").alias("hi"), (F.col("block") + 1).alias("pos"))
    ranges = shapes.select(*keys, F.col("block").alias("pos"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    fits = F.coalesce(F.greatest("hi", "b") - F.least("lo", "a") <= limit, F.lit(False))
    first = own.put(opened.join(ranges, [*keys, "pos"]).withColumn("fits", fits).drop("a", "b"))
    found = first.where("NOT fits").drop("fits")
    if not first.where("fits").isEmpty():
        found = found.unionByName(own.put(_walk(first.where("fits").drop("fits"), ranges, keys, fits, own)))
    # the classes of a block that end in the same block meet it as one row
    asked = found.groupBy(*keys, "block", "pos").agg(F.sort_array(F.collect_list(F.struct("class", "lo", "hi"))).alias("q"))
    asked = asked.select(*keys, "block", "pos", F.col("q.class").alias("class"), F.col("q.lo").alias("lo"), F.col("q.hi").alias("hi"))
    met = asked.join(shapes.select(*keys, F.col("block").alias("pos"), "start", "grow_at", "grow_lo", "grow_hi"), [*keys, "pos"])
    drop = ["lo", "hi", "grow_at", "grow_lo", "grow_hi"]
    fields = [T.StructField("entries", _INTS), T.StructField("los", _DOUBLES), T.StructField("his", _DOUBLES)]
    rows = _mapped(met, drop, fields, lambda r: _first_break(*(_array(r[c]) for c in drop), limit))
    rows = rows.select(*keys, "block", "pos", "start", F.inline(F.arrays_zip("class", "entries", "los", "his")).alias("class", "next_entry", "lo", "hi"))
    return rows.select(*keys, "block", "class", "lo", "hi", F.col("pos").alias("next_block"), "next_entry", (F.col("start") + F.col("next_entry")).alias("next_idx"))


def _walk(open_: DataFrame, ranges: DataFrame, keys: list[str], fits, own: Staging) -> DataFrame:
    """``open_`` with pos at the first block from there on that breaks its range: up a tree of the blocks' ranges, then down."""
    height = int(ranges.agg(F.max("pos")).first()[0]).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level")
    tree = ranges.select(*keys, "pos", "a", "b", level).groupBy(*keys, "level", F.expr("shiftright(pos, level)").alias("node")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    tree, rows = own.put(tree), open_.withColumn("broke", F.lit(None).cast("int"))
    for up in (True, False):
        for k in range(height) if up else reversed(range(height)):
            part = tree.where(F.col("level") == k).select(*keys, F.col("node").alias("node"), "a", "b")
            asks = F.col("broke").isNull() & (F.shiftright("pos", k).bitwiseAND(F.lit(1)) == 1) if up else F.coalesce(F.col("broke") > k, F.lit(True))
            seen = rows.withColumn("node", F.shiftright("pos", k)).join(part, [*keys, "node"], "left").withColumn("go", asks & fits)
            broke = F.when(asks & ~F.col("go"), k).otherwise(F.col("broke")) if up else F.col("broke")
            rows = seen.select(*keys, "block", "class", F.when(F.col("go"), F.least("lo", "a")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("go"), F.greatest("hi", "b")).otherwise(F.col("hi")).alias("hi"), (F.col("pos") + F.when(F.col("go"), 1 << k).otherwise(0)).alias("pos"), broke.alias("broke"))
        rows = own.put(rows)
    return rows.drop("broke")


def _entries(shapes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """The points where a class ends, and point 0, each with the class that it leads to and where that ends."""
    first = shapes.where("block = 0 AND n > 0").select(*keys, "block", F.lit(0).alias("entry"))
    asked = edges.select(*keys, F.col("next_block").alias("block"), F.col("next_entry").alias("entry")).unionByName(first).distinct()
    asked = asked.groupBy(*keys, "block").agg(F.collect_list("entry").alias("entries"))  # at most the points of a block
    led = asked.join(shapes.where("n > 0").select(*keys, "block", "chain"), [*keys, "block"])
    led = led.select(*keys, "block", F.inline(F.transform("entries", lambda p: F.struct(p.alias("entry"), F.get("chain", p).alias("class")))))
    return led.join(edges, [*keys, "block", "class"]).drop("class")


def _reached(nodes: DataFrame, keys: list[str], own: Staging) -> DataFrame:
    """The nodes that lie on the way from the first point of each series."""
    at = [*keys, "block", "entry"]
    there = [F.col("next_block").alias("block"), F.col("next_entry").alias("entry")]
    marked = own.put(nodes.where("block = 0 AND entry = 0").select(*at))
    jump = nodes.select(*at, "next_block", "next_entry")
    while True:
        more = own.put(marked.join(jump, at).select(*keys, *there).join(nodes.select(*at), at, "left_semi"))
        if more.isEmpty():
            return nodes.join(marked, at, "left_semi")
        marked = own.put(marked.unionByName(more).distinct())
        step = jump.select(*keys, F.col("block").alias("next_block"), F.col("entry").alias("next_entry"), F.col("next_block").alias("b"), F.col("next_entry").alias("e"))
        jump = own.put(jump.join(step, [*keys, "next_block", "next_entry"]).select(*at, F.col("b").alias("next_block"), F.col("e").alias("next_entry")))
