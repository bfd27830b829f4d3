"""Sharding by sampled splitters, with DataFrame and SQL functions only.

Keys are sampled in proportion to the size of their rows, their quantiles split the key space
into ranges, ranges that are still overfull are subdivided, and a running sum within the
ranges places each row. Law: ``bytes``; shards are near equal in bytes.

The key is (hash of the text, id), so equal texts are neighbours and share a shard unless their
group is larger than an eighth of a shard, when it is split by id. Groups and rows larger than
``1 / fine`` of a shard are dealt first, largest to the emptiest shard; there are at most
``fine * shards`` of them.

Defined results: a null text has size ``overhead`` and the checksum of the empty text; repeated
rows and rows without an id are each placed once; ties in the key go by id, then by a row number; an
empty table gives an empty result; other columns, of any name, are passed through unless they bear a
result's name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHARDS, OVERHEAD, FINE, SAMPLES = 24, 8, 50, 32
#: Rows of a range, and ranges at most.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int = SAMPLES) -> list[int]:
    """Quantiles of keys drawn with probability in proportion to size, about ranges * per_range of them.

    The draw is by a hash of the id, so a rerun draws the same keys.
    """
    want = ranges * per_range
    # a row larger than total / want is drawn for certain, so about want keys come to the driver whatever the input
    u = F.pmod(F.xxhash64(F.lit("draw"), "__id", "__rid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(u * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(want))).select("__key")
    keys = sorted(r[0] for r in drawn.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def deal_large(sizes: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Largest first to the emptiest shard; (place of each row number, bytes of each shard)."""
    heap, load, place = [(0, s) for s in range(shards)], [0] * shards, {}
    for size, row in sorted(sizes, key=lambda x: (-x[0], x[1])):
        used, s = heapq.heappop(heap)
        place[row], load[s] = s, used + size
        heapq.heappush(heap, (load[s], s))
    return place, load


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, fine: int = FINE, carry: bool = True) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard."""
    spark = docs.sparkSession
    text = common.text_of(F.col(text_col))
    taken = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    names = [c for c in docs.columns if c not in taken] if carry else [id_col]
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__all"),
        F.col(id_col).alias("__id"),
        (F.octet_length(F.encode(text, "UTF-8")) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("__key"),
    )
    # the row number is in the staged table, so it does not change
    staged = slim = common.stage(slim.withColumn("__rid", F.monotonically_increasing_id()), "sizes")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    target = max(1, total["b"] // shards)
    limit = max(1, target // fine)
    # texts whose copies together exceed the limit: fewer than total / limit, that is about fine * shards
    heavy = slim.groupBy("__key").agg(F.sum("size").alias("b")).where(F.col("b") > limit).collect() if total["n"] else []
    whole = [(r["b"], r["__key"]) for r in heavy if r["b"] <= target // 8]
    split = [r["__key"] for r in heavy if r["b"] > target // 8]
    slim = slim.join(F.broadcast(spark.createDataFrame([(k, True) for _, k in whole] + [(k, False) for k in split], "__key long, __whole boolean")), "__key", "left")
    alone = (F.col("__whole") == F.lit(False)) & (F.col("size") > limit)
    large = [(r["size"], r["__rid"]) for r in slim.where(alone).select("size", "__rid").collect()] if split else []
    place, load = deal_large([(b, i) for i, (b, _) in enumerate(whole + large)], shards)
    room = [max(0.0, (total["b"] / shards) - x) for x in load]
    small_total = total["b"] - sum(load)
    scale = small_total / sum(room) if sum(room) else 0.0
    edges, at = [], 0.0
    for x in room[:-1]:
        at += x * scale
        edges.append(int(at))
    small = slim.where(F.col("__whole").isNull() | ((F.col("__whole") == F.lit(False)) & (F.col("size") <= limit)))
    ranges = min(MOST_RANGES, max(shards * 4, total["n"] // RANGE_ROWS))
    bounds = splitters(small, small_total, ranges)
    small = small.withColumn("__range", common.range_index(F.col("__key"), bounds))
    # overfull ranges, such as those of one large group of copies, are subdivided by id
    by_range = small.groupBy("__range").agg(F.sum("size").alias("b")).collect()
    quota = max(1, small_total // ranges)
    parts = {r["__range"]: max(1, -(-r["b"] // quota)) for r in by_range}
    pieces = F.element_at(F.array(*[F.lit(parts.get(k, 1)).cast("long") for k in range(len(bounds) + 1)]), F.col("__range") + 1)
    cut = F.when(F.col("__whole").isNotNull(), F.pmod(F.xxhash64("__id", "__rid", F.lit("cut")), pieces)).otherwise(F.pmod(F.xxhash64("__key", F.lit("cut")), pieces))
    small = small.withColumn("__piece", cut.cast("int"))
    cell = W.partitionBy("__range", "__piece")
    order = cell.orderBy("__key", "__id", "__rid")
    small = small.withColumn("__before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    placed = small = common.stage(small, "placed")
    cells = small.groupBy("__range", "__piece").agg(F.sum("size").alias("b")).orderBy("__range", "__piece").collect()  # about 8 * shards rows
    offset, at = [], 0
    for r in cells:
        offset.append((r["__range"], r["__piece"], at))
        at += r["b"]
    if offset:
        starts = spark.createDataFrame(offset, "__range int, __piece int, __start long")
        small = small.join(F.broadcast(starts), ["__range", "__piece"])
    else:
        small = small.withColumn("__start", F.lit(0).cast("long"))
    point = F.col("__start") + F.col("__before") + F.expr("size div 2")
    group_point = F.min(point).over(W.partitionBy("__range", "__piece", "__key"))
    point = F.when(F.col("__whole").isNull(), group_point).otherwise(point)
    small = small.withColumn("shard", common.range_index(point, edges))
    parts_of = [small.select("__rid", "__id", "__all", "size", "text_crc32", "shard", "__range", "__piece", "__before")]
    for on, keys, rest in (("__key", whole, F.col("__whole")), ("__rid", large, alone)):
        if keys:
            n = 0 if on == "__key" else len(whole)
            kind = slim.schema[on].dataType
            dealt = spark.createDataFrame([(k, place[n + i]) for i, (_, k) in enumerate(keys)], T.StructType([T.StructField(on, kind), T.StructField("shard", T.IntegerType())]))
            big = slim.where(rest).join(F.broadcast(dealt), on)
            parts_of.append(big.select("__rid", "__id", "__all", "size", "text_crc32", "shard", F.lit(-1).alias("__range"), F.lit(0).alias("__piece"), F.lit(0).cast("long").alias("__before")))
    rows = parts_of[0]
    for x in parts_of[1:]:
        rows = rows.unionByName(x)
    # slots: the rows of a shard within each cell, after those of the cells before
    rows = rows.withColumn("__nth", F.row_number().over(W.partitionBy("shard", "__range", "__piece").orderBy("__before", "__id", "__rid")) - 1)
    rows = common.stage(rows, "shards")
    for old in (staged, placed):
        common.release(old)
    counts = rows.groupBy("shard", "__range", "__piece").count().orderBy("shard", "__range", "__piece").collect()
    offset, last, at = [], None, 0
    for r in counts:
        at = 0 if r["shard"] != last else at
        offset.append((r["shard"], r["__range"], r["__piece"], at))
        last, at = r["shard"], at + r["count"]
    first = spark.createDataFrame(offset, "shard int, __range int, __piece int, __first long")
    rows = rows.join(F.broadcast(first), ["shard", "__range", "__piece"])
    return rows.select(*[F.col("__all").getField(c).alias(c) for c in names], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs, carry=False)
