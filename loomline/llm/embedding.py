"""Embedding near-dedup: an exact metric range join over pivots.

Unit vectors lie in the metric space of chord distance, where cosine >= t is distance <= r with
r = sqrt(2 - 2t). Pivots, drawn from the vectors, make Voronoi cells. A vector visits a cell of
smaller number only if the triangle inequality (and the distance to the cells' dividing plane)
allows a partner there, so each pair of vectors meets exactly once. Cells are cut into blocks
and their visitors into chunks of bounded size; each block and chunk joins by itself.

Exact copies are one class with a weight, so they are never compared with each other. A block
returns, for each vector with a link, its number of links and the root of a spanning forest of
the links found there; pairs are not written out.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link
with nothing; vectors of different lengths link with nothing of another length; ids are unique;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

COSINE, BLOCK, CHUNK, MAX_PIVOTS = 0.9, 16_384, 16_384, 256
#: Single precision is trusted outside this band around the threshold; inside, pairs are computed again in double.
_BAND, _TILE = 2e-5, 1024

_CLASS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("home", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
_ROUTE = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("rep", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("vec", T.BinaryType())])
_FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _matrix(vecs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, padded with zeros to one width; their own lengths)."""
    sizes = np.array([len(v) // 8 for v in vecs], dtype=np.int64)
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, : sizes[i]] = np.frombuffer(v, "<f8")
    return out, sizes


def _padded(vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = max((len(v) // 8 for v in vecs), default=1)
    if all(len(v) // 8 == width for v in vecs):
        return np.frombuffer(b"".join(vecs), "<f8").reshape(-1, width), np.full(len(vecs), width)
    return _matrix(vecs, width)


class _Forest:
    """Labels of the nodes of one task; joining relabels whole trees at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, row: int, cols: np.ndarray) -> None:
        roots = np.unique(self.label[cols])
        own = self.label[row]
        if len(roots) == 1 and roots[0] == own:
            return
        roots = np.union1d(roots, [own])
        self.label[np.isin(self.label, roots)] = roots[0]


def links_within(home: tuple, other: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among ``home`` and from home to ``other``, each (unit vectors, lengths, weights).

    ``other`` None: only those among home. Returns (links of home, links of other, forest labels over both).
    """
    hx, hs, hw = home
    among = other is None
    ox, os_, ow = home if among else other
    forest = _Forest(len(hx) + (0 if among else len(ox)))
    h_links, o_links = np.zeros(len(hx)), np.zeros(len(ox))
    width = max(hx.shape[1], ox.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    hx, ox = pad(hx), pad(ox)
    h32, o32 = hx.astype(np.float32), np.ascontiguousarray(ox.astype(np.float32).T)
    mixed = len(np.unique(np.concatenate([hs, os_]))) > 1
    for at in range(0, len(hx), _TILE):
        s = h32[at : at + _TILE] @ o32
        hit = s >= cosine + _BAND
        near = (s > cosine - _BAND) & ~hit
        if near.any():
            i, j = np.nonzero(near)
            good = np.einsum("ij,ij->i", hx[at + i], ox[j]) >= cosine
            hit[i[good], j[good]] = True
        if mixed:
            hit &= hs[at : at + _TILE, None] == os_[None, :]
        if among:
            k = np.arange(len(hit))
            hit[k, at + k] = False
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            continue
        own = hit[some]
        h_links[at + some] += own @ ow.astype(np.float64)
        if not among:
            o_links += hw[at + some].astype(np.float64) @ own
        for k, row in zip(some, own):
            forest.join(at + k, np.flatnonzero(row) + (0 if among else len(hx)))
    return h_links, o_links, forest.label


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, class key), (classes: rep, weight, vec as array of doubles) of the valid vectors."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    valid = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    # equal components make equal classes; 128 bits of hash stand for them
    members = rows.select("id", F.when(valid, F.col("vec")).alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("v"), "vec")})
    made = members.where(F.col("vec").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    return members.select("id", F.col("vec").isNotNull().alias("valid"), "h1", "h2"), made


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    radius = math.sqrt(2 - 2 * cosine) + 1e-9
    members, made = classes(vectors, id_col, vec_col)
    members, made = common.stage(members, "members"), common.stage(made, "classes")
    total = made.count()
    wanted = min(MAX_PIVOTS, max(1, math.ceil(total / block)))
    drawn = made.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vec").collect()  # at most MAX_PIVOTS rows
    pivots = [unit(np.array(r["vec"], dtype=np.float64)) for r in drawn]
    spread = max((len(p) for p in pivots), default=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [unit(np.array(v, dtype=np.float64)) for v in b.column(2).to_pylist()]
            width = max([spread, *map(len, vecs)])
            x, p = np.zeros((len(vecs), width)), np.zeros((len(pivots), width))
            for m, rows in ((x, vecs), (p, pivots)):
                for i, v in enumerate(rows):
                    m[i, : len(v)] = v
            d2 = np.maximum(0, 2 - 2 * (x @ p.T))
            dist, between = np.sqrt(d2), np.sqrt(np.maximum(1e-18, 2 - 2 * (p @ p.T)))
            home = dist.argmin(axis=1)
            own = np.arange(len(x))
            near = dist - dist[own, home][:, None] <= 2 * radius
            near &= (d2 - d2[own, home][:, None]) / (2 * between[:, home].T) <= radius
            near &= np.arange(len(pivots))[None, :] < home[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.astype("<f8").tobytes() for v in vecs], pa.binary()), pa.array(home.astype(np.int32)), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))], names=_CLASS.names)

    placed = common.stage(made.select("rep", "weight", "vec").mapInArrow(assign, _CLASS), "cells")
    size = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most MAX_PIVOTS rows
    n_blocks = {c: max(1, math.ceil(n / block)) for c, n in size.items()}
    visitors = {c: r for c, r in ((r["c"], r["n"]) for r in placed.select(F.explode("visits").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect())}
    n_chunks = {(c, b): max(1, math.ceil((visitors.get(c, 0) + (n_blocks[c] - b - 1) * block) / chunk)) for c in size for b in range(n_blocks[c])}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out: list[tuple] = []
                for r in batch.slice(at, 2000).to_pylist():
                    mix = (r["rep"] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 17
                    own, rest = mix % n_blocks[r["home"]], (r["rep"], r["weight"], r["vec"])
                    out += [(r["home"], own, k, True, *rest) for k in range(n_chunks[r["home"], own])]
                    units = [(c, b) for c in r["visits"] if c in n_blocks for b in range(n_blocks[c])] + [(r["home"], b) for b in range(own)]
                    out += [(c, b, (mix >> 13) % n_chunks[c, b], False, *rest) for c, b in units]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=_ROUTE.names)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        reps, weights = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        x, sizes = _padded(table.column("vec").to_pylist())
        pick = lambda m: (x[m], sizes[m], weights[m])
        h, o = np.flatnonzero(home), np.flatnonzero(~home)
        links, ids, roots = [], [], []
        runs = [(h, None)] if key[2].as_py() == 0 else []
        runs += [(h, o)] if len(h) and len(o) else []
        for a, b in runs:
            h_links, o_links, label = links_within(pick(a), None if b is None else pick(b), cosine)
            nodes = reps[a] if b is None else np.concatenate([reps[a], reps[b]])
            n = h_links if b is None else np.concatenate([h_links, o_links])
            some = np.flatnonzero(n > 0)
            ids.append(nodes[some])
            links.append(n[some].astype(np.int64))
            roots.append(nodes[label[some]])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(ids), pa.int64()), pa.array(cat(links), pa.int64()), pa.array(cat(roots), pa.int64())], names=_FOUND.names)

    routed = placed.mapInArrow(route, _ROUTE)
    found = common.stage(routed.groupBy("cell", "block", "chunk").applyInArrow(join, _FOUND), "found")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = made.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = members.join(by_class, ["h1", "h2"], "left")
    own = F.col("valid") & F.col("component_id").isNotNull()
    out = out.select(F.col("id").alias(id_col), F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op5_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
