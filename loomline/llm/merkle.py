"""A Merkle manifest of a table: one tree a value of a column, one tree over their roots, a proof for each row.

Rows are numbered within their tree by a range sort, counts of its parts and running sums. Indices are bucketed
by fanout^k; ``applyInPandas`` collapses the k levels of a bucket, which gives each node the lower part of
its proof and the bucket its root; bucket roots are reduced in the same way until one node is left.
Proofs are put together from the top: that of a bucket's root follows those of its nodes. A bucket
has at most fanout^k rows whatever the tree, so a tree that holds most rows is many buckets.

Digests are SHA-256 over concatenated digests in lower-case hex; a run of fewer nodes, even of one, becomes its
digest as well; the tree ends when one node is left, and a lone leaf is its own root.

Defined results: a null field is hashed as ``-`` and so differs from the empty one; rows ascend by id, those
without id first, ties by their digest, and rows that repeat in full are leaves each; the trees are
in order of their key, null first; an empty table gives an empty result; columns that are not named are
neither hashed nor returned, so their names cannot clash; very long texts are hashed whole in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Nodes of a run, and levels that a bucket collapses.
FANOUT, LEVELS = 2, 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def joined_hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def field_hash(fields: list[Column]) -> Column:
    """Digest of fields, each as its bytes' count, a colon and itself; null as a hyphen."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def heights(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def collapse_nodes(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> tuple[list[bytes], bytes]:
    """(siblings of each node over ``levels`` levels, upwards, as one string; the root)."""
    tree = [nodes]
    for _ in range(levels):
        below = tree[-1]
        tree.append([joined_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    above = [b""] * len(tree[-1])
    for level in reversed(tree[:-1]):
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        above = [b"".join(run[:p]) + b"".join(run[p + 1 :]) + above[r] for r, run in enumerate(runs) for p in range(len(run))]
    return above, tree[-1][0]


def fold(node: bytes, siblings: bytes, idx: int, n: int, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """(root of the tree of n nodes as ``node`` at ``idx`` and its siblings give it, the siblings that are left)."""
    while n > 1:
        place = idx % fanout
        others = min(fanout, n - (idx - place)) - 1
        run = [siblings[32 * i : 32 * i + 32] for i in range(others)]
        node = joined_hash([*run[:place], node, *run[place:]])
        siblings, idx, n = siblings[32 * others :], idx // fanout, -(-n // fanout)
    return node, siblings


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place in their ``tree``, and n, its rows; staged.

    A range sort deals the rows out, so that a tree's rows lie in following parts; the places of its parts are running sums of their counts.
    """
    part = F.shiftright("at", 33).alias("part")  # the part of monotonically_increasing_id
    placed = common.stage(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "placed")
    cells = placed.groupBy("tree", part).agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    own = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("tree", "part", (before - F.col("low")).alias("shift"), F.sum("rows").over(own).alias("n"))
    out = placed.withColumn("part", part).join(cells, ["tree", "part"])
    return out.select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, idx, n, node, …) with siblings within the bucket; the first node of a bucket has its root."""
    size = fanout**levels
    schema = T.StructType([*nodes.schema.fields, T.StructField("siblings", T.BinaryType()), T.StructField("root", T.BinaryType())])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        siblings, root = collapse_nodes(list(map(bytes, pdf["node"])), min(levels, heights(int(pdf["n"].iloc[0]), fanout)), fanout)
        pdf["siblings"] = siblings
        pdf["root"] = [root, *[None] * (len(pdf) - 1)]
        return pdf[schema.names]

    return nodes.groupBy("tree", F.expr(f"idx div {size}")).applyInPandas(step, schema)


def reduce_tree(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with the siblings in their bucket, the buckets' (tree, bucket, siblings above, root of the tree))."""
    size = fanout**levels
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rounds.append(common.stage(collapse(nodes, fanout, levels), "collapsed"))
        most = -(-most // size)
        nodes = rounds[-1].where("root IS NOT NULL").select("tree", F.expr(f"idx div {size}").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("node"))
        if most <= 1:
            break
    above = nodes.select("tree", F.col("idx").alias("bucket"), F.lit(b"").alias("above"), F.col("node").alias("top"))
    for low in reversed(rounds[1:]):
        both = low.select("tree", "idx", "siblings", F.expr(f"idx div {size}").alias("bucket")).join(above, ["tree", "bucket"])
        above = both.select("tree", F.col("idx").alias("bucket"), F.concat("siblings", "above").alias("above"), "top")
    return rounds[0], above


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Rows (key, id, leaf, …) with subroot, root and what proves them: siblings, idx and n in the tree of the key, top_idx and top_n over the trees."""
    tree = F.when(F.col("key").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("key").cast("string")))  # never null, in order of the keys
    leaves = common.stage(rows.select(tree.alias("tree"), *[c for c in rows.columns if c != "key"]).withColumn("rid", F.monotonically_increasing_id()), "leaves")
    placed = ranked(leaves, ["id", "leaf", "rid"]).withColumnRenamed("leaf", "node")
    low, above = reduce_tree(placed, fanout, levels)
    roots = above.where("bucket = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"))
    top_low, top_above = reduce_tree(ranked(roots, ["name"]), fanout, levels)
    size = fanout**levels
    tops = top_low.withColumn("bucket", F.expr(f"idx div {size}")).join(top_above, ["tree", "bucket"])
    tops = tops.select(F.col("name").alias("tree"), F.concat("siblings", "above").alias("over"), F.col("top").alias("whole"), F.col("idx").alias("top_idx"), F.col("n").alias("top_n"))
    # with the buckets first: a tree's many rows never meet its one root in a join
    above = common.stage(above.join(tops, "tree"), "above")
    out = low.drop("root").withColumn("bucket", F.expr(f"idx div {size}")).join(above, ["tree", "bucket"])
    kept = [c for c in rows.columns if c not in ("key", "leaf")]
    return out.select(*kept, F.col("node").alias("leaf"), F.col("top").alias("subroot"), F.col("whole").alias("root"), F.concat("siblings", "above", "over").alias("siblings"), "idx", "n", "top_idx", "top_n")


def check(proofs: DataFrame, claimed: str, fanout: int = FANOUT) -> DataFrame:
    """A manifest with proof_sha256 and folded_root, the root that follows from the leaf in column ``claimed`` and the proof."""
    schema = T.StructType([*proofs.schema.fields, T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.BinaryType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            folded = []
            for node, siblings, idx, n, top_idx, top_n in zip(pdf[claimed], pdf["siblings"], pdf["idx"], pdf["n"], pdf["top_idx"], pdf["top_n"]):
                node, rest = fold(bytes(node), bytes(siblings), idx, n, fanout)
                folded.append(fold(node, rest, top_idx, top_n, fanout)[0])
            pdf["proof_sha256"] = [hashlib.sha256(bytes(s).hex().encode()).hexdigest() for s in pdf["siblings"]]
            pdf["folded_root"] = folded
            yield pdf[schema.names]

    return proofs.mapInPandas(run, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from leaves of which every seventh (by checksum of the id) was tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = F.when(chosen, field_hash([f + 1 if c == "n_chars" else f for c, f in fields.items()]))
    rows = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), field_hash(list(fields.values())).alias("leaf"), changed.alias("changed"))
    proofs = manifest(rows).withColumn("claimed", F.coalesce("changed", "leaf"))
    out = check(proofs, "claimed")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select(F.col("id").alias("doc_id"), *hexed, "proof_sha256", F.lower(F.hex("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", f"({n_chars})", "text")]
    return f"sha256({' || '.join(parts)})"


def _crc_sql(d: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    c = f"xor(c, CASE WHEN i % 8 = 0 THEN ord(substr({d}, (i // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length({d}))), lambda c, i: xor({c} >> 1, 3988292384 * ({c} & 1))), 4294967295)"


def _reduce_sql(name: str, source: str) -> str:
    """All nodes of all levels of the trees of ``source`` (tree, i, h)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {source}
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2
)"""


OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS claimed FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM rows),
{_reduce_sql("nodes", "leaves")},
subroots AS (SELECT tree AS name, '' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
{_reduce_sql("tops", "subroots")},
whole AS (SELECT h AS root FROM tops WHERE n = 1),
-- the node of each row on every level below the root, over both trees
steps AS (
  SELECT l.doc_id, l.claimed, nodes.level, nodes.tree, l.i // (1 << nodes.level) AS at FROM leaves l JOIN nodes ON nodes.tree = l.tree AND nodes.i = l.i // (1 << nodes.level) AND nodes.n > 1
  UNION ALL
  SELECT l.doc_id, l.claimed, 100 + tops.level, '', s.i // (1 << tops.level) FROM leaves l JOIN subroots s ON s.name = l.tree JOIN tops ON tops.i = s.i // (1 << tops.level) AND tops.n > 1
), every AS (SELECT tree, level, i, h FROM nodes UNION ALL SELECT '', 100 + level, i, h FROM tops),
paths AS (
  SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.level) AS k, s.at % 2 AS side, coalesce(e.h, '') AS sibling
  FROM steps s LEFT JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.i = xor(s.at, 1)
), proofs AS (SELECT doc_id, max(k) AS k, sha256(string_agg(sibling, '' ORDER BY k)) AS proof_sha256 FROM paths GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0::BIGINT AS k, claimed AS h FROM leaves
  UNION ALL
  SELECT f.doc_id, p.k, sha256(CASE WHEN p.side = 1 THEN p.sibling || f.h ELSE f.h || p.sibling END) FROM folds f JOIN paths p ON p.doc_id = f.doc_id AND p.k = f.k + 1
), ends AS (SELECT doc_id, h AS folded_root FROM folds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), whole
"""
