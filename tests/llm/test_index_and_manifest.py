"""The digest index and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import digest_index, merkle


def norm(t):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()


def copies(rows):
    """What exact dedup says of (id, text) rows with different ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return {i: (min(g), len(g), i == min(g), d) for d, g in groups.items() for i in g}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    base = ["", " ", None, "a  b", "a\tb", "a\x0bb", "a b", "A b", "a\xa0b", "é" * 3000, "x y\n" * 20000]
    return [(i * 3 - 50, r.choice([*base, f"own {i}", "hot copy", "hot  copy"])) for i in range(300)]


def test_dedup_is_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "p") for i, t in texts], "doc_id long, text string, digest string").withColumn("row", F.lit(1)).withColumn("rid", F.lit(2))
    out = digest_index.dedup_exact(df)
    assert out.columns == ["doc_id", "text", "digest", "row", "rid", "keep_id", "group_size", "kept", "text_sha256"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()}
    assert got == copies(texts) and {(r.digest, r.row, r.rid) for r in out.select("digest", "row", "rid").collect()} == {("p", 1, 2)}
    assert digest_index.dedup_exact(df.limit(0)).count() == 0
    named = digest_index.dedup_exact(df.select(F.col("doc_id").cast("string").alias("name"), "text"), id_col="name", carry=False).collect()
    assert len(named) == len(texts) and sum(r.kept for r in named) == len({norm(t) for _, t in texts})


def test_dedup_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "t"), (5, "t"), (None, "t"), (7, "t"), (None, "u"), (None, "u"), (9, None), (3, "")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in digest_index.dedup_exact(df).collect()]
    assert sorted(rows, key=repr) == sorted([(5, 5, 4, True), (5, 5, 4, False), (None, 5, 4, False), (7, 5, 4, False), (None, None, 2, True), (None, None, 2, False), (9, 3, 2, False), (3, 3, 2, True)], key=repr)


def test_index_is_persistent(spark, texts, tmp_path):
    path, first, second = f"file://{tmp_path}/index", texts[:150], texts[150:]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = digest_index.DigestIndex(spark, path, T.LongType(), 5)
    kept = {r.doc_id for r in digest_index.dedup_exact(frame(first), index, "one").collect() if r.kept}
    want = copies(first)
    assert kept == {i for i, v in want.items() if v[2]}
    index.close()
    index = digest_index.DigestIndex(spark, path, T.LongType())
    assert index.buckets == 5 and index.entries().count() == len(kept)
    seen = {v[3]: v[0] for v in want.values()}
    for _ in range(2):  # the second time as after a failure
        got = {r.doc_id: r for r in digest_index.dedup_exact(frame(second), index, "two").collect()}
        for i, v in copies(second).items():
            assert got[i].keep_id == seen.get(v[3], v[0]) and got[i].kept == (v[2] and v[3] not in seen) and got[i].group_size == v[1]
        index.compact(3)
        assert index.buckets == 3 and index.entries().count() == len({norm(t) for _, t in texts})
    plan = index.entries().hint("merge").join(index.entries(), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    index.close()


def node_hash(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([node_hash(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def proof(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run = i // fanout * fanout
        out += [h for j, h in enumerate(level[run : run + fanout], run) if j != i]
        i //= fanout
    return out


def leaf(row):
    return node_hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


@pytest.mark.parametrize("fanout,levels", [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_manifest_is_brute_force(spark, fanout, levels):
    r = random.Random(fanout)
    rows = [(r.randrange(80), r.choice("st"), lang, r.choice([None, 4]), r.choice([None, "", "ü", "text"])) for lang, n in (("en", 43), (None, 5), ("", 1), ("é", 8), ("z", 16)) for _ in range(n)]
    rows += [(None, None, "en", None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    fields = [F.col(c) for c in df.columns]
    proofs = merkle.manifest(df.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), merkle.field_hash(fields).alias("leaf"), F.lit(1).alias("tree_no")), fanout, levels)
    got = merkle.check(proofs, "leaf", fanout).collect()
    order = lambda x: (x is not None, x if x is not None else 0)
    keys = sorted({x[2] for x in rows}, key=lambda k: (k is not None, (k or "").encode()))
    leaves = {k: [leaf(x) for x in sorted((x for x in rows if x[2] == k), key=lambda x: (order(x[0]), leaf(x)))] for k in keys}
    trees = {k: levels_of(v, fanout) for k, v in leaves.items()}
    top = levels_of([trees[k][-1][0] for k in keys], fanout)
    want = sorted((h, trees[k][-1][0], top[-1][0], node_hash(proof(trees[k], i, fanout) + proof(top, keys.index(k), fanout))) for k in keys for i, h in enumerate(leaves[k]))
    assert sorted((x.leaf.hex(), x.subroot.hex(), x.root.hex(), x.proof_sha256) for x in got) == want
    assert all(x.folded_root == x.root and x.tree_no == 1 for x in got)
    broken = merkle.check(proofs.withColumn("leaf", F.unhex(F.sha2(F.col("leaf"), 256))), "leaf", fanout)
    assert broken.where("folded_root = root").count() == 0
    assert merkle.check(merkle.manifest(df.limit(0).select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), merkle.field_hash(fields).alias("leaf")), fanout, levels), "leaf").count() == 0


def test_manifest_query_marks_what_was_changed(spark):
    got = merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got) and len({r.root for r in got}) == 1
