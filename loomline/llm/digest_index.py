"""Exact dedup against a persistent index of text digests.

``DigestIndex`` is a Parquet table (digest, keep_id, batch), bucketed and sorted by the digest, in a
folder of its own. New data is brought down to one row a digest, anti-joined with the index by a
sort-merge join for which only the new digests are shuffled, and what is left is appended. Each
entry names the batch that brought it: a batch that is added again after a failure finds its own
entries and gives the same answer. ``compact`` rewrites the files of many appends as one a bucket.

``dedup_exact`` adds a table in batches of ascending ids, so that the first to come is the smallest.

Defined results: a null text is the empty text; texts are equal if they are after each run of white
space [\\x20\\x09-\\x0D] became one space (a text of white space only is one space, not empty); of rows that
repeat the smallest id one stays; a row without id stays only if all of its group have none, and then
keep_id is null; an empty table gives an empty result; other columns, of any name, are passed through
unless they bear a result's name; very long texts are hashed whole. A group of copies is counted before it is
shuffled, and the join that tells its rows is one that Spark splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Entries of a bucket at which an index is planned, and batches of a table.
BUCKET_ROWS, BATCHES = 2_000_000, 3
_SPACES = r"[\x20\x09-\x0D]+"


class DigestIndex:
    """Digests in ``path``; ``id_type`` is that of keep_id. An index that is there is opened, with its own number of buckets."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType, buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        found = self._generations()
        self.generation, self.buckets = max(found) if found else (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._attach()

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of the generations whose files are complete."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [(int(n.split("-")[1]), int(n.split("-")[2])) for n in names if n.startswith("generation-")]

    def _attach(self) -> None:
        self.table = f"loomline_digests_{uuid.uuid4().hex}"
        self.place = f"{self.path}/generation-{self.generation}-{self.buckets}"
        self.spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type.simpleString()}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.place}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests of ``groups`` (digest, keep_id; a digest once) that are new.

        Returns digest, keep_id as the index has it, and own: whether this batch brought it.
        """
        mine = groups.select("digest", "keep_id")
        new = mine.hint("merge").join(self.entries(), "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        known = mine.select("digest").hint("merge").join(self.entries(), "digest")
        return known.select("digest", "keep_id", (F.col("batch") == batch).alias("own"))

    def compact(self, buckets: int | None = None) -> None:
        """Write all entries as the next generation, one file a bucket; the one before goes once that is complete."""
        old, held = self.place, self.table
        entries = self.entries()
        work, self.buckets, self.generation = f"{self.path}/_next-{uuid.uuid4().hex}", buckets or self.buckets, self.generation + 1
        name = f"loomline_digests_{uuid.uuid4().hex}"
        entries.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", work).saveAsTable(name)
        common.rename(self.spark, work, f"{self.path}/generation-{self.generation}-{self.buckets}")
        for t in (name, held):
            self.spark.sql(f"DROP TABLE {t}")
        self._attach()
        common.remove(self.spark, old)

    def close(self) -> None:
        """Take the table out of the session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def text_digest(text) -> F.Column:
    return F.unhex(F.sha2(F.regexp_replace(common.text_of(text), _SPACES, " "), 256))


def dedup_exact(docs: DataFrame, index: DigestIndex | None = None, label: str | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, carry: bool = True) -> DataFrame:
    """``docs`` (or their ids only) with keep_id, group_size, kept and text_sha256.

    group_size counts the rows of this table. With an ``index`` of earlier tables, texts that it holds are not
    kept; ``label`` names this table in it. Ids that are no integers are added as one batch.
    """
    spark = docs.sparkSession
    taken = {"keep_id", "group_size", "kept", "text_sha256"}
    names = [c for c in docs.columns if c not in taken] if carry else [id_col]
    kind, cuts = docs.schema[id_col].dataType, []
    if isinstance(kind, T.IntegralType) and batches > 1:
        cuts = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    batch = F.when(F.col(id_col).isNull(), len(cuts))
    for i, q in enumerate(cuts):
        batch = batch.when(F.col(id_col) <= q, i)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), batch.otherwise(len(cuts)).alias("batch")
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = common.stage(rows, "digests", by=["batch"])
    own_index = index is None
    if own_index:
        count = rows.count()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BUCKET_ROWS))
        index = DigestIndex(spark, common.new_path(spark, "digest-index"), kind, buckets)
    label, told = label or uuid.uuid4().hex, []
    for b in range(len(cuts) + 1):
        first = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")
        groups = rows.where(F.col("batch") == b).groupBy("digest").agg(first, F.count("*").alias("n"))
        groups = common.stage(groups.select("digest", "n", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("rid")), "groups")
        found = index.add(groups, f"{label}-{b}")
        told.append((groups, common.stage(groups.drop("keep_id").join(found, "digest"), "told")))
    every = told[0][1]
    for _, t in told[1:]:
        every = every.unionByName(t)
    # staged, so that the join below has its exchanges to itself and the rows of a large group can be split
    every = every.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id"), F.max(F.when(F.col("own"), F.col("rid"))).alias("kept_rid"))
    totals = common.stage(every, "totals")
    for pair in told:
        for t in pair:
            common.release(t)
    if own_index:
        index.close()
        common.remove(spark, index.path)
    out = rows.select("row", "digest", "rid").join(totals, "digest")
    kept = F.coalesce(F.col("rid") == F.col("kept_rid"), F.lit(False))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_exact(docs, carry=False)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
