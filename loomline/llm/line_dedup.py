"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps, for each line key, in how many documents it was seen and the largest
document that holds it. Each batch of documents is merge-anti-joined with the runs: its new keys
become one sorted run of level 0, so that a key lies in one run only, and its known keys
go beside it as updates of count and largest document. A level that reaches ``fanout`` runs is
merged into one run of the next level, and so are their updates.

Defined results: a null or empty text is one empty line; equal documents count once each;
keys shorter than ``min_chars`` code points never drop; rows of one id are one document, each with its own
lines; rows without an id count as one document, keep their lines and are never the last; an empty
table gives an empty result; other columns of the input, of any name, are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = ["h1", "h2"]
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(common.SPACES)))


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line_no, h1, h2) of the lines whose key is long enough; keys are 128-bit hashes."""
    text = common.text_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "text_hash", "line_no", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return rows.select("doc_id", "text_hash", "line_no", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))


def without(text: Column, gone: Column) -> Column:
    """The text less the lines of the ascending numbers ``gone``: the stretches between them, joined."""
    lines = F.split(text, "\n", -1)
    borders = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.size(lines))).alias("b"))
    return F.array_join(F.flatten(F.transform(borders, lambda p: F.slice(lines, p["a"] + 2, p["b"] - p["a"] - 1))), "\n")


class LineRuns:
    """Sorted runs (h1, h2, n_docs, last_doc) in levels, in the shared folder, each with its updates of keys of earlier runs."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, DataFrame | None]]] = []
        self.merges = 0

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def updates(self) -> list[DataFrame]:
        return [known for level in self.levels for _, known in level if known is not None]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines whose key is in no run yet."""
        for run in self.runs():
            lines = lines.join(run.hint("merge"), KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch; a document must lie in one batch only."""
        per_doc = lines.select("doc_id", *KEY).distinct()
        batch = per_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self.runs():
            self._put(0, common.stage(batch.sortWithinPartitions(*KEY), "run0"), None)
            return
        batch = common.stage(batch, "batch")
        new = common.stage(self.unseen(batch).sortWithinPartitions(*KEY), "run0")
        known = common.stage(batch.join(new.hint("merge"), KEY, "left_anti").sortWithinPartitions(*KEY), "known0")
        common.release(batch)
        self._put(0, new, known)

    def _put(self, level: int, run: DataFrame, known: DataFrame | None) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, known))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.merges += 1
            runs, updates = [r for r, _ in old], [k for _, k in old if k is not None]
            merged = common.stage(self._merged(updates), f"known{level + 1}") if updates else None
            self._put(level + 1, common.stage(self._merged(runs), f"run{level + 1}"), merged)
            for r in runs + updates:
                common.release(r)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        rows = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return rows.sortWithinPartitions(*KEY)

    def compact(self) -> DataFrame:
        """All runs as one, with the updates of their keys."""
        found = self.runs() + self.updates()
        return found[0] if len(found) == 1 else self._merged(found)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The documents with text less its repeated lines, plus n_lines and n_dropped.

    A key held by at least ``min_docs`` documents keeps its lines only in the largest id.
    A document left with no line gets the empty text.
    """
    spark = docs.sparkSession
    slim = common.stage(keyed_lines(docs, id_col, text_col, min_chars), "lines")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    # staged, so that the join has its exchanges to itself and a very common line's partition can be split
    common_keys = common.stage(runs.compact().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "common")
    hits = slim.join(common_keys, KEY).where(F.col("doc_id") != F.col("last_doc"))
    own, own_hash, text, gone = common.unused(docs, "__id", "__hash", "__text", "__gone")
    hits = hits.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(own_hash)).agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    extra = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(*extra, common.text_of(F.col(text_col)).alias(text))
    rows = rows.join(hits, (F.col(id_col) == F.col(own)) & (F.xxhash64(text) == F.col(own_hash)), "left")
    hit = F.col(gone).isNotNull()
    return rows.select(
        *extra,
        F.when(hit, without(F.col(text), F.col(gone))).otherwise(F.col(text)).alias(text_col),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.when(hit, F.size(gone)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> often.last_doc, FALSE) AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
