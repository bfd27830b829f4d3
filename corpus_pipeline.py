"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> BPE.
Each stage works on all that the one before has kept. All but the last return the columns of
``documents``; the last returns the token ids' digests for each document that is left.

Defined results: a null text is scored and cut into lines as the empty one, becomes empty in line dedup, is near nothing and
has no tokens; documents of one id count as one where lines are counted, and go or stay together where a stage decides by id;
rows without an id are kept by the stages that decide by id; ties go to the smallest id; an empty table gives
an empty table; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, common, decontaminate, jaccard_join, line_dedup, quality

#: Quality, edits and token ids are not expressible in SQL; tests/llm/test_pipeline_stages.py checks the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.where("predicted = 1").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their repeated lines gone; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def jaccard_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group: 5-word shingles, similarity 0.8 or more."""
    groups = jaccard_join.near_duplicates(docs.where("doc_id IS NOT NULL"), words=5, percent=80)
    return jaccard_join.less(docs, groups.where("doc_id <> component_id").select("doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256 of each document."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("jaccard_near_duplicates", jaccard_near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
