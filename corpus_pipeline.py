"""A training-corpus pipeline over the documents table: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacis.llm import bpe, jaccard_join, line_dedup, mixing, quality
from surfacis.llm.common import new_path, table
from surfacis.llm.common import stage as staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted to labels.quality, predicts as 1."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share."""
    return _columns(line_dedup.dedup_lines(docs, min_docs=10))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, staged, so that it stays: rows without an id or with a shared one are rows of their own."""
    return staged(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the smallest id, null ids last, and of rows that share it the first. Texts without words link with nothing and stay."""
    rows = _numbered(docs, "pipeline-rows")
    group = jaccard_join.jaccard_components(rows, words=5, p=4, q=5, id_col="__row").select("__row", F.col("component_id").alias("__group"))
    grouped = staged(rows.select("doc_id", "__row").join(group, "__row"), "pipeline-groups")
    first = grouped.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))).alias("__first")).select(F.col("__first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix begins them: once for each pass over its source, so no more than twice; those that the budget doesn't reach go."""
    rows = _numbered(docs, "pipeline-rows")
    taken = mixing.mix(rows, carry=("__row",)).where("taken > 0").select("__row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    return rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to, which is the text's."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: SQL has no trees, lasso or BPE. tests/llm runs the pipeline over a small folder, decodes its ids and holds the near-duplicate stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table, each written as Parquet in the shared folder and read again. Null and shared ids are rows of their own throughout; an empty table gives an empty one of the last stage's columns."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
