"""A training corpus from documents in five stages, each an operator of pactlens.llm on all that the one before it kept.

Quality rules drop what the base rule or the learned list rejects. Line dedup takes repeated lines out of the texts and drops
documents that had lines with words and lost them all. Near-dedup leaves one document of each group. Decontamination drops
documents that hold a window of a benchmark item. The last stage encodes the texts and decodes the ids again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm._common import Stage
from pactlens.llm.bpe_codec import encode_decode
from pactlens.llm.decontam import keep_clean
from pactlens.llm.line_dedup import dedup_lines
from pactlens.llm.near_dup import keep_one
from pactlens.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("bpe_codec", tokens)]

#: Learned rules and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stage.table(docs, name)
    return docs
