"""Texts that arrive in a folder become results and finished jobs, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlens.plans.analyze import Analysis, analyze
from pactlens.sources.store import commit_results, upload_errors
from pactlens.streaming.jobs import eta_minutes


def batch_results(docs: DataFrame, run: Callable[[DataFrame], Analysis] = analyze, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(results, jobs) of documents (doc_id, path, size, text): a result for each that is taken, a job row for every one.

    A result holds the summary, the findings in order and the number of paragraphs. A document that is not taken, or has more paragraphs
    than allowed, fails with its error and has no result.
    """
    checked = docs.withColumn("error", upload_errors(docs, limits.get("max_megabytes", 0)))
    done = run(checked.filter("error IS NULL").select("doc_id", "text"))
    sizes = done.paragraphs.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("paragraph_count"))
    windows = done.windows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"))
    told = checked.join(sizes, "doc_id", "left").join(windows, "doc_id", "left").fillna(0, ["paragraph_count", "n_windows"])
    many = upload_errors(told.select("paragraph_count"), 0, limits.get("max_paragraphs", 0))
    told = told.withColumn("error", F.coalesce("error", many))
    found = done.findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in done.findings.columns if c != "doc_id"]))).alias("findings"))
    taken = told.filter("error IS NULL").select("doc_id", "path", "paragraph_count")
    summary = done.summary.select("doc_id", F.struct(*[c for c in done.summary.columns if c != "doc_id"]).alias("summary"))
    results = taken.join(summary, "doc_id").join(found, "doc_id", "left")
    results = results.withColumn("findings", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)))
    jobs = told.select(
        F.col("doc_id").alias("job_id"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.lit(100).alias("progress"), "error", F.col("path").alias("filename"), "paragraph_count",
        eta_minutes(F.col("n_windows")).alias("estimated_minutes"), F.current_timestamp().alias("updated_at"),
    )
    return results, jobs


def read_inbox(spark: SparkSession, inbox: str) -> DataFrame:
    """doc_id (a digest of the path), path, size and text of files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).load(inbox)
    meta = F.col("_metadata")
    return files.select(F.sha2(meta["file_path"], 256).alias("doc_id"), meta["file_path"].alias("path"), meta["file_size"].alias("size"), F.col("value").alias("text"))


def ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str, **limits: int) -> StreamingQuery:
    """Work off what is in the inbox, batch by batch; begun again with the same checkpoint it goes on where it was."""

    def commit(batch: DataFrame, number: int) -> None:
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.DISK_ONLY))
            return kept[-1]

        commit_results(*batch_results(batch, lambda docs: analyze(docs, keep=keep), **limits), store, number)
        for df in kept:
            df.unpersist()

    return read_inbox(spark, inbox).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
