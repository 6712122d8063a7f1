"""What a running service keeps: the log of its jobs, results, and the cache of few-shot examples, all in folders that Spark writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.text import strip

#: Version of the cache's layout; another one is as good as none.
CACHE_VERSION = "fewshot_v2"
EXAMPLE = "ex_no int, clause string, question string, evidence string, category_id string"
MANIFEST = "version string, source string, only_category_ids array<string>, categories array<struct<id:string,count:long>>"
#: Endings of files that are taken.
TYPES = (".txt", ".pdf")
MEGABYTE = 1 << 20


class NotFound(LookupError):
    """There is no such job, or no result of it."""


class NotFinished(RuntimeError):
    """The job has no result yet."""


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_written(spark: SparkSession, path: str) -> bool:
    """A write to the folder was committed."""
    p, fs = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


# Jobs


def append_jobs(rows: DataFrame, path: str) -> None:
    """Add rows (job_id, updated_at, and any of the other columns) to the log; columns that are new widen the table."""
    rows.write.mode("append").parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The whole log under the schema of all its files; what a file lacks is null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def current_jobs(log: DataFrame, tie: str | None = None) -> DataFrame:
    """A row for each job: of every column the last value that was set, by updated_at, then by `tie`. A row sets what isn't null in it.

    One exchange on job_id, behind a partial aggregation; a job of many rows is no heavier than one.
    """
    order = F.struct("updated_at", tie) if tie else F.struct("updated_at")
    others = [c for c in log.columns if c not in ("job_id", "updated_at", tie)]
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return log.groupBy("job_id").agg(F.max("updated_at").alias("updated_at"), *map(last, others))


def compact_jobs(spark: SparkSession, path: str, target: str, tie: str | None = None) -> None:
    """The current rows of a log as a log of their own at `target`, which then takes the place of the old one."""
    current_jobs(read_jobs(spark, path), tie).write.mode("errorifexists").parquet(target)


# Uploads and results


def upload_errors(docs: DataFrame, max_megabytes: int = 0, max_paragraphs: int = 0) -> Column:
    """Why a document (path, size in bytes, text, paragraph_count) is not taken: its type, size, no text, too many paragraphs; else null.

    Limits of 0 are none. Columns that docs lacks are not looked at.
    """
    has = lambda c: c in docs.columns
    out = F
    if has("path"):
        out = out.when(~F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*TYPES), F.lit("type"))
    if has("size") and max_megabytes:
        out = out.when(F.col("size") > max_megabytes * MEGABYTE, F.lit("size"))
    if has("text"):
        out = out.when(strip(F.col("text")) == "", F.lit("empty"))
    if has("paragraph_count") and max_paragraphs:
        out = out.when(F.col("paragraph_count") > max_paragraphs, F.lit("paragraphs"))
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None).cast("string"))


def commit_results(results: DataFrame, jobs: DataFrame, store: str, batch: int) -> bool:
    """Write a batch's results (doc_id, ...), then its job rows (job_id, status, ...), which alone make the results visible.

    A batch that has its job rows is left as it is, so one that is replayed changes nothing; one that was cut off is written anew.
    """
    spark = results.sparkSession
    if is_written(spark, f"{store}/jobs/batch={batch}"):
        return False
    results.write.mode("overwrite").parquet(f"{store}/results/batch={batch}")
    jobs.write.mode("overwrite").parquet(f"{store}/jobs/batch={batch}")
    return True


def committed_jobs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{store}/jobs")


def committed_results(spark: SparkSession, store: str) -> DataFrame:
    """Results of batches whose job rows are written: the batches are few against their rows and found by their folders."""
    done = committed_jobs(spark, store).select("batch").distinct()
    return spark.read.option("mergeSchema", True).parquet(f"{store}/results").join(F.broadcast(done), "batch", "left_semi")


def result_of(spark: SparkSession, store: str, job_id: str) -> str:
    """A job's result as JSON. NotFound without such a job or result, NotFinished if it isn't done."""
    job = committed_jobs(spark, store).filter(F.col("job_id") == job_id).select("status", "batch").orderBy(F.col("batch").desc()).first()
    if job is None:
        raise NotFound(job_id)
    if job.status != "done":
        raise NotFinished(job_id)
    rows = spark.read.parquet(f"{store}/results/batch={job.batch}").filter(F.col("doc_id") == job_id)
    found = rows.select(F.to_json(F.struct("*")).alias("json")).first()
    if found is None:
        raise NotFound(job_id)
    return found.json


# Few-shot cache


def write_cache(examples: DataFrame, path: str, source: str = "", only: list[str] | None = None) -> None:
    """Examples (category_id, ex_no, clause, question, evidence) as JSON, a folder for each category, and a manifest.

    Only the categories at hand are rewritten. The manifest goes first and comes back last, so a cache that was cut off is none.
    """
    spark = examples.sparkSession
    old = read_manifest(spark, path)
    counts = {r.category_id: r.n for r in examples.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a category
    kept = {} if old is None else {c.id: c["count"] for c in old.categories}
    _delete(spark, f"{path}/manifest")
    columns = ["category_id", "ex_no", "clause", "question", "evidence"]
    examples.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category_id").json(f"{path}/examples")
    row = (CACHE_VERSION, source, only, sorted((kept | counts).items()))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str):
    """The manifest's row, null if there is none of this version."""
    if not is_written(spark, f"{path}/manifest"):
        return None
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    return row if row is not None and row.version == CACHE_VERSION else None


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached examples of the manifest's categories; None, a miss, without a manifest of this version or without any example."""
    manifest = read_manifest(spark, path)
    full = [c.id for c in manifest.categories if c["count"]] if manifest else []
    if not full:
        return None
    return spark.read.schema(EXAMPLE).json(f"{path}/examples").filter(F.col("category_id").isin(full))


def cached_examples(spark: SparkSession, path: str, build, **how) -> DataFrame:
    """The cache, or what build() gives, which is then cached."""
    found = read_cache(spark, path)
    if found is None:
        write_cache(build(), path, **how)
        found = read_cache(spark, path)
    return found if found is not None else spark.createDataFrame([], EXAMPLE)


def taxonomy_gaps(requested: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Requested ids (id) that the taxonomy lacks, once each in order of id."""
    return requested.select("id").distinct().join(taxonomy.select("id"), "id", "left_anti").orderBy("id")

