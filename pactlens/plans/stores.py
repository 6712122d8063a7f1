"""Queries on job rows, uploads and few-shot texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.operators import fewshot
from pactlens.plans import duck as d
from pactlens.plans.catalog import query, table
from pactlens.sources import store
from pactlens.sources.contracts import contracts


def job_rows(spark, sf_dir) -> DataFrame:
    """A log of two schemas: rows of odd events are of an older one, without progress and filename; rows set some columns only."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("updated_at"), "event_type", "value")
    status = F.when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "done")
    old = e.filter("event_id % 2 = 1").select("event_id", "job_id", "updated_at", status.alias("status"))
    progress = F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("int"))
    new = e.filter("event_id % 2 = 0").select("event_id", "job_id", "updated_at", status.alias("status"), progress.alias("progress"), F.when(F.col("event_type") == "signup", F.concat(F.lit("f"), "event_id")).alias("filename"))
    return old.unionByName(new, allowMissingColumns=True)


@query("""WITH r AS (SELECT event_id, user_id AS job_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'done' END AS status,
    CASE WHEN event_id % 6 = 0 THEN floor(value)::INTEGER END AS progress, CASE WHEN event_id % 2 = 0 AND event_type = 'signup' THEN 'f' || event_id END AS filename FROM events)
  SELECT job_id, max(ts) AS updated_at, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL) AS progress,
    arg_max(filename, (ts, event_id)) FILTER (filename IS NOT NULL) AS filename FROM r GROUP BY job_id""")
def job_table(spark, sf_dir):
    return store.current_jobs(job_rows(spark, sf_dir), "event_id")


@query(f"""WITH {d.CONTRACTS}, u AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'a/b.doc' WHEN doc_id % 6 = 1 THEN 'x.PDF' ELSE 'y.v.txt' END AS path, doc_id % 5 * 1000000 AS size, CASE WHEN doc_id % 7 > 0 THEN text ELSE chr(160) END AS text,
    len(string_split(text, chr(10))) AS n FROM contracts)
  SELECT doc_id, CASE WHEN path = 'a/b.doc' THEN 'type' WHEN size > 3 * 1048576 THEN 'size' WHEN {d.strip('text')} = '' THEN 'empty' WHEN n > 24 THEN 'paragraphs' END AS error FROM u""")
def upload_errors(spark, sf_dir):
    k = F.col("doc_id")
    docs = contracts(spark, sf_dir).select(
        "doc_id", F.when(k % 6 == 0, "a/b.doc").when(k % 6 == 1, "x.PDF").otherwise("y.v.txt").alias("path"), (k % 5 * 1_000_000).alias("size"),
        F.when(k % 7 > 0, F.col("text")).otherwise(" ").alias("text"), F.size(F.split("text", "\n")).alias("paragraph_count"),
    )
    return docs.select("doc_id", store.upload_errors(docs, max_megabytes=3, max_paragraphs=24).alias("error"))


def labelled_lines(spark, sf_dir) -> DataFrame:
    """A text for each brand: its parts are categories, labels, rules and lines by their keys."""
    k = F.col("p_partkey") % 7
    label = F.when(F.col("p_partkey") % 29 == 0, F.concat(F.lit(" CATEGORY: "), "p_type")).when(k == 1, "[TRUE POSITIVE]").when(k == 2, F.concat(F.lit("[HARD NEGATIVE #"), F.col("p_size").cast("string"), F.lit("] ")))
    text = label.when(k == 3, "-----").when(k == 4, "BORDERLINE NOTES").when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("line_no"), text.alias("text"))


@query(f"""WITH l AS (SELECT p_brand AS doc_id, p_partkey AS line_no, p_partkey % 7 AS k, CASE WHEN p_partkey % 29 = 0 THEN {d.strip('p_type')} END AS named,
    CASE WHEN p_partkey % 29 = 0 THEN 'cues' WHEN p_partkey % 7 = 1 THEN 'positive' WHEN p_partkey % 7 = 2 THEN 'negative' WHEN p_partkey % 7 = 4 THEN 'notes' END AS label, p_size,
    CASE WHEN p_partkey % 7 <> 3 AND p_partkey % 11 <> 0 THEN {d.strip('p_name')} END AS text FROM part),
  r AS (SELECT *, last_value(named IGNORE NULLS) OVER w AS category, last_value(label IGNORE NULLS) OVER w AS kind,
    last_value(CASE WHEN label IS NOT NULL THEN CASE WHEN label = 'negative' THEN p_size ELSE -1 END END IGNORE NULLS) OVER w AS number, count(label) OVER w AS block FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
  SELECT doc_id, category, kind, nullif(number, -1)::INTEGER AS number, block::INTEGER AS block, string_agg(text, chr(10) ORDER BY line_no) AS text FROM r
  WHERE label IS NULL AND category IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, category, kind, number, block""")
def fewshot_blocks(spark, sf_dir):
    return fewshot.example_blocks(labelled_lines(spark, sf_dir))
