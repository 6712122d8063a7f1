"""Job logs, ingest, expiry as a stream, cancelling, and the few-shot cache."""

import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from pactlens.operators.fewshot import example_blocks
from pactlens.plans import catalog
from pactlens.plans.analyze import analyze
from pactlens.sources import store
from pactlens.streaming import jobs
from pactlens.streaming.ingest import batch_results, ingest

SF = "/root/testdata/sf0.001"
EX = "category_id string, ex_no int, clause string, question string, evidence string"


def test_a_log_of_two_schemas_is_one_table(spark, tmp_path):
    path = str(tmp_path / "log")
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(4)]
    store.append_jobs(spark.createDataFrame([("a", t[0], "queued"), ("b", t[0], "queued"), ("a", t[2], None)], "job_id string, updated_at timestamp, status string"), path)
    store.append_jobs(spark.createDataFrame([("a", t[1], "running", 50), ("b", t[3], None, 7)], "job_id string, updated_at timestamp, status string, progress int"), path)
    want = {("a", t[2], "running", 50), ("b", t[3], "queued", 7)}
    now = store.current_jobs(store.read_jobs(spark, path))
    assert {(r.job_id, r.updated_at, r.status, r.progress) for r in now.collect()} == want
    store.compact_jobs(spark, path, str(tmp_path / "new"))
    assert {(r.job_id, r.updated_at, r.status, r.progress) for r in store.read_jobs(spark, str(tmp_path / "new")).collect()} == want


LEASE = "1. FEES\nThe landlord may charge any fee it likes to the tenant.\n\n2. END\nThe landlord may terminate this lease at any time as it sees fit."


def test_ingest_works_off_each_batch_once(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(LEASE)
    (tmp_path / "in" / "b.txt").write_text(" \n ")
    (tmp_path / "in" / "c.doc").write_text(LEASE)
    ingest(spark, inbox, out, checkpoint).awaitTermination()
    rows = {r.filename.rsplit("/", 1)[1]: r for r in store.committed_jobs(spark, out).collect()}
    assert {(n, r.status, r.error) for n, r in rows.items()} == {("a.txt", "done", None), ("b.txt", "failed", "empty"), ("c.doc", "failed", "type")}
    assert rows["a.txt"].paragraph_count == 4 and rows["a.txt"].estimated_minutes >= 1
    result = json.loads(store.result_of(spark, out, rows["a.txt"].job_id))
    assert result["summary"]["high"] == 2 and len(result["findings"]) == 2
    with pytest.raises(store.NotFinished):
        store.result_of(spark, out, rows["b.txt"].job_id)
    with pytest.raises(store.NotFound):
        store.result_of(spark, out, "nobody")
    # a later file is a batch of its own; what was done stays
    (tmp_path / "in" / "d.txt").write_text(LEASE)
    ingest(spark, inbox, out, checkpoint).awaitTermination()
    assert store.committed_jobs(spark, out).count() == 4 and store.committed_results(spark, out).count() == 2


def test_a_replayed_batch_changes_nothing_and_a_broken_one_is_hidden(spark, tmp_path):
    out = str(tmp_path)
    docs = spark.createDataFrame([("x", "x.txt", 10, LEASE), ("y", "y.txt", 3_000_000, LEASE), ("z", "z.txt", 9, LEASE + "\n\n" + "\n\n".join(f"Line {i} says no more than this." for i in range(9)))], "doc_id string, path string, size long, text string")
    results, rows = batch_results(docs, lambda d: analyze(d, keep=lambda df: df.persist()), max_megabytes=2, max_paragraphs=8)
    results, rows = results.persist(), rows.persist()
    assert {(r.job_id, r.status, r.error) for r in rows.collect()} == {("x", "done", None), ("y", "failed", "size"), ("z", "failed", "paragraphs")}
    assert store.commit_results(results, rows, out, 0)
    before = store.committed_jobs(spark, out).first().updated_at
    assert not store.commit_results(results, rows, out, 0)
    assert store.committed_jobs(spark, out).first().updated_at == before
    results.write.parquet(f"{out}/results/batch=1")  # its job rows were never written
    assert store.committed_results(spark, out).count() == 1
    assert store.commit_results(results, rows, out, 1) and store.committed_results(spark, out).count() == 2


def drain(df, name):
    run = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    run.processAllAvailable()
    run.stop()
    return df.sparkSession.table(name).collect()


def test_expiry_as_a_stream_equals_the_query(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(jobs.stream_expiry(jobs.job_log(stream)), "expired_jobs")
    assert {r.job_id for r in got} == {r.job_id for r in catalog.job_ttl(spark, SF).collect()} and len(got) == len({r.job_id for r in got}) > 0
    latest = {r.job_id: r.updated_at for r in catalog.job_current_state(spark, SF).collect()}
    assert all(r.updated_at == latest[r.job_id] for r in got)


def test_late_events_don_t_bring_a_job_back(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "job_id long, ts timestamp"
    files = [[(1, day), (2, day)], [(2, day + dt.timedelta(hours=30))], [(3, day + dt.timedelta(hours=30))], [(1, day + dt.timedelta(hours=1)), (2, day + dt.timedelta(hours=31))], [(3, day + dt.timedelta(hours=32))]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(jobs.stream_expiry(stream, hours=24), "late_jobs")
    assert [(r.job_id, r.updated_at) for r in got] == [(1, day)]


def test_a_cancelled_job_stops(spark):
    failed = []

    def work():
        try:
            jobs.run_tagged(spark, "j1", spark.range(0, 10**13, 1, 2).filter("hash(id) = 0 AND hash(id + 1) = 0").count)
        except Exception as e:  # noqa: BLE001
            failed.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    time.sleep(4)
    began = time.monotonic()
    jobs.cancel(spark, "j1")
    t.join(40)
    assert failed and "cancel" in failed[0].lower() and time.monotonic() - began < 30


def test_cache_hit_miss_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert store.read_cache(spark, path) is None
    rows = lambda *ids: spark.createDataFrame([(i, k, "clause “a”", "q", "a") for i in ids for k in (1, 2)], EX)
    asked = []
    build = lambda: asked.append(1) or rows("007", "b")
    first = store.cached_examples(spark, path, build, source="s").collect()
    again = store.cached_examples(spark, path, build).collect()
    assert len(asked) == 1 and sorted(first) == sorted(again) and {r.category_id for r in again} == {"007", "b"} and again[0].clause == "clause “a”"
    store.write_cache(rows("b", "c").filter("ex_no = 1"), path)
    got = sorted((r.category_id, r.ex_no) for r in store.read_cache(spark, path).collect())
    assert got == [("007", 1), ("007", 2), ("b", 1), ("c", 1)]  # only the categories at hand were rewritten
    # another version, an empty cache and one that was cut off are misses
    old = spark.createDataFrame([("fewshot_v1", "", None, [])], store.MANIFEST)
    old.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    assert store.read_cache(spark, path) is None
    store.write_cache(spark.createDataFrame([], EX), str(tmp_path / "none"))
    assert store.read_cache(spark, str(tmp_path / "none")) is None
    assert store.cached_examples(spark, str(tmp_path / "none"), lambda: spark.createDataFrame([], EX)).count() == 0


def test_blocks_of_a_text(spark):
    text = ["intro", "CATEGORY: Deposits", "-----", "cue one", "", "[TRUE POSITIVE]", "TEXT:", "kept", "[HARD NEGATIVE #2]", None, "fair", "CATEGORY: Fees", "[HARD NEGATIVE #1]", "BORDERLINE NOTES (x)", "note"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id int, line_no int, text string")
    got = sorted((r.block, r.category, r.kind, r.number, r.text) for r in example_blocks(lines).collect())
    assert got == [(1, "Deposits", "cues", None, "cue one"), (2, "Deposits", "positive", None, "TEXT:\nkept"), (3, "Deposits", "negative", 2, "fair"), (6, "Fees", "notes", None, "note")]


def test_gaps_of_a_taxonomy(spark):
    asked, known = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["c", "a", "c", "b"], ["b"]))
    assert [r.id for r in store.taxonomy_gaps(asked, known).collect()] == ["a", "c"]
