"""Operators against plain walks over random rows, and the registered queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlens.operators import findings as fo
from pactlens.operators import merging, segment, structure, windows
from pactlens.plans import catalog, models, pages  # noqa: F401  models and pages register their queries
from pactlens.plans.analyze import analyze

SF = "/root/testdata/sf0.001"


def test_section_paths_equal_a_stack(spark):
    rng = random.Random(2)
    lines = ["ARTICLE II GOODS", "SECTION 3 Fees", "CLAUSE 4 Term", "5. Notices", "6(a) Rent", "plain words that say nothing of note"]
    docs = [[rng.choice(lines) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = spark.createDataFrame([(d, i, t) for d, doc in enumerate(docs) for i, t in enumerate(doc)], "doc_id int, idx int, text string")
    got = {(r.doc_id, r.idx): (r.path, r.heading) for r in structure.section_paths(structure.with_headings(rows)).collect()}
    for d, doc in enumerate(docs):
        stack = []
        for i in range(len(doc)):
            h = got[d, i][1]
            if h:
                while stack and stack[-1]["level"] >= h["level"]:
                    stack.pop()
                stack.append(h)
            parts = [p for h in stack for p in (h["label"], h["title"]) if p]
            assert got[d, i][0] == " > ".join(p for k, p in enumerate(parts) if not k or parts[k - 1].lower() != p.lower())


def test_windows_equal_a_walk(spark):
    rng = random.Random(3)
    docs = [[rng.choice([0, 5, 40, 120, 400]) for _ in range(rng.randint(1, 25))] for _ in range(50)]
    rows = spark.createDataFrame([(d, 0, i, i, "x" * (4 * t), t) for d, doc in enumerate(docs) for i, t in enumerate(doc)], "doc_id int, section int, b int, idx int, text string, tokens long")
    got = {}
    for r in windows.plan_windows(rows, 300, 100, None).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for d, doc in enumerate(docs):
        upto = np.concatenate([[0], np.cumsum(doc)])
        reach = lambda at, need, upto=upto: int(np.searchsorted(upto, upto[at] + need))  # the first place with so many tokens between
        starts = [0]
        while reach(starts[-1], 100) < len(doc):
            starts.append(reach(starts[-1], 100))
        ends = np.minimum([reach(s, 300) for s in starts], len(doc))
        later = np.concatenate([[True], ends[1:] > np.maximum.accumulate(ends)[:-1]])
        assert sorted(got[d]) == [(s, int(e)) for s, e, keep in zip(starts, ends, later) if keep]


def test_garbage_runs(spark):
    docs = [
        (["1.1.1 a", "2.2 b", "3.3 c", "4.4 d", "long enough to stay here"], [4]),
        (["1.1 a", "2.2 b", "long enough to stay here"], [0, 1, 2]),
        (["1.1 a", "2.2 b", "RECITALS", "3.3 c"], [0, 1, 2, 3]),
        (["1.1 a"] * 7, [5, 6]),
        (["", "By: /s/ X", "RECITALS"], [2]),
    ]
    rows = spark.createDataFrame([(d, i, t) for d, (doc, _) in enumerate(docs) for i, t in enumerate(doc)], "doc_id int, idx int, text string")
    got = {}
    for r in structure.drop_garbage(rows).collect():
        got.setdefault(r.doc_id, []).append(r.idx)
    assert [sorted(got.get(d, [])) for d in range(len(docs))] == [w for _, w in docs]


def test_continuations(spark):
    docs = [["LIMITATION OF", "LIABILITY"], ["the fee is paid from the", "Company:"], ["It consists of:", "- a\n- b"], ["This line goes", "on here."], ["A full sentence stands here.", "Another one follows it."]]
    rows = spark.createDataFrame([(d, i, t) for d, doc in enumerate(docs) for i, t in enumerate(doc)], "doc_id int, idx int, text string")
    got = {}
    for r in segment.merge_continuations(rows).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [got[d] for d in range(5)] == [["LIMITATION OF LIABILITY"], ["the fee is paid from the Company:"], ["It consists of:\n- a\n- b"], ["This line goes on here."], docs[4]]


def test_locate_tiers(spark):
    paras = spark.createDataFrame([(1, 0, "The Tenant must   pay the rent in full on each day."), (1, 1, "No pets are allowed here"), (1, 2, "or in the garden.")], "doc_id int, idx int, text string")
    quotes = [(1, 1, "must   pay"), (1, 2, "the tenant MUST pay the rent in full"), (1, 3, "allowed here\n\nor in"), (1, 4, "allowed here or in"), (1, 5, "nowhere to be found at all"), (1, 6, "")]
    q = spark.createDataFrame([(*x, 0, 9) for x in quotes], "doc_id int, quote_id int, quote string, lo int, hi int")
    got = {r.quote_id: (r.tier, r.idx) for r in fo.locate(q, paras).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (4, 1)}


def finding(seq, idx, quote, what="w", category="c", severity="high"):
    return (1, seq, idx, category, severity, True, quote, "e", what, ["Rent Act"])


FINDING = "doc_id int, seq int, idx int, category_id string, severity string, is_unfair boolean, quote string, explanation string, what string, refs array<string>"


def test_merging(spark):
    rows = [
        finding(1, 0, "the landlord may enter at any time"), finding(2, 0, "the landlord may enter at any time"), finding(3, 0, "landlord may enter at any time without notice", "x"),
        finding(4, 9, "a deposit is kept for ever and a day", "z", "d", "low"),
    ]
    got = merging.merge_findings(spark.createDataFrame(rows, FINDING)).orderBy("seq").collect()
    assert [(r.seq, r.category_id) for r in got] == [(3, "c"), (4, "d")]


def test_summary(spark):
    rows = [finding(i, i, f"q{i}", category=c, severity=s) for i, (c, s) in enumerate([("a", "high")] * 4 + [("b", "medium")] * 2 + [("c", "low")] * 2)]
    got = {r.doc_id: r for r in fo.summarize(spark.createDataFrame(rows, FINDING), spark.createDataFrame([(1,), (2,)], "doc_id int")).collect()}
    none, r = got[2], got[1]
    assert (none.risk_score, none.high, none.medium, none.low, none.top_categories) == (0, 0, 0, 0, [])
    assert (r.risk_score, r.high, r.medium, r.low) == (100, 4, 2, 2) and [tuple(x) for x in r.top_categories] == [("a", 4), ("b", 2), ("c", 2)]


def test_oversize_split(spark):
    rows = spark.createDataFrame([([50, 50, 50, 50],), ([200, 10],), ([10, 200, 10],)], "z array<long>")
    got = [[(x.start, x.end) for x in r[0]] for r in rows.select(windows.split_oversize(F.col("z"), F.lit(0), 100)).collect()]
    assert got == [[(0, 2), (1, 3), (2, 4)], [(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 3)]]


def test_streamed_state(spark, tmp_path):
    from pactlens.streaming.jobs import stream_state

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    run = stream_state(spark, str(tmp_path / "in"), events.schema).writeStream.outputMode("complete").format("memory").queryName("jobs").start()
    run.processAllAvailable()
    run.stop()
    want = {r.job_id: (r.status, r.n) for r in catalog.job_current_state(spark, SF).collect()}
    assert {r.job_id: (r.status, r.n) for r in spark.table("jobs").collect()} == want


def test_taxonomy(spark, tmp_path):
    from pactlens.sources.contracts import read_taxonomy_csv

    (tmp_path / "t.csv").write_text('﻿id,name,description\nx,Fees,"Description: all, of them"\n,Fees & Rent,d\nx,Other,\n,,\n', "utf-8")
    got = {(r.id, r.name, r.description) for r in read_taxonomy_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("x", "Fees", "all, of them"), ("fees_and_rent", "Fees & Rent", "d"), ("x_2", "Other", "")}


def test_analysis(spark):
    text = "1. FEES\nThe landlord may charge any fee it likes to the tenant.\n\n2. END\nThe landlord may terminate this lease at any time as it sees fit.\n\nBy: /s/ X"
    out = analyze(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"))
    assert sorted((r.doc_id, r.high, r.risk_score) for r in out.summary.collect()) == [(1, 2, 40), (2, 0, 0), (3, 0, 0)]
    assert {r.category_id for r in out.findings.collect()} == {"rent_fees_prohibited_payments", "termination_for_convenience"}


FAST = ["category_slug", "category_resolve", "job_current_state", "json_extract_findings", "heading_parse", "section_path", "window_plan", "line_segmentation", "quote_locate_exact", "risk_summary", "layout_blocks", "page_merge", "json_rejects", "answer_paths", "classifier_calls", "classifier_tally", "classifier_two_stage", "best_of_attempts"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_marks_in_texts(spark):
    """A control character, or what a pattern would read as a command, is text like any other."""
    lines = spark.createDataFrame([(1, 0, "ab\x1dcd ab"), (1, 1, "a.b a\\Eb aab"), (1, 2, "none")], "doc_id int, idx int, text string")
    quotes = spark.createDataFrame([(1, 0, "x", "ab"), (1, 1, "y", "a.b"), (1, 1, "z", "a\\Eb"), (1, 2, "w", "")], "doc_id int, idx int, quote_id string, quote string")
    got = sorted((r.quote_id, r.start, r.end) for r in fo.highlight_ranges(lines, quotes).collect())
    assert got == [("x", 0, 2), ("x", 6, 8), ("y", 0, 3), ("z", 4, 8)]
    said = spark.createDataFrame([("One.  Two\x1dhalf! Three",)], "t string").select(fo.sentences(F.col("t"))).first()[0]
    assert said == ["One.", "Two\x1dhalf!", "Three"]


def test_merging_without_a_paragraph(spark):
    rows = [finding(1, None, "the landlord may enter at any time"), finding(2, 0, "landlord may enter at any time for repairs"), finding(3, None, "landlord may enter at any time without notice"), finding(4, 0, "landlord may enter at any time for repairs and more")]
    got = merging.merge_findings(spark.createDataFrame(rows, FINDING)).collect()
    assert sorted(r.seq for r in got if r.idx is None) == [1, 3] and len(got) == 3


def test_objects_in_prose(spark):
    from pactlens.functions.findings import json_object

    cases = [
        ("a { then {\"x\": 1} end", '{"x": 1}'), ('see {note} {"x": 1}', "{note}"), ('```{"a": {"b": "}"}}``` }', '{"a": {"b": "}"}}'), ('{"a": "\\"}"} {', '{"a": "\\"}"}'),
        ("no braces", None), ("{ never { closed", None), (None, None), ("", None),
    ]
    rows = spark.createDataFrame(cases, "raw string, want string").select("want", json_object(F.col("raw")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_examples_of_any_length(spark):
    from pactlens.operators.fewshot import pick_examples

    docs = spark.createDataFrame([(1, "the old house stands by the lake"), (2, "an old house stood"), (3, None), (4, "lake"), (5, "the old house stands by the lake, again")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "e old house st"), (2, "lake"), (3, "old house"), (4, ""), (5, None), (6, "no such words here"), (7, "old house stands")], "item_id int, text string")
    got = sorted((r.item_id, r.doc_id, r.k) for r in pick_examples(items, docs).collect())
    assert got == [(1, 1, 1), (1, 5, 2), (2, 1, 1), (2, 4, 2), (3, 1, 1), (3, 2, 2), (7, 1, 1), (7, 5, 2)]


def test_taxonomy_prefers_csv_and_writes_json(spark, tmp_path):
    from pactlens.sources.contracts import citations, read_taxonomy, write_taxonomy_json

    rows = [("b", "Bé", "x"), ("a", "A", None)]
    write_taxonomy_json(spark.createDataFrame(rows, "id string, name string, description string").coalesce(1), str(tmp_path / "t.json"), source="here")
    csv, missing = tmp_path / "t.csv", str(tmp_path / "none.csv")
    csv.write_text("id,name,description\nc,C,y\n")
    assert [tuple(r) for r in read_taxonomy(spark, missing, str(tmp_path / "t.json")).collect()] == [("b", "Bé", "x"), ("a", "A", "")]
    assert [r.id for r in read_taxonomy(spark, str(csv), str(tmp_path / "t.json")).collect()] == ["c"]
    with pytest.raises(FileNotFoundError):
        read_taxonomy(spark, missing, None)
    names = [spark.createDataFrame([(x,) for x in part], "name string") for part in ([" B Act", "A Act", None], ["B Act", "", "C Act"])]
    assert [r.name for r in citations(*names).collect()] == ["A Act", "B Act", "C Act"]
