"""What larger tables need: documents dealt once, before their texts are made, and calls made once a row."""

import json
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pactlens.functions import findings as fn
from pactlens.functions import headings as hd
from pactlens.functions.text import strip
from pactlens.operators import classifiers as cl
from pactlens.operators import findings as fo
from pactlens.operators import annotate, fewshot, layout, repair, segment
from pactlens.plans import models

SMALL = "/root/testdata/sf0.001"
QUICK = cl.Policy(attempts=1, pause=0.0, concurrency=4)


def dealt_by(found) -> list[str]:
    """The keys of the plan's hash exchanges, without the numbers of columns."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


@pytest.mark.parametrize("name", ["annotation_lines", "highlight_render", "page_merge", "layout_blocks", "dedupe_full", "classifier_prompts", "section_path", "garbage_filter", "line_segmentation", "quote_locate_cascade"])
def test_texts_are_not_dealt(spark, name):
    keys = dealt_by(entry.queries()[name](spark, SMALL))
    assert keys and not [k for k in keys if k.startswith(("doc_id", "_groupingexpression"))]


def test_answers_are_made_in_several_tasks(spark):
    made = models.answers(spark, SMALL)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_router_and_classifier_are_called_once_a_row(spark):
    asked, told = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def router(row, attempt):
        asked.add(1)
        return json.dumps({"candidate_categories": [{"category": c} for c in ("B", "a", "A", "c", None, "") if row["id"] != 2]})

    def classifier(row, attempt):
        told.add(1)
        return json.dumps({"findings": [{"category": c["id"], "quote": ",".join(sorted(row))} for c in row["categories"]]})

    taxonomy = spark.createDataFrame([("a", "A", ""), ("b", "B", "")], "id string, name string, description string")
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "id int, text string")
    done = cl.classify_two_stage(cl.route_with(rows, ["id"], router, taxonomy, policy=QUICK), classifier, taxonomy, policy=QUICK)
    got = {r["id"]: r for r in done.collect()}
    assert [got[0]["routed"], got[2]["routed"]] == [["b", "a"], []]
    assert [got[0]["attempts"], got[2]["attempts"], got[2]["findings"]] == [1, 0, []]
    assert got[0]["findings"][0]["quote"] == "categories,id,route_error,routed,text"
    assert (asked.value, told.value) == (5, 4)


def test_rows_to_mend_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "a b c", "a b"), (2, "a b c", "a x")], "id int, text string, quote string").mapInArrow(seen, "id int, text string, quote string")
    got = {r["id"]: r for r in repair.repair_quotes(rows, lambda r, n: json.dumps({"quote": "a b"}), policy=QUICK).collect()}
    assert (got[1]["repair"], got[2]["quote"], got[2]["repair"]["matched"]) == (None, "a b", True)
    assert read.value == 2


def test_snippet_begins_behind_a_line_feed(spark):
    rows = spark.createDataFrame([("word\nquote",)], "c string")
    assert rows.select(fewshot.snippet(F.col("c"), F.lit(5), F.lit("quote"), 0)).first()[0] == "quote"


def test_findings_that_a_paragraph_lacks_are_not_gathered(spark):
    """Lines meet their findings one by one, and what a line shows is compared before anything is collected."""
    paragraphs = spark.createDataFrame([(1, 0, "one ΑΣΑ Fee and fee five"), (1, 0, "fee five"), (None, 1, None)], "doc_id long, idx int, text string")
    asked = spark.createDataFrame([(1, 0, i, i, q) for i, q in enumerate(["FEE FIVE ", "nothing", "fee", None, "one ΑΣ"])], "doc_id long, idx int, seq int, finding_id int, quote string")
    found = annotate.highlight_paragraphs(paragraphs, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and "Contains" in x]
    got = sorted((r["html"], [(x["start"], x["id"]) for x in r["ranges"]]) for r in found.collect())
    span = '<span class="hl" data-finding-id="{}">{}</span>'
    assert got == [("", []), (span.format(0, "fee five"), [(0, "0")]), (span.format(4, "one ΑΣ") + "Α Fee and " + span.format(0, "fee five"), [(0, "4"), (16, "0")])]


def test_words_of_pages_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    kind = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double"
    rows = [(1, p, w, 10.0 + 30 * k, 35.0 + 30 * k, 20.0, 30.0) for p in (1, 2, 3) for k, w in enumerate(("goes", "on"))]
    words = spark.createDataFrame(rows, kind).mapInArrow(seen, kind)
    pages = spark.createDataFrame([(1, p, 100, 100) for p in (1, 2, 3)], "doc_id long, page int, width int, height int")
    got = layout.layout_paragraphs(words, pages).collect()
    assert [(r["paragraph_index"], r["page"], r["text"], r["bbox"]) for r in got] == [(0, 1, "goes on goes on goes on", None)]
    assert read.value == len(rows)


def test_quotes_are_cleaned_once_for_a_comparison(spark):
    rows = spark.createDataFrame([("The  Supplier may charge fees", "may charge fees at will"), ("ab", "cd"), ("", "x")], "a string, b string")
    found = rows.select(fn.quotes_intersect(F.col("a"), F.col("b")).alias("r"))
    assert [r["r"] for r in found.collect()] == [True, False, False]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2


def test_hints_leave_no_finding_out(spark):
    texts = ["You may TERMINATE at ANY time. Or not.", "Without any CAP.", "nothing", None, "An Audit.", "No refund: NOT refundable"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("idx", F.lit(0))
    bare = tuple(replace(c, hints=()) for c in fo.CUES)
    got, every = (sorted(map(tuple, fo.classify(rows, cues).collect())) for cues in (fo.CUES, bare))
    assert got == every and len(got) == 4


def test_headings_are_told_alike_with_and_without_their_parts(spark):
    lines = ["SUPPLY AGREEMENT", "1. PAYMENT TERMS", "1.1 Of Terms", "1.", "7", "2) a b", "3(a) Title: x", "Section 2: of the goods and the others", "section 4", "SECTION 5, of", "Clause 3.1 X", "§ 4 Law.", "ARTICLE IV All is of no use here at all",
             "Audit Rights And Records", "All of Us", "One of the two and of the Three Four Five Six Seven Eight Nine", "Name: of", "Heading Of:", "A; B", "A, B, C", "ÉTAT DES LIEUX", "état Des Lieux", "IT IS OVER.", "Attn: Us", "AB1 2CD", "You Must Pay", "", " ", "X" * 161]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(strip(F.col("t")).alias("t"))
    got = rows.select("t", hd.is_heading(F.col("t")).alias("is"), hd.parse_heading(F.col("t")).isNotNull().alias("parsed")).collect()
    assert [r["t"] for r in got if r["is"] != r["parsed"]] == [] and 8 <= sum(r["is"] for r in got) < len(lines) - 8


def test_rules_of_continuations_are_asked_once(spark):
    rows = spark.createDataFrame([(1, 0, "Goods from the"), (1, 1, "Supplier:"), (1, 2, "it ends."), (1, 3, "x")], "doc_id long, idx int, text string")
    found = segment.merge_continuations(rows)
    assert [(r["idx"], r["text"]) for r in found.orderBy("idx").collect()] == [(0, "Goods from the Supplier:"), (1, "it ends."), (2, "x")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count(segment.BEFORE_THE) <= 2
