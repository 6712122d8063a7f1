"""What the operators over many lines don't do twice, and that they give the same."""

from pyspark.sql import functions as F

from pactlens.functions import headings as hd
from pactlens.functions import text as tx
from pactlens.operators import annotate, layout, structure, windows
from pactlens.operators import findings as fo

#: What title_case() and normalize() leave in a plan.
TITLES, CLEANED = r"[^\\p{L}]+", "translate("


def plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_pages_are_told_without_headings_parts(spark):
    texts = ["RECITALS", "\u00a0- a bullet that goes on for a while \u2003", "12. Notices", "- 3 -", "o it", "A sentence ends.", "", None, "(123] x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    told = layout.line_kinds(rows)
    assert {r["doc_id"]: (r["kind"], r["ends"]) for r in told.collect()} == {0: ("HEAD", False), 1: ("BUL", False), 2: ("HEAD", False), 4: ("BUL", False), 5: ("TXT", True), 8: ("BUL", False)}
    assert TITLES not in plan(told)


def test_bare_texts_are_stripped_texts(spark):
    texts = ["", " ", "a", " a", "a\u00a0", "\u2003\u00e9\t", "~", "!", "\x7f", "\u00e9", "a b ", "\u3000x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [t for t, got in rows.select("t", tx.bare(F.col("t")).alias("b")).collect() if got != (t or "").strip(tx.BLANKS)] == []


def test_garbage_leaves_without_a_join(spark):
    rows = spark.createDataFrame([(1, 0, "By: /s/ Jane Poe", 7), (1, 1, "It stays as it is", 8), (1, 2, "RECITALS", 9), (None, 0, "It has no document", 1)], "doc_id int, idx int, text string, page int")
    kept = structure.drop_garbage(rows)
    assert [(r["idx"], r["page"], r["heading"] and r["heading"]["title"] is None) for r in kept.orderBy("idx").collect()] == [(1, 8, None), (2, 9, True)]
    assert "Join" not in plan(kept)


def test_signs_are_told_alike_from_every_form(spark):
    texts = ["Attn: Us and all of them", "Date: 01/02/1998", "12 March 1998", "January 3, 1998", "Signed /S/ by the one who signs", "Jane Poe Smith", "Jane Poe, President", "Northfield, Illinois 60093 Attn: x",
             "Paris Texas on 1/2/1998", "ab cd", "Print name: Ann", "The rent is due on 1/2/1998 as agreed", "1.1 By him", "Jane is here now", "RECITALS", "a", "on a date", "", "E-mail: x y z", "Name: _ _ _", "1/2/98"]
    t, n, date = F.col("t"), F.size(tx.words(F.col("t"))), hd.ANY_DATE
    names = F.size(F.filter(tx.words(t), lambda x: x.rlike("^[A-Z][a-z]+$")))
    dated = n.between(2, 8) & t.rlike(rf"(?i)\b{date}\b") & (names >= 2) & (names >= n * 0.6)
    every = t.rlike(hd.ADDRESS) | t.rlike(hd.LABELLED) | (n <= 2) | t.rlike(hd.NAME_ONLY) | t.rlike("(?i)/s/") | t.rlike(rf"(?i)^{date}$") | dated | t.rlike(hd.FORM_LINE)
    rows = spark.createDataFrame([(x, h) for x in texts for h in (True, False)], "t string, h boolean")
    got = rows.select("t", "h", hd.signs(t, F.col("h"), n).alias("got"), ((F.length(t) >= 3) & ~F.col("h") & ~t.rlike(r"^[0-9]+(?:\.[0-9]+)+") & every).alias("want")).collect()
    assert [(r["t"], r["h"]) for r in got if r["got"] != r["want"]] == [] and 10 <= sum(r["want"] for r in got) < len(texts)


def test_places_are_halved_as_often_as_they_need(spark):
    rows = spark.createDataFrame([([0, 2, 4, 6, 8, 10, 12], n) for n in range(15)], "sums array<long>, least long")
    found = rows.select("least", windows.first_from(F.col("sums"), F.lit(0), F.size("sums"), F.col("least")).alias("at"))
    assert [(r["least"], r["at"]) for r in found.collect()] == [(n, -(-n // 2)) for n in range(15)]
    assert "31" not in plan(found)


def test_triggers_near_edges(spark):
    rows = spark.createDataFrame([("unless " + "x" * 60,), ("x" * 60 + " Except",), ("x" * 30,), (None,)], "t string").select(tx.trigger_edges(F.col("t")).alias("e"))
    assert [tuple(r["e"]) for r in rows.collect()] == [(True, False), (False, True), (False, False), (False, False)]


def test_quotes_are_located_up_to_a_tier(spark):
    paras = spark.createDataFrame([(1, 0, "The Tenant must   pay the rent in full on each day."), (1, 1, "No pets are allowed here"), (1, 2, "or in the garden."), (2, 0, "x")], "doc_id int, idx int, text string")
    quotes = [(1, 1, "must   pay"), (1, 2, "the tenant MUST pay the rent in full"), (1, 3, "allowed here\n\nor in"), (1, 4, "allowed here or in"), (1, 5, "nowhere to be found at all")]
    q = spark.createDataFrame([(*x, 0, 9) for x in quotes], "doc_id int, quote_id int, quote string, lo int, hi int")
    every = sorted((r.quote_id, r.tier, r.idx) for r in fo.locate(q, paras).collect())
    assert every == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 1)]
    for n in (1, 2):
        assert sorted((r.quote_id, r.tier, r.idx) for r in fo.locate(q, paras, n).collect()) == every[:n]
    assert plan(fo.locate(q, paras, 1)).count(CLEANED) < plan(fo.locate(q, paras, 2)).count(CLEANED)
    assert plan(fo.locate(q, paras)).count("LeftSemi") == 0


def test_hints_put_a_text_in_small_letters_once(spark):
    rows = spark.createDataFrame([(1, 0, "An AUDIT."), (1, 1, "nothing"), (1, 2, None)], "doc_id int, idx int, text string")
    kept = fo.hinted(rows, fo.CUES)
    assert [r["idx"] for r in kept.collect()] == [0] and plan(kept).count("lower(") == 1


def test_highlights_put_a_text_in_small_letters_once(spark):
    rows = spark.createDataFrame([(1, 0, "The Supplier may charge a fee, and the SUPPLIER may not.")], "doc_id int, idx int, text string")
    found = spark.createDataFrame([(1, 0, 1, "a", " supplier may "), (1, 0, 2, "b", "Customer")], "doc_id int, idx int, seq int, finding_id string, quote string")
    shown = annotate.highlight_paragraphs(rows, found)
    assert [[(r["start"], r["end"], r["id"]) for r in row["ranges"]] for row in shown.collect()] == [[(4, 16, "a"), (39, 51, "a")]]
    joins = [x for x in plan(shown).splitlines() if "Join" in x]
    assert joins and not any("lower(" in x for x in joins)
