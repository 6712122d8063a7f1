"""Expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from pactlens.functions import findings as fn
from pactlens.functions import headings as hd
from pactlens.functions import text as tx
from pactlens.operators.annotate import wrap
from pactlens.operators.segment import pack_sentences, split_inline


def values(spark, texts, f, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}").coalesce(1)
    return [r[0] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_normalize(spark):
    cases = {
        None: "", "": "", "a\r\nb\rc\fd;": "a\nb\nc\nd;", "x\n  Page - 3 -  \ny": "x\n\ny", "- 11 -\nok": "ok", "foo Page -9- bar": "foo bar",
        "a   \nb": "a\nb", "a\n\n\n\nb": "a\n\nb", "a■b\x07c": "a b c", "e\u0301x": "e x", "a\u037eb": "a;b", "  \xa0hi　": "hi", "\U0001f600 z": "\U0001f600 z",
    }
    assert values(spark, list(cases), tx.normalize) == list(cases.values())


def test_tokens_and_ratios(spark):
    assert values(spark, [None, "  ", "a", "abcd", "abcde"], tx.token_estimate) == [0, 0, 1, 1, 2]
    assert values(spark, ["ABc1", "12"], tx.upper_ratio) == [pytest.approx(2 / 3), 0.0]
    assert values(spark, ["Big bad Wolf A", ""], tx.title_ratio) == [0.5, 0.0]
    assert values(spark, ["o'neil AND sons", "ßx"], tx.title_case) == ["O'Neil And Sons", "Ssx"]


def test_slug_and_labels(spark):
    assert values(spark, ["Rent & Fees!", "__", None, "A  b"], tx.slug) == ["rent_and_fees", "unknown", "unknown", "a_b"]
    assert values(spark, [" Category: X ", "x"], lambda c: tx.without_label(c, "category")) == ["X", "x"]
    assert values(spark, ["Audit – Rights - all", "Non-Compete"], tx.short_label) == ["audit", "non"]
    assert values(spark, ["a/b c.pdf", "///", None], lambda c: tx.upload_name(F.lit("j"), c)) == ["j__ab c.pdf", "j__upload.pdf", "j__upload.pdf"]


def test_trigger_edges(spark):
    got = values(spark, ["unless " + "x" * 93, "x" * 93 + " unless", "x" * 50, None], tx.trigger_edges)
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, False)]


HEADINGS = {
    "1. PAYMENT TERMS": (2, "1", "PAYMENT TERMS"), "ARTICLE IV DEFINITIONS": (0, "Article Iv", "DEFINITIONS"), "SECTION 3 - Fees": (1, "Section 3", "Fees"),
    "CLAUSE 7: Term": (1, "Clause 7", "Term"), "§ 4 Liability": (1, "§ 4", "Liability"), "12.": (2, "12", None), "1(a) Rent": (3, "1(a)", "Rent"),
    "RIGHT OF WAY": (1, "Right Of Way", None), "General Provisions Here": (1, "General Provisions Here", None),
    "Section 5.1 Scope": None, "SECTION 10, OR THE": None, "5.1 Scope": None, "12": None, "30 days after notice": None, "98004 51054": None,
    "Joseph Marino": None, "Jane Poe, President": None, "Attn: Bob Stone Here": None, "The Tenant shall pay.": None, "AB1 2CD": None,
    "Flat 4 High Street": None, "Mr. Jones Pays Rent": None, "Account Holder: Ashwick": None, "1. The tenant shall pay": None, "": None, None: None, "x" * 161: None,
}


def test_headings(spark):
    got = values(spark, list(HEADINGS), hd.parse_heading)
    assert [(r["level"], r["label"], r["title"]) if r else None for r in got] == list(HEADINGS.values())


def test_signatures(spark):
    cases = {
        "By: /s/ X": True, "Jane Poe, President": True, "12 March 1998": False, "Northfield, Illinois 60093": True, "Email: a@b": True, "two words": True,
        "Date: 01/02/1998": True, "Jane Poe 01/02/1998": True, "Name: ____": True, "2.4. Prices. are set": False, "1. FEES": False, "ab": False,
        "The rent is due on the first day": False, None: False,
    }
    assert values(spark, list(cases), hd.is_signature) == list(cases.values())


def test_references(spark):
    cases = {"Consumer Rights Act 2015, sections 62-68": True, "UK common law on penalties": True, "UCTA 1977": True, "Any Odd Act": True, "HA 1988": True, "Made up rule": False, "": False, None: False}
    assert values(spark, list(cases), fn.is_valid_reference) == list(cases.values())


def test_coercion(spark):
    assert values(spark, ["VOID", " invalid", "x", None], fn.consequence) == ["Void", "Invalid", "Nothing", "Nothing"]
    assert values(spark, ["penalty", "failure of obligations", None], fn.risk) == ["Penalty", fn.LATE, "Nothing"]
    assert values(spark, ["audit RIGHTS", "Termination at convenience", "Else "], fn.red_flag) == ["Audit Rights", "Termination For Convenience", "Else"]
    assert values(spark, [None, 0, 1, 2, 3], fn.severity, "int") == ["medium", "medium", "medium", "high", "high"]


def test_parse_findings(spark):
    raw = ['x {"findings":[{"category":"audit rights","evidence":"q","risk_assessment":{"severity_of_consequences":"9"}}]} y', "none", '{"findings":[]}', '{"broken"', None]
    got = values(spark, raw, fn.parse_findings)
    assert got[0][0]["category"] == "Audit Rights" and got[0][0]["quote"] == "q" and got[0][0]["severity_of_consequences"] == 3
    assert [len(x) if x is not None else 0 for x in got] == [1, 0, 0, 0, 0]


def test_quotes_intersect(spark):
    pairs = [
        ("Company may terminate", "company  may TERMINATE this Agreement", True, True), ("the Company may terminate", "Company may terminate this Agreement", True, True),
        ("any price changes here", "Uncapped liability clause", False, False), ("alpha bravo charlie one", "charlie two bravo three alpha", True, False), ("", "x", False, False),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(pairs)], "i int, a string, b string").coalesce(1)
    got = rows.select("i", fn.quotes_intersect(F.col("a"), F.col("b")).alias("l"), fn.quotes_intersect(F.col("a"), F.col("b"), True).alias("s")).orderBy("i").collect()
    assert [(r.l, r.s) for r in got] == [(x, y) for *_, x, y in pairs]


def fitted(part, at, width):
    """Lines of a text without line feeds: all of it if it fits, else up to the last blank that leaves something, else a full line."""
    if len(part) <= width:
        return [(part, at, at + len(part))]
    cut = max(part[:width].rfind(" "), 0) or width
    return [(part[:cut], at, at + cut), *fitted(part[cut:], at + cut, width)]


def wrapped(text, width):
    parts = text.split("\n")
    ends = [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
    lines = [x for p, at in zip(parts, ends) for x in fitted(p, at, width)]
    return lines if parts[-1] else lines[:-1]  # nothing follows the last line feed


def test_wrap(spark):
    import random

    rng = random.Random(1)
    texts = ["", "a", "\n", "a\n\nb\n", "x" * 30] + ["".join(rng.choices("ab  \n", k=rng.randint(1, 60))) for _ in range(150)]
    got = values(spark, texts, lambda c: wrap(c, 8))
    assert [[tuple(x) for x in r] for r in got] == [wrapped(t, 8) for t in texts]


def test_pack_and_split(spark):
    assert values(spark, ["One. Two. Three.", "short"], lambda c: pack_sentences(c, 10)) == [["One. Two.", "Three."], ["short"]]
    assert values(spark, ["4 FEES AND COSTS These are due on time now", "plain text"], split_inline)[1] == ["plain text"]
