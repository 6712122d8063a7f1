"""Findings of windows: routing, the cue classifier, locating quotes, merging, and the roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions.findings import MAX_REFERENCES, dedupe_key, severity, valid_references
from pactlens.functions.text import BLANK, let, match_key, normalize, slug, squeeze, strip, text_of, words


@dataclass(frozen=True)
class Cue:
    """A sentence that matches pattern, and not unless, is a finding of the category.

    hints: texts in lower case, one of which every match of pattern has in some case; none if that isn't known.
    """

    category_id: str
    pattern: str
    unless: str
    severity: int
    violation: int
    hints: tuple[str, ...] = ()


#: The default classifier's cues.
CUES = (
    Cue("termination_for_convenience", r"(?i)\bterminate\b.*\b(?:convenience|any time)\b", r"(?i)\brequired by\b", 2, 1, ("terminate",)),
    Cue("uncapped_liability", r"(?i)\b(?:unlimited|without any cap|uncapped)\b", r"(?i)\bshall not be unlimited\b", 3, 2, ("unlimited", "without any cap", "uncapped")),
    Cue("audit_rights", r"(?i)\b(?:audit|inspect)\b", r"(?i)\bauditor\b", 1, 0, ("audit", "inspect")),
    Cue("rent_fees_prohibited_payments", r"(?i)\b(?:any fee|not refundable)\b", r"(?i)\bpermitted by law\b", 2, 2, ("any fee", "not refundable")),
)


def cue_table(spark: SparkSession, cues: tuple[Cue, ...] = CUES) -> DataFrame:
    rows = [(c.category_id, c.pattern, c.unless, c.severity, c.violation) for c in cues]
    return spark.createDataFrame(rows, "category_id string, pattern string, unless string, severity int, violation int")


def sentences(text: Column) -> Column:
    return F.array_remove(F.split(text_of(text), rf"(?<=[.!?]){BLANK}+"), "")


def route(chunks: DataFrame, cues: tuple[Cue, ...] = CUES) -> DataFrame:
    """Chunks with routed, the categories that any cue hints at: high recall, exceptions are not looked at."""
    hints = F.array(*[F.when(text_of(F.col("text")).rlike(c.pattern), F.lit(c.category_id)) for c in cues])
    return chunks.withColumn("routed", F.array_distinct(F.array_compact(hints)))


def hinted(paragraphs: DataFrame, cues: tuple[Cue, ...]) -> DataFrame:
    """Paragraphs that have any cue's hint; the others match no pattern and needn't be cut into sentences. All of them if a cue has no hints."""
    if not all(c.hints for c in cues):
        return paragraphs
    hints = dict.fromkeys(h for c in cues for h in c.hints)
    # a text is put in small letters once, not for each hint
    return paragraphs.filter(let(F.lower(F.col("text")), lambda low: reduce(or_, [low.contains(h) for h in hints], F.lit(False))))


def classify(paragraphs: DataFrame, cues: tuple[Cue, ...] = CUES) -> DataFrame:
    """doc_id, idx, n, quote, category_id, severity, violation: each sentence of a paragraph under each cue that it matches.

    The cues are few and fixed, so they are an expression in one pass over the paragraphs, not a join.
    """
    said = lambda s, c: s.rlike(c.pattern) & ~s.rlike(c.unless)
    found = lambda s: F.array_compact(F.array(*[F.when(said(s, c), F.struct(F.lit(c.category_id).alias("category_id"), F.lit(c.severity).alias("severity"), F.lit(c.violation).alias("violation"))) for c in cues]))
    each = hinted(paragraphs, cues).select("doc_id", "idx", F.posexplode(sentences(F.col("text"))).alias("n", "quote"))
    return each.select("doc_id", "idx", "n", "quote", F.inline(found(F.col("quote"))))


#: What a finding recommends where its classifier says nothing, by category; fixed values.
RECOMMENDED = {
    "uncapped_liability": "Confirm whether liability is capped and whether carve-outs are acceptable.",
    "termination_for_convenience": "Assess whether termination without cause is acceptable; consider adding constraints/fees.",
    "irrevocable_or_perpetual_license": "Review whether perpetual/irrevocable rights are intended; consider term/termination limits.",
    "most_favored_nation": "Evaluate MFN obligations; consider narrowing scope and defining comparators.",
    "audit_rights": "Check audit scope, frequency, confidentiality, and cost allocation.",
}
RECOMMENDED_ELSE = "Review the clause for compliance and propose a tenant-fair revision."
CONFIDENCE = 0.8


def recommendation(category_id: Column, said: Column) -> Column:
    """What was said, else the category's default."""
    out = F
    for category, text in RECOMMENDED.items():
        out = out.when(category_id == category, F.lit(text))
    return F.coalesce(F.nullif(strip(said), F.lit("")), out.otherwise(F.lit(RECOMMENDED_ELSE)))


def grade(found: DataFrame) -> DataFrame:
    """Findings with all their fields from what classify() finds; seq is their order in the document."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "n", "category_id"))
    name = F.initcap(F.replace(F.col("category_id"), F.lit("_"), F.lit(" ")))
    refs = F.regexp_extract_all("quote", F.lit(r"((?:[A-Z][a-z]+ )+Act [0-9]{4})"), 1)
    score, text = F.col("severity"), F.lit("")
    graded = found.withColumn("seq", seq)
    return graded.select(
        "doc_id", "seq", F.concat_ws("_", F.lit("f"), "idx", "seq").alias("finding_id"), "idx", "category_id", name.alias("category_name"), severity(score).alias("severity"),
        F.lit(CONFIDENCE).alias("confidence"), (F.col("violation") > 0).alias("is_unfair"), name.alias("issue_title"), F.concat(F.lit("- "), F.col("category_id")).alias("what"),
        F.concat(F.lit("cue "), F.col("category_id")).alias("explanation"), recommendation(F.col("category_id"), text).alias("recommendation"), "quote", F.slice(valid_references(refs), 1, MAX_REFERENCES).alias("refs"),
        text.alias("possible_consequences"), score.alias("severity_of_consequences"), F.col("violation").alias("degree_of_legal_violation"),
        F.when(score >= 3, "Void").when(score == 2, "Unenforceable").otherwise("Nothing").alias("consequences_category"), F.when(score >= 2, "Penalty").otherwise("Nothing").alias("risk_category"),
        text.alias("revised_clause"), text.alias("revision_explanation"), text.alias("suggested_follow_up"),
    )


def resolve_categories(rows: DataFrame, taxonomy: DataFrame, name_col: str = "category", aliases: dict[str, str] | None = None) -> DataFrame:
    """A column category_id: by id, else by name in any case, else by alias, else the name's slug. The taxonomy is small."""
    tax = F.broadcast(taxonomy.select(F.col("id").alias("__id"), squeeze(F.col("name")).alias("__name")).dropDuplicates(["__name"]))
    by_id = F.broadcast(taxonomy.select(F.col("id").alias("__own")).distinct())
    out = rows.join(by_id, F.col(name_col) == F.col("__own"), "left").join(tax, squeeze(F.col(name_col)) == F.col("__name"), "left")
    alias = F.lit(None).cast("string")
    for name, target in (aliases or {}).items():
        alias = F.when(squeeze(F.col(name_col)) == name, F.lit(target)).otherwise(alias)
    return out.withColumn("category_id", F.coalesce("__own", "__id", alias, slug(F.col(name_col)))).drop("__own", "__id", "__name")


def _between(text: Column, quote_words: Column, n: int) -> Column:
    """What runs from the quote's first n words to its last n in the text, null if they are not there in this order."""
    low = F.lower(text)
    first = F.array_join(F.slice(quote_words, 1, n), " ")
    last = F.array_join(F.slice(quote_words, F.greatest(F.size(quote_words) - n + 1, F.lit(1)), n), " ")
    start = F.instr(low, first)
    rest = F.substring(low, start, F.length(low))
    end = F.instr(rest, last)
    cut = F.substring(text, start, end - 1 + F.length(last))
    return F.when((F.size(quote_words) >= n) & (start > 0) & (end > 1), F.regexp_replace(cut, rf"^{BLANK}+|{BLANK}+$", ""))


def locate(quotes: DataFrame, paragraphs: DataFrame, upto: int = 6) -> DataFrame:
    """quotes (doc_id, quote_id, quote, lo, hi) with tier, idx and evidence: where each is in the paragraphs lo <= idx < hi.

    Tier 1 is the quote as it stands; 2 its key in the paragraph's key (more than 20 characters), with the paragraph's own wording if
    the first and last five or three words frame half the length; 3 and 4 the quote or its key over paragraph borders; 6 its first
    seven words, framed by five and five to 60 %. The lowest tier wins, then the first paragraph. Quotes found nowhere leave, null and
    empty ones too, and those that only a tier behind `upto` finds.

    A document's paragraphs and its quotes are brought together in one row, once, so memory is linear in the document; a tier is only
    looked at for quotes that those before it left. Tier 1 asks for no keys, so with it alone none are made.
    """
    key = match_key(F.col("quote"))
    asked = quotes.filter("quote <> ''").select("doc_id", F.struct("quote_id", "quote", "lo", "hi", key.alias("key"), words(key).alias("kw")).alias("q"))
    asked = asked.groupBy("doc_id").agg(F.collect_list("q").alias("q"))
    # keys are made of columns, in two steps, so that Spark compiles them and cleans a text once
    rows = paragraphs.select("doc_id", "idx", text_of(F.col("text")).alias("text"))
    if upto > 1:
        rows = rows.withColumn("clean", normalize(F.col("text"))).withColumn("key", squeeze(F.col("clean"))).drop("clean")
    held = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*rows.columns[1:]))).alias("p"))
    return asked.join(held.hint("merge"), "doc_id").select("doc_id", F.inline(F.filter(F.transform("q", lambda q: _place(q, F.col("p"), upto)), lambda r: r["tier"].isNotNull())))


def _place(q: Column, paragraphs: Column, upto: int) -> Column:
    """struct(quote_id, tier, idx, evidence) of one quote in its part of a document, by the tiers up to `upto`."""
    kw = q["kw"]
    first = lambda here, test: F.array_position(F.transform(here, test), True).cast("int")
    told = lambda tier, idx, evidence: F.struct(q["quote_id"].alias("quote_id"), F.lit(tier).alias("tier"), idx.alias("idx"), evidence.alias("evidence"))
    none = F.struct(q["quote_id"].alias("quote_id"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("evidence"))
    framed = lambda p, n, share: let(_between(p["text"], kw, n), lambda c: F.when(F.length(c) >= F.length(q["quote"]) * share, c))
    opening = F.array_join(F.slice(kw, 1, 7), " ")

    def across(here: Column, field: str, between: str, what: Column, tier: int, other: Column) -> Column:
        whole = F.array_join(F.transform(here, lambda p: p[field]), between)
        at = lambda n: let(_owner(here, field, len(between), n - 1), lambda i: F.when(i.isNotNull(), told(tier, i, q["quote"])).otherwise(other))
        return let(F.when(what == "", 0).otherwise(F.instr(whole, what)), lambda n: F.when(n > 0, at(n)).otherwise(other))

    def begun(here: Column) -> Column:
        test = lambda p: p["key"].contains(opening) & framed(p, 5, 0.6).isNotNull()
        found = lambda i: F.when(i > 0, let(F.get(here, i - 1), lambda p: told(6, p["idx"], framed(p, 5, 0.6)))).otherwise(none)
        return F.when((F.length(q["key"]) > 30) & (F.size(kw) >= 5), let(first(here, test), found)).otherwise(none)

    def keyed(here: Column) -> Column:
        evidence = lambda p: F.coalesce(framed(p, 5, 0.5), framed(p, 3, 0.5), q["quote"])
        rest = none if upto < 3 else across(here, "text", "\n\n", q["quote"], 3, across(here, "key", " ", q["key"], 4, begun(here)))
        at = F.when(F.length(q["key"]) > 20, first(here, lambda p: p["key"].contains(q["key"]))).otherwise(0)
        return let(at, lambda i: F.when(i > 0, let(F.get(here, i - 1), lambda p: told(2, p["idx"], evidence(p)))).otherwise(rest))

    def exact(here: Column) -> Column:
        at = first(here, lambda p: p["text"].contains(q["quote"]))
        return let(at, lambda i: F.when(i > 0, told(1, F.get(here, i - 1)["idx"], q["quote"])).otherwise(keyed(here) if upto > 1 else none))

    return let(F.filter(paragraphs, lambda p: (p["idx"] >= q["lo"]) & (p["idx"] < q["hi"])), exact)


def _owner(here: Column, field: str, gap: int, place: Column) -> Column:
    """idx of the paragraph that a place (from 0) in the joined texts falls into; null for a place between two."""
    begin = F.struct(F.lit(0).alias("from"), F.lit(None).cast("int").alias("idx"))

    def step(s: Column, p: Column) -> Column:
        end = s["from"] + F.length(p[field])
        return F.struct((end + gap).alias("from"), F.when((place >= s["from"]) & (place < end), p["idx"]).otherwise(s["idx"]).alias("idx"))

    return F.aggregate(here, begin, step, lambda s: s["idx"])


def dedupe_exact(findings: DataFrame, order: str = "seq") -> DataFrame:
    """The first finding, in this order, of each key of category, quote and what is wrong in a document."""
    keyed = findings.withColumn("dedupe_key", dedupe_key(F.col("category_id"), F.col("quote"), F.col("what")))
    first = F.row_number().over(Window.partitionBy("doc_id", "dedupe_key").orderBy(order))
    return keyed.withColumn("__n", first).filter("__n = 1").drop("__n")


def best_by_quote(findings: DataFrame, order: str = "seq") -> DataFrame:
    """Of findings of a category with the same substantial quote (key over 20 characters) the one with the longest quote, then the
    longest explanation, then the first; others stay as they are."""
    key = match_key(F.col("quote"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "category_id", "__key").orderBy(F.length("quote").desc(), F.length("explanation").desc(), order))
    return findings.withColumn("__key", key).withColumn("__n", rank).filter("length(__key) <= 20 OR __n = 1").drop("__key", "__n")


def summarize(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, risk_score (20, 10 and 5 for each high, medium and low, 100 at most), the counts, and the ten commonest categories.

    A row for each doc_id of documents; one without findings has a score of 0, no counts and no categories.
    """
    count = lambda s: F.count_if(F.col("severity") == s)
    totals = findings.groupBy("doc_id").agg(count("high").alias("high"), count("medium").alias("medium"), count("low").alias("low"))
    totals = totals.withColumn("risk_score", F.least(F.lit(100), 20 * F.col("high") + 10 * F.col("medium") + 5 * F.col("low")))
    top = top_categories(findings).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "category_id", "n"))).alias("t"))
    found = totals.join(top.hint("merge"), "doc_id").select(
        "doc_id", "risk_score", "high", "medium", "low", F.transform("t", lambda x: F.struct(x["category_id"].alias("category_id"), x["n"].alias("count"))).alias("top_categories")
    )
    every = documents.select("doc_id").join(found.hint("merge"), "doc_id", "left")
    kind = found.schema["top_categories"].dataType
    counts = [F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in ("risk_score", "high", "medium", "low")]
    return every.select("doc_id", *counts, F.coalesce("top_categories", F.array().cast(kind)).alias("top_categories"))


def top_categories(findings: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, category_id, n, rank of a document's commonest categories; ties go to the one met first."""
    per = findings.groupBy("doc_id", "category_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= k).drop("first")


def highlight_ranges(paragraphs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, idx, quote_id, start, end (from 0, half open) of every occurrence of each quote in its paragraph, without overlap."""
    pair = paragraphs.select("doc_id", "idx", "text").join(quotes.filter("quote <> ''"), ["doc_id", "idx"])
    size = F.length("quote")
    literal = F.concat(F.lit(r"\Q"), F.replace(F.col("quote"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.split(F.col("text"), literal, F.lit(-1))
    starts = pair.select("doc_id", "idx", "quote_id", size.alias("size"), F.posexplode(parts).alias("k", "part"))
    gone = F.sum(F.length("part")).over(Window.partitionBy("doc_id", "idx", "quote_id").orderBy("k"))
    after = F.lead("k").over(Window.partitionBy("doc_id", "idx", "quote_id").orderBy("k"))
    at = starts.withColumn("start", (gone + F.col("k") * F.col("size")).cast("int")).withColumn("next", after).filter("next IS NOT NULL")
    return at.select("doc_id", "idx", "quote_id", "start", (F.col("start") + F.col("size")).alias("end"))
