"""Findings: coercion of model output, severities, citations and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions.text import BLANK, let, match_key, strip, text_of, words

#: Fixed values of two columns of a finding.
CONSEQUENCES = ("Invalid", "Unenforceable", "Void", "Voidable", "Nothing")
LATE = "Failure of the other party to perform obligations on time"
RISKS = ("Penalty", "Criminal liability", LATE, "Nothing")
#: Red-flag categories that names are matched to, with the words that all must occur.
RED_FLAGS = {
    "Termination For Convenience": ("termination", "convenience"),
    "Uncapped Liability": ("uncapped", "liability"),
    "Irrevocable Or Perpetual License": ("irrevocable", "perpetual", "license"),
    "Most Favored Nation": ("most", "favored", "nation"),
    "Audit Rights": ("audit", "rights"),
    "Ip Ownership Assignment": ("ip", "ownership", "assignment"),
}
#: Names of statutes that make a citation valid wherever they occur in it; fixed values, without those that contain another.
STATUTES = (
    "Consumer Rights Act", "CRA 2015", "Housing Act", "Landlord and Tenant Act", "Protection from Eviction Act", "Tenant Fees Act",
    "Homes (Fitness for Human Habitation) Act", "Homes Act 2018", "Unfair Contract Terms Act 1977", "UCTA 1977", "Rent Act",
    "Leasehold Reform Act", "Leasehold Reform, Housing and Urban Development Act 1993", "common law", "Equality Act 2010", "Data Protection Act 2018",
    "Gas Safety (Installation and Use) Regulations 1998",
    "Electrical Safety Standards in the Private Rented Sector (England) Regulations 2020",
    "Smoke and Carbon Monoxide Alarm (England) Regulations 2015",
    "Energy Efficiency (Private Rented Property) (England and Wales) Regulations 2015",
)
#: Forms of a citation: a named Act with an optional year, sections and note; an abbreviation with a year.
ACT_FORM = r"(?i)^[A-Z](?:[A-Za-z()]|{B})+Act(?:{B}+[0-9]{4})?(?:{B}*,{B}*sections?{B}+[0-9]+(?:(?:-|{B})+[0-9]+)?(?:{B}*\([^)]+\))?)?$".replace("{B}", BLANK)
SHORT_FORM = rf"^[A-Z]{{2,}}{BLANK}+[0-9]{{4}}$"
#: Words too common to relate two quotes; fixed values.
STOP = (
    "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will would "
    "should could may might must this that these those other than any all some each every"
).split()
MAX_REFERENCES = 6


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """The value that equals c in any case, else Nothing."""

    def named(low: Column) -> Column:
        out = F
        for v in values:
            out = out.when(low == v.lower(), F.lit(v))
        return out.otherwise(F.lit("Nothing"))

    return let(F.lower(strip(c)), named)


def consequence(c: Column) -> Column:
    return one_of(c, CONSEQUENCES)


def risk(c: Column) -> Column:
    return let(F.lower(strip(c)), lambda low: F.when(low.contains("failure") & low.contains("obligations"), F.lit(LATE)).otherwise(one_of(low, RISKS)))


def red_flag(c: Column) -> Column:
    """The red flag of this name, else the one whose words all occur, else c stripped."""
    return let(strip(c), lambda s: let(F.lower(s), lambda low: _red_flag(s, low)))


def _red_flag(s: Column, low: Column) -> Column:
    out = F
    for name in RED_FLAGS:
        out = out.when(low == name.lower(), F.lit(name))
    for name, parts in RED_FLAGS.items():
        all_in = F.lit(True)
        for p in parts:
            all_in = all_in & low.contains(p)
        out = out.when(all_in, F.lit(name))
    return out.otherwise(s)


def severity(score: Column, zero_is_medium: bool = True) -> Column:
    """high from 2, medium at 1, else low; a missing score counts as 1, and so does 0 unless told otherwise."""
    n = F.coalesce(score, F.lit(1))
    n = F.when(n == 0, F.lit(1)).otherwise(n) if zero_is_medium else n
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def is_valid_reference(c: Column) -> Column:
    """A known statute, common law, an Act's form or an abbreviation with a year."""
    s = strip(c)
    low = F.lower(s)
    known = F.lit(False)
    for name in STATUTES:
        known = known | low.contains(name.lower())
    return (s != "") & (known | s.rlike(ACT_FORM) | s.rlike(SHORT_FORM))


def valid_references(refs: Column) -> Column:
    return F.filter(F.coalesce(refs, F.array().cast("array<string>")), is_valid_reference)


def invalid_references(refs: Column) -> Column:
    """Those that are not valid, in their order, repeats and all; null ones leave."""
    return F.filter(F.coalesce(refs, F.array().cast("array<string>")), lambda r: ~is_valid_reference(r) & r.isNotNull())


def what_is_wrong(reasoning: Column, explanation: Column) -> Column:
    """A line with a dash for each reason, else the explanation."""
    lines = F.array_join(F.transform(F.coalesce(reasoning, F.array().cast("array<string>")), lambda r: F.concat(F.lit("- "), text_of(r))), "\n")
    return F.coalesce(F.nullif(lines, F.lit("")), text_of(explanation))


def reference_policy(refs: Column, skip_if_none: bool = False) -> Column:
    """struct(references, action): keep the valid ones; if none of some is valid, skip the finding or ask for new ones."""
    valid = F.slice(valid_references(refs), 1, MAX_REFERENCES)
    none = (F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0) & (F.size(valid) == 0)
    return F.struct(valid.alias("references"), F.when(none, F.lit("skip" if skip_if_none else "regenerate")).otherwise("keep").alias("action"))


def dedupe_key(category: Column, quote: Column, what: Column) -> Column:
    """SHA-256 of the lower-cased category and the cleaned quote; a short quote is told apart by what is wrong."""
    q = strip(F.regexp_replace(F.regexp_replace(strip(quote), rf"{BLANK}+", " "), r"[\x00-\x1F\x7F\x{25A0}-\x{25FF}]", " "))
    more = F.regexp_replace(F.substring(strip(what), 1, 200), rf"{BLANK}+", " ")
    q = F.when(F.length(q) < 10, F.concat(q, F.lit("|"), more)).otherwise(q)
    return F.sha2(F.concat(F.lower(strip(category)), F.lit("\n"), q).cast("binary"), 256)


def _within(a: Column, b: Column) -> Column:
    return (F.instr(a, b) > 0) | (F.instr(b, a) > 0) | (a == "") | (b == "")


def quotes_intersect(a: Column, b: Column, strict: bool = False) -> Column:
    """One holds the other, or goes on from the other by three to five words; if not strict, also by enough common long words."""

    def goes_on(u: Column, v: Column) -> Column:
        out = F.lit(False)
        for n in (5, 4, 3):
            enough = (F.size(u) >= n) & (F.size(v) >= n)
            out = out | (enough & ((F.slice(u, F.greatest(F.size(u) - n + 1, F.lit(1)), n) == F.slice(v, 1, n)) | (F.slice(v, F.greatest(F.size(v) - n + 1, F.lit(1)), n) == F.slice(u, 1, n))))
        return out

    def alike(x: Column, y: Column, u: Column, v: Column) -> Column:
        telling = lambda w: F.filter(w, lambda t: (F.length(t) > 3) & ~t.isin(STOP))
        less = F.length(x) < F.length(y)
        share = lambda own, longer: F.size(F.filter(own, lambda t: F.array_contains(longer, t))) >= F.greatest(F.lit(3.0), F.size(own) * 0.5)
        common = let(F.when(less, v).otherwise(u), lambda longer: let(telling(F.when(less, u).otherwise(v)), lambda own: share(own, longer)))
        return (F.size(F.array_intersect(telling(u), telling(v))) >= 3) | common

    # keys and words are bound once; each stands in many places
    worded = lambda x, y: let(words(x), lambda u: let(words(y), lambda v: goes_on(u, v) if strict else goes_on(u, v) | alike(x, y, u, v)))
    out = let(match_key(a), lambda x: let(match_key(b), lambda y: _within(x, y) | worded(x, y)))
    return (text_of(a) != "") & (text_of(b) != "") & out


#: A backslash with what it escapes, between braces; a brace counts even behind one.
_ESCAPED = r"(?s)\\."


def json_object(raw: Column) -> Column:
    """The first brace that a later one closes, up to there; braces within the object's strings don't count. Null if there is none.

    Whether a brace stands within a string depends, for any object begun before it, on the number of quotes between: so braces after
    an even and after an odd number of quotes are matched apart, each with a stack of open places, in one pass. The pass steps from
    brace to brace; of what lies between two only its length and whether its quotes are odd count.
    """

    def between(x: Column) -> Column:
        bare = F.when(x.contains("\\"), F.regexp_replace(x, _ESCAPED, "")).otherwise(x)
        quotes = let(bare, lambda b: F.length(b) - F.length(F.replace(b, F.lit('"'), F.lit(""))))
        return F.struct(F.length(x).alias("gap"), (quotes % 2 == 1).alias("turns"))

    def scan(text: Column) -> Column:
        signs, gaps = F.regexp_extract_all(text, F.lit("([{}])"), 1), F.transform(F.split(text, "[{}]", -1), between)
        none = F.array().cast("array<int>")
        begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("even_open"), none.alias("odd_open"), F.lit(0).alias("start"), F.lit(0).alias("end"))

        def step(s: Column, x: Column) -> Column:
            place, odd = s["at"] + x["gap"] + 1, s["odd"] != x["turns"]  # counted from 1
            return let(F.when(odd, s["odd_open"]).otherwise(s["even_open"]), lambda own: met(s, x, place, odd, own))

        def met(s: Column, x: Column, place: Column, odd: Column, own: Column) -> Column:
            opens, closes = x["sign"] == "{", (x["sign"] == "}") & (F.size(own) > 0)
            now = F.when(opens, F.concat(own, F.array(place))).when(closes, F.slice(own, 1, F.size(own) - 1)).otherwise(own)
            top = F.element_at(own, -1)
            better = closes & ((s["start"] == 0) | (top < s["start"]))
            return F.struct(
                place.alias("at"), odd.alias("odd"), F.when(odd, s["even_open"]).otherwise(now).alias("even_open"), F.when(odd, now).otherwise(s["odd_open"]).alias("odd_open"),
                F.when(better, top).otherwise(s["start"]).alias("start"), F.when(better, place).otherwise(s["end"]).alias("end"),
            )

        pairs = F.zip_with(signs, F.slice(gaps, 1, F.size(signs)), lambda a, b: F.struct(a.alias("sign"), b["gap"].alias("gap"), b["turns"].alias("turns")))
        found = F.aggregate(pairs, begin, step)
        return let(found, lambda f: F.when(f["start"] > 0, F.substring(text, f["start"], f["end"] - f["start"] + 1)))

    # quotes before the first brace are in no object's way
    return let(text_of(raw), lambda t: F.when(t.contains("{"), let(F.substring(t, F.locate("{", t), F.length(t)), scan)))


MODEL_SCHEMA = (
    "struct<findings:array<struct<category:string,quote:string,evidence:string,reasoning:array<string>,is_unfair:boolean,explanation:string,legal_references:array<string>,"
    "possible_consequences:string,risk_assessment:struct<severity_of_consequences:string,degree_of_legal_violation:string>,consequences_category:string,risk_category:string,"
    "recommended_revision:struct<revised_clause:string,revision_explanation:string>,suggested_follow_up:string>>>"
)
DEFAULT_CATEGORY = "Termination For Convenience"
#: Longest texts and lists of a finding; fixed values.
TEXT_LIMITS = {"quote": 2000, "explanation": 1200, "possible_consequences": 800, "revised_clause": 2000, "revision_explanation": 800, "suggested_follow_up": 600}
LIST_LIMITS = {"reasoning": 3, "legal_references": MAX_REFERENCES}
SCORES = ("severity_of_consequences", "degree_of_legal_violation")


def _score(c: Column) -> Column:
    """An int from 0 to 3; what is no number is 0."""
    n = F.floor(c.try_cast("double")).cast("int")
    return F.when(n.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(3), n)))


def _clean(f: Column) -> Column:
    """A finding of an answer with its fields coerced and none nested."""
    strings = F.array().cast("array<string>")
    texts = {c: f[c] for c in ("explanation", "possible_consequences", "suggested_follow_up")} | {c: f["recommended_revision"][c] for c in ("revised_clause", "revision_explanation")}
    return F.struct(
        red_flag(F.coalesce(f["category"], F.lit(DEFAULT_CATEGORY))).alias("category"),
        F.coalesce(F.nullif(f["quote"], F.lit("")), f["evidence"], F.lit("")).alias("quote"),
        F.coalesce(f["is_unfair"], F.lit(True)).alias("is_unfair"),
        *[text_of(c).alias(n) for n, c in texts.items()],
        *[F.coalesce(f[c], strings).alias(c) for c in LIST_LIMITS],
        *[_score(f["risk_assessment"][c]).alias(c) for c in SCORES],
        consequence(f["consequences_category"]).alias("consequences_category"),
        risk(f["risk_category"]).alias("risk_category"),
    )


def _faults(f: Column, clean: Column) -> Column:
    """array<struct(field, reason, repaired)>: what keeps a finding from being taken as it is. Repaired faults are mended, others make
    the finding leave."""
    fault = lambda bad, field, reason, repaired: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), F.lit(repaired).alias("repaired")))
    whole = lambda c: c.rlike(r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$") & c.try_cast("double").between(0, 3)
    found = [fault(f["category"].isNull(), "category", "missing", True)]
    found += [fault(f["risk_assessment"][c].isNotNull() & ~F.coalesce(whole(f["risk_assessment"][c]), F.lit(False)), c, "no whole number from 0 to 3", True) for c in SCORES]
    found += [fault(F.length(clean[c]) > n, c, f"longer than {n}", False) for c, n in TEXT_LIMITS.items()]
    found += [fault(F.size(clean[c]) > n, c, f"more than {n}", False) for c, n in LIST_LIMITS.items()]
    return F.array_compact(F.array(*found))


def checked_findings(raw: Column) -> Column:
    """array<struct(n, finding, faults)> of a model's answer, from one parse: n from 0; null where there is no valid object."""
    told = lambda f, i: let(_clean(f), lambda c: F.struct(i.alias("n"), c.alias("finding"), _faults(f, c).alias("faults")))
    return F.transform(F.from_json(json_object(raw), MODEL_SCHEMA)["findings"], told)


def _kept(x: Column) -> Column:
    return ~F.exists(x["faults"], lambda e: ~e["repaired"])


def parse_findings(raw: Column) -> Column:
    """An array of findings with coerced fields from a model's answer; null where there is no valid object. Those over a limit leave."""
    return kept_findings(checked_findings(raw))


def kept_findings(checked: Column) -> Column:
    """The findings of checked_findings() without those over a limit."""
    return F.transform(F.filter(checked, _kept), lambda x: x["finding"])


def answer_path(checked: Column) -> Column:
    """How an answer was taken: strict (as it is), salvaged (something was mended or left out), or none (no object)."""
    return F.when(checked.isNull(), "none").when(F.exists(checked, lambda x: F.size(x["faults"]) > 0), "salvaged").otherwise("strict")


def rejects(checked: Column) -> Column:
    """array<struct(n, field, reason, repaired)>: every fault of every finding of checked_findings()."""
    return F.flatten(F.transform(checked, lambda x: F.transform(x["faults"], lambda e: F.struct(x["n"].alias("n"), e["field"].alias("field"), e["reason"].alias("reason"), e["repaired"].alias("repaired")))))
