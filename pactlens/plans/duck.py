"""The same text rules in DuckDB SQL, written apart from the Spark expressions, for the oracle queries."""

from __future__ import annotations

from pactlens.functions.findings import ACT_FORM, SHORT_FORM, STATUTES
from pactlens.functions.headings import (
    ADDRESS, ANY_DATE, CAPITALS, CONTACT, CONTACT_ONLY, FORM_LINE, HONORIFIC, LABELLED, MODAL, NAME_ONLY, NAME_TITLE, NUMBERED, PLACE, POSTCODE,
)
from pactlens.functions.text import BLANK, CONTROL_OR_BLOCK, NOT_PRINTABLE, PAGE_FRAGMENT, PAGE_LINE, TRIGGER
from pactlens.operators.findings import CUES
from pactlens.sources.contracts import CONTRACTS_SQL

CONTRACTS = f"contracts AS ({CONTRACTS_SQL})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(e: str, p: str) -> str:
    return f"regexp_matches({e}, {lit(p)})"


def sub(e: str, p: str, r: str) -> str:
    return f"regexp_replace({e}, {lit(p)}, {r if r.startswith('chr') else lit(r)}, 'g')"


def strip(e: str) -> str:
    return sub(f"coalesce({e}, '')", f"^{BLANK}+|{BLANK}+$", "")


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({e}, ''), {lit(BLANK + '+')}), lambda z: z <> '')"


def normalize(e: str) -> str:
    s = sub(f"coalesce({e}, '')", r"\r\n?", "chr(10)")
    s = f"translate({s}, chr(12) || chr(894), chr(10) || ';')"
    s = sub(sub(s, PAGE_LINE.replace("(?imd)", "(?im)"), ""), PAGE_FRAGMENT, "")
    s = sub(s, r"[ \t]+\n", "chr(10)")
    s = sub(s, r"\n{3,}", "chr(10) || chr(10)")
    return strip(sub(sub(s, CONTROL_OR_BLOCK, " "), NOT_PRINTABLE, " "))


def squeeze(e: str) -> str:
    return sub(strip(f"lower(coalesce({e}, ''))"), f"{BLANK}+", " ")


def match_key(e: str) -> str:
    return squeeze(normalize(e))


def tokens(e: str) -> str:
    n = f"length({strip(e)})"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, ({n} + 3) // 4) END)::INTEGER"


def slug(e: str) -> str:
    s = sub(sub(f"replace(lower({strip(e)}), '&', ' and ')", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return f"coalesce(nullif({s}, ''), 'unknown')"


def title_case(e: str) -> str:
    runs = f"regexp_extract_all({e}, {lit(r'(\p{L}+|[^\p{L}]+)')})"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END || lower(r[2:])), '')"


def ratio(e: str, part: str, whole: str) -> str:
    n = lambda c: f"length({e}) - length({sub(e, c, '')})"
    return f"coalesce(({n(part)})::DOUBLE / nullif({n(whole)}, 0), 0)"


def sentence_like(t: str) -> str:
    after = words(f"CASE WHEN contains({t}, '. ') THEN substr({t}, instr({t}, '. ') + 2) ELSE '' END")
    marks = f"({has(t, '[.!?]$')} AND NOT {has(t, r'^[0-9]+(?:\.[0-9]+)*[.)]?$')})"
    two = f"({has(t, rf'\.{BLANK}+[\p{{L}}\p{{N}}_]')} AND contains({t}, '. ') AND len({after}) >= 3)"
    return f"(contains({t}, ';') OR length({t}) - length(replace({t}, ',', '')) >= 2 OR {has(t, MODAL)} OR {two} OR {marks})"


def rest(e: str) -> str:
    return f"nullif({sub(e, r'^[ \t\x{2013}\x{2014}:-]+|[ \t\x{2013}\x{2014}:-]+$', '')}, '')"


def headings(source: str, text: str, limit: int = 160) -> str:
    """SELECT *, raw, level, label, title over a relation: level is null for what is no heading."""
    b = BLANK
    shape = "^(?i:{w}){b}+([0-9]+(?:\\.[0-9]+)*)\\b"
    article = rf"(?i)^ARTICLE{b}+(?:[IVXLCDM]+|[0-9]+)\b"
    numbers = {k: shape.format(w=k, b=b) for k in ("SECTION", "CLAUSE")} | {"SIGN": rf"^\x{{A7}}{b}*([0-9]+(?:\.[0-9]+)*)\b"}
    cols = ", ".join(f"regexp_extract(raw, {lit(p)}, 1) AS n_{k.lower()}, regexp_extract(raw, {lit(p)}) AS m_{k.lower()}" for k, p in numbers.items())
    one = f"""SELECT *, {sentence_like('raw')} AS sent, regexp_extract(raw, {lit(article)}) AS m_article, {cols},
        regexp_extract(raw, {lit(NUMBERED)}, 1) AS n_num, regexp_extract(raw, {lit(NUMBERED)}, 2) AS n_tail, {rest(strip(f"regexp_extract(raw, {lit(NUMBERED)}, 3)"))} AS n_title,
        len({words('raw')}) AS n_words
        FROM (SELECT *, {strip(text)} AS raw FROM {source})"""
    titled = f"coalesce(len(list_filter({words('raw')}, lambda q: regexp_matches(q, {lit(r'(?s)^\p{Lu}.*\p{Ll}')})))::DOUBLE / nullif(n_words, 0), 0)"
    rules = [
        (f"raw = '' OR length(raw) > {limit} OR {has('raw', f'(?i)^(?:{CONTACT})')} OR {has('raw', f'^(?:{NAME_TITLE})')}", None),
        ("m_article <> '' AND sent", None),
        ("m_article <> ''", ("0", title_case("m_article"), rest("substr(raw, length(m_article) + 1)"))),
    ]
    for k, label in (("section", "Section "), ("clause", "Clause "), ("sign", "§ ")):
        bad = "sent OR contains(n_{k}, '.')".format(k=k)
        if k == "section":
            bad += f" OR {has(sub('substr(raw, length(m_section) + 1)', f'^{b}+', ''), '^[,;]')}"
        rules += [(f"n_{k} <> '' AND ({bad})", None), (f"n_{k} <> ''", ("1", f"{lit(label)} || n_{k}", rest(f"substr(raw, length(m_{k}) + 1)")))]
    level = "CASE WHEN n_tail = '' THEN 2 ELSE 3 END"
    bare = f"n_title IS NULL AND n_tail = '' AND NOT {has('raw', rf'^[0-9]+{b}*[.)]$')}"
    rules += [
        (f"n_num <> '' AND (contains(n_num, '.') OR ({bare}))", None),
        (f"n_num <> '' AND sent AND {has('raw', r'^[0-9]+[.)]?$')}", (level, "n_num || n_tail", "NULL")),
        (f"n_num <> '' AND (sent OR coalesce({has('n_title', r'^\p{Ll}')} OR {has('n_title', rf'^(?:[0-9]|{b})+$')}, false))", None),
        ("n_num <> ''", (level, "n_num || n_tail", "n_title")),
        (f"sent OR {has('raw', r'^\p{Ll}')} OR n_words > 12 OR {has('raw', POSTCODE)} OR (contains(raw, ':') AND NOT ends_with(raw, ':'))", None),
        (f"{has('raw', CAPITALS)} AND {ratio('raw', r'\p{Lu}', r'\p{L}')} >= 0.85 AND NOT contains(raw, ',')", ("1", title_case("raw"), "NULL")),
        (f"{has('raw', PLACE)} OR {has('raw', HONORIFIC)}", None),
        (f"n_words >= 2 AND {titled} >= 0.7", ("1", "raw", "NULL")),
    ]
    whens = " ".join(f"WHEN {c} THEN {i}" for i, (c, _) in enumerate(rules))
    pick = lambda k: "CASE rule " + " ".join(f"WHEN {i} THEN {v[k]}" for i, (_, v) in enumerate(rules) if v) + " END"
    drop = ", ".join(["sent", "rule", "m_article", "n_num", "n_tail", "n_title", "n_words", *[f"{x}_{k.lower()}" for k in numbers for x in "nm"]])
    return f"SELECT * EXCLUDE ({drop}), ({pick(0)})::INTEGER AS level, {pick(1)} AS label, {pick(2)} AS title FROM (SELECT *, CASE {whens} END AS rule FROM ({one}))"


def signature(t: str, no_heading: str) -> str:
    w = words(t)
    names = f"len(list_filter({w}, lambda q: regexp_matches(q, '^[A-Z][a-z]+$')))"
    n = f"len({w})"
    dated = f"({n} BETWEEN 2 AND 8 AND {has(t, rf'(?i)\b{ANY_DATE}\b')} AND {names} >= 2 AND {names} >= {n} * 0.6)"
    any_of = " OR ".join([has(t, ADDRESS), has(t, LABELLED), f"{n} <= 2", has(t, NAME_ONLY), has(t, "(?i)/s/"), has(t, f"(?i)^{ANY_DATE}$"), dated, has(t, FORM_LINE)])
    return f"(length({t}) >= 3 AND {no_heading} AND NOT {has(t, r'^[0-9]+(?:\.[0-9]+)+')} AND ({any_of}))"


def bullet_kind(e: str) -> str:
    s = sub(f"coalesce({e}, '')", f"^{BLANK}+", "")
    return f"(CASE WHEN {has(s, rf'^[-*•]{BLANK}')} THEN 'symbol' WHEN {has(s, rf'^\(?\p{{Nd}}{{1,3}}[).\]]{BLANK}')} THEN 'number' WHEN {has(s, rf'^[A-Za-z][).\]]{BLANK}')} THEN 'letter' ELSE '' END)"


def valid_reference(e: str) -> str:
    s = strip(e)
    return f"({s} <> '' AND (" + " OR ".join(f"contains(lower({s}), {lit(x.lower())})" for x in STATUTES) + f" OR {has(s, ACT_FORM)} OR {has(s, SHORT_FORM)}))"


def dedupe_key(category: str, quote: str, what: str) -> str:
    q = strip(sub(sub(strip(quote), f"{BLANK}+", " "), r"[\x00-\x1F\x7F\x{25A0}-\x{25FF}]", " "))
    more = sub(f"substr({strip(what)}, 1, 200)", f"{BLANK}+", " ")
    return f"sha256(lower({strip(category)}) || chr(10) || CASE WHEN length({q}) < 10 THEN {q} || '|' || {more} ELSE {q} END)"


#: The lines of all agreements: doc_id, idx from 0, text.
RAW = f"""{CONTRACTS},
  raw_lines AS (SELECT doc_id, i - 1 AS idx, x AS text FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS x,
    generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS i FROM contracts))"""

#: The same with headings.
LINES = f"""{RAW},
  lines AS ({headings('raw_lines', 'text')})"""

#: Findings of the default cues over the lines: one for each sentence and cue that it matches.
FOUND = f"""{LINES},
  sentences AS (SELECT doc_id, idx, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS quote FROM (SELECT doc_id, idx,
    list_filter(string_split(regexp_replace(text, '([.!?]){BLANK}+', '\\1' || chr(29), 'g'), chr(29)), lambda z: z <> '') AS s FROM raw_lines) WHERE len(s) > 0),
  cues(category_id, pattern, unless, severity, violation) AS (VALUES {', '.join(f"({lit(c.category_id)}, {lit(c.pattern)}, {lit(c.unless)}, {c.severity}, {c.violation})" for c in CUES)}),
  found AS (SELECT doc_id, idx, n, quote, category_id, severity, violation FROM sentences JOIN cues ON {' OR '.join(f"(category_id = {lit(c.category_id)} AND {has('quote', c.pattern)} AND NOT {has('quote', c.unless)})" for c in CUES)})"""

SEVERITY = "CASE WHEN severity >= 2 THEN 'high' ELSE 'medium' END"
CONTACT_LINE = CONTACT_ONLY
EXCEPTION = TRIGGER
