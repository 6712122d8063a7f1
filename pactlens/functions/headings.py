"""Heading recognition by the form of a line, as column expressions without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions.text import BLANK, BLANKS, let, strip, text_of, title_case, upper_ratio, words

#: Lines that open like a contact, address or signature; fixed values.
CONTACT = (
    r"Attn:{B}+|Attention:{B}+|If{B}+to{B}+|With{B}+a{B}+copy{B}+to:|Facsimile:|Fax:|Phone:|Email:|By:|/s/|Signed:|Signature:"
    r"|[0-9]+{B}+[A-Z][a-z]+{B}+(?:Street|Road|Avenue|Drive|Lane|Boulevard|Way|Court|Place|Circle|Terrace|Parkway|Highway|Trail|Blvd)\b"
).replace("{B}", BLANK)
NAME_TITLE = r"[A-Z][a-z]+(?:{B}+[A-Z][a-z]+)*,{B}+[A-Z][a-z]+(?:{B}+[A-Z][a-z]+)*{B}*$|[A-Z][a-z]+{B}+[A-Z][a-z]+{B}*$".replace("{B}", BLANK)
MODAL = r"(?i)\b(shall|will|must|may|agrees?|warrants?|represents?)\b"
PLACE = r"(?i)\b(?:Street|Road|Avenue|Drive|Lane|Boulevard|Way|Court|Place|Circle|Suite|Floor|Flat|Room|Building|Terrace|Parkway|Highway|Trail|Blvd)\b"
HONORIFIC = rf"(?i)^(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?{BLANK}"
POSTCODE = rf"^[A-Z]{{1,2}}[0-9][A-Z0-9]?{BLANK}*[0-9][A-Z]{{2}}$"
CAPITALS = r"^[A-Z0-9][A-Z0-9 .,:;()'\"/\\-]{2,}$"
ARTICLE = rf"(?i)^(ARTICLE{BLANK}+(?:[IVXLCDM]+|[0-9]+)\b)"
MARKED = r"(?i)^({W}{B}+([0-9]+(?:\.[0-9]+)*)\b)((?s:.*))$"
SIGN = rf"^(\x{{A7}}{BLANK}*([0-9]+(?:\.[0-9]+)*)\b)((?s:.*))$"
NUMBERED = rf"(?i)^([0-9]+(?:\.[0-9]+){{0,6}})(\([a-z]\))?{BLANK}*(?:[.)]{BLANK}*)?(.+)?$"
MAX_LENGTH = 160


def looks_like_sentence(c: Column) -> Column:
    return let(strip(c), _sentence)


def _sentence(t: Column) -> Column:
    """The same of a stripped text; the cheapest signs come first."""
    after = F.substring(t, F.instr(t, ". ") + 2, F.length(t))
    two = t.contains(". ") & t.rlike(rf"\.{BLANK}+[\p{{L}}\p{{N}}_]") & (F.size(words(after)) >= 3)
    ends = ends_sentence(t) & ~t.rlike(r"^[0-9]+(?:\.[0-9]+)*[.)]?$")
    return _has_stops(t) | ends | two | t.rlike(MODAL)


def ends_sentence(t: Column) -> Column:
    """A stripped text whose last character is a full stop or the like."""
    return F.right(t, F.lit(1)).isin(".", "!", "?")


def _has_stops(t: Column) -> Column:
    """A semicolon or two commas."""
    return t.contains(";") | (t.contains(",") & (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) >= 2))


def _rest(c: Column) -> Column:
    """The title after a marker, null if nothing is left."""
    return F.nullif(F.btrim(c, F.lit(" \t\u2013\u2014:-")), F.lit(""))


def _heading(level: Column | int, label: Column, title: Column | None, raw: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(level.alias("level"), label.alias("label"), (F.lit(None).cast("string") if title is None else title).alias("title"), raw.alias("raw"))


def parse_heading(c: Column, max_len: int = MAX_LENGTH) -> Column:
    """struct(level, label, title, raw), or null. Levels: 0 article, 1 section or title, 2 number, 3 number with (a).

    Length, first and last character come first: a long line is none, nor is what ends like a sentence and begins with no digit, and
    markers are only looked for behind A, S, C, a section sign or a digit. The stripped line and what a marker's pattern finds are
    bound once.
    """
    return let(strip(c), lambda raw: F.when((raw != "") & (F.length(raw) <= max_len), _parsed(raw)))


def heading_of(t: Column) -> Column:
    """parse_heading() of a stripped text that is a column: Spark compiles what tells most lines to be none."""
    return F.when(_may_be_heading(t), _parsed(t))


def is_heading(t: Column) -> Column:
    """Whether a stripped text is a heading, without its parts. What parse_heading binds in lambdas Spark interprets; this it compiles, give it a column."""
    return F.coalesce(F.when(_may_be_heading(t), _parsed(t, lambda *parts: F.lit(True))), F.lit(False))


def _may_be_heading(t: Column) -> Column:
    """Leaves no heading out. Four words in small letters are more than three in ten of twelve, and there are none among capitals."""
    first = F.substring(t, 1, 1)
    prose = first.between("a", "z") | (t.contains(":") & ~t.endswith(":")) | t.rlike(r"(?s)(?: [a-z].*?){4}")
    words_alone = ~ends_sentence(t) & ~_has_stops(t) & (F.upper(first).isin("A", "S", "C", "§") | ~prose)
    return (t != "") & (F.length(t) <= MAX_LENGTH) & F.when(first.between("0", "9"), ~t.rlike(r"^[0-9]+\.[0-9]")).otherwise(words_alone)


def _parsed(raw: Column, made: Callable[..., Column] = _heading) -> Column:
    """made(level, label, title, raw) where the line is a heading, else null."""
    begin = F.upper(F.substring(raw, 1, 1))
    digit = begin.between("0", "9")
    # without a digit in front no sentence is a heading
    out = F.when(~digit & (ends_sentence(raw) | _has_stops(raw)), F.lit(None))
    out = out.when(raw.rlike(rf"(?i)^(?:{CONTACT})") | raw.rlike(rf"^(?:{NAME_TITLE})"), F.lit(None))
    out = out.when(digit, _numbered(raw, made))
    for first, parsed in (("A", _article), ("S", lambda r, m: _marked(r, m, "SECTION", "Section ")), ("C", lambda r, m: _marked(r, m, "CLAUSE", "Clause ")), ("§", lambda r, m: _marked(r, m, None, "§ "))):
        marker = {"A": ARTICLE, "S": _marker("SECTION"), "C": _marker("CLAUSE"), "§": SIGN}[first]
        out = out.when((begin == first) & raw.rlike(marker), parsed(raw, made))
    return out.otherwise(_plain(raw, made))


def _article(raw: Column, made: Callable[..., Column]) -> Column:
    found = lambda m: made(0, title_case(m), _rest(F.substring(raw, F.length(m) + 1, F.length(raw))), raw)
    return F.when(~_sentence(raw), let(F.regexp_extract(raw, ARTICLE, 1), found))


def _marker(word: str) -> str:
    return MARKED.replace("{W}", word).replace("{B}", BLANK)


def _marked(raw: Column, made: Callable[..., Column], word: str | None, label: str) -> Column:
    pattern = SIGN if word is None else _marker(word)

    def found(num: Column) -> Column:
        rest = F.regexp_extract(raw, pattern, 3)
        bad = num.contains(".")
        if word == "SECTION":
            bad = bad | F.ltrim(rest, F.lit(BLANKS)).rlike("^[,;]")
        return F.when(~bad, made(1, F.concat(F.lit(label), num), _rest(rest), raw))

    return F.when(~_sentence(raw), let(F.regexp_extract(raw, pattern, 2), found))


def _numbered(raw: Column, made: Callable[..., Column]) -> Column:
    """After digits, whatever follows them: the pattern always matches."""
    parts = F.struct(*[F.regexp_extract(raw, NUMBERED, k).alias(n) for k, n in ((1, "num"), (2, "tail"), (3, "rest"))])

    def found(p: Column) -> Column:
        level = F.when(p["tail"] == "", F.lit(2)).otherwise(F.lit(3))
        own = lambda title: made(level, F.concat(p["num"], p["tail"]), title, raw)
        bare = lambda t: t.isNull() & (p["tail"] == "") & ~raw.rlike(rf"^[0-9]+{BLANK}*[.)]$")
        titled = lambda t: (
            F.when(bare(t), F.lit(None))
            .when(_sentence(raw), F.when(raw.rlike(r"^[0-9]+[.)]?$"), own(None)))
            .when(~F.coalesce(t.rlike(r"^\p{Ll}") | t.rlike(rf"^(?:[0-9]|{BLANK})+$"), F.lit(False)), own(t))
        )
        return F.when(~p["num"].contains("."), let(_rest(strip(p["rest"])), titled))

    return let(parts, found)


def _plain(raw: Column, made: Callable[..., Column]) -> Column:
    """Titles without a marker: few words, capitals or capitalised. Whether they are sentences is asked last, of those that look like titles."""

    def counted(w: Column) -> Column:
        n = F.size(w)
        titled = F.size(F.filter(w, lambda x: x.rlike(r"(?s)^\p{Lu}.*\p{Ll}")))
        low = (n > 12) | raw.rlike(POSTCODE)
        capitals = raw.rlike(CAPITALS) & ~raw.contains(",") & (upper_ratio(raw) >= 0.85)
        title = (n >= 2) & (titled >= n * F.lit(0.7)) & ~raw.rlike(PLACE) & ~raw.rlike(HONORIFIC)
        told = lambda text: F.when(~_sentence(raw), made(1, text, None, raw))
        return F.when(~low, F.when(capitals, told(title_case(raw))).when(title, told(raw)))

    small = F.substring(raw, 1, 1).rlike(r"^\p{Ll}") | (raw.contains(":") & ~raw.endswith(":"))
    return F.when(~small, let(words(raw), counted))


def is_top_heading(heading: Column) -> Column:
    """Article, section, title or plain number; not a number with (a). Null is not."""
    return F.coalesce(heading["level"].between(0, 2), F.lit(False))


def opens_section(c: Column) -> Column:
    """A paragraph that begins with an undotted number and a short or capital title, then text on the same line."""
    t = strip(c)
    return F.when(F.substring(t, 1, 1).between("0", "9"), _opens(t)).otherwise(F.lit(False))


def _opens(t: Column) -> Column:
    pattern = r"(?i)^([0-9]+(?:\.[0-9]+)*){B}*\.?{B}+([A-Z](?:[A-Z]|{B}){2,}?){B}+(?:\.{B}+|[0-9]+\.[0-9]+{B}+)?[A-Z]".replace("{B}", BLANK)
    num = F.regexp_extract(t, pattern, 1)
    title = F.slice(words(F.regexp_extract(t, pattern, 2)), 1, 10)
    n = F.size(title)
    capital = F.size(F.filter(title, lambda w: (F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    titled = F.size(F.filter(title, lambda w: w.rlike(r"^\p{Lu}") & ~(w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))))
    like = (n <= 5) | (2 * capital >= n) | (n.between(2, 4) & (2 * titled >= n))
    return (num != "") & ~num.contains(".") & (n > 0) & like


#: Months, as they stand in dates.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_DATES = [r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", rf"{_MONTH}{BLANK}+[0-9]{{1,2}},?{BLANK}+[0-9]{{4}}", rf"[0-9]{{1,2}}{BLANK}+{_MONTH}{BLANK}+[0-9]{{4}}"]
ANY_DATE = "(?:" + "|".join(_DATES) + ")"
ADDRESS = r"(?i)^[A-Z][a-z]+(?:{B}+[A-Z][a-z]+)*,{B}+[A-Z][a-z]+{B}+[0-9]{5}(?:{B}+Attn:.*)?$".replace("{B}", BLANK)
LABELLED = r"(?i)^(?:Attn:{B}+|Attention:{B}+|(?:Email|E-mail|Phone|Tel|Fax){B}*:)".replace("{B}", BLANK)
NAME_ONLY = r"^[A-Z][a-z]+(?:{B}+[A-Z][a-z]+){1,3}(?:{B}*,{B}*[A-Z][a-z]+(?:{B}+[A-Z][a-z]+)*)?$".replace("{B}", BLANK)
FORM_LINE = (
    r"(?i)^(?:(?:Full{B}+name|Print{B}+name|Name|Tenant{B}+Name|Landlord{B}+Name|Title){B}*:(?:[_A-Za-z]|{B})*|Date{B}*:(?:[_0-9/-]|{B})*)$"
).replace("{B}", BLANK)


def is_signature(c: Column, heading: Column | None = None) -> Column:
    """Signature, date, address, contact or name lines, and any of one or two words; never headings or dotted sub-clauses."""
    t = strip(c)
    heading = parse_heading(t) if heading is None else heading
    return signs(t, heading.isNotNull(), F.size(words(t)))


def signs(t: Column, heading: Column, n: Column) -> Column:
    """is_signature() of a stripped text of n words, of which is known whether it is a heading.

    Each pattern is only looked for in texts that have a character which it asks for, or no more words than it takes.
    """
    first = F.substring(t, 1, 1)
    names = F.size(F.filter(words(t), lambda x: x.rlike("^[A-Z][a-z]+$")))
    dated = n.between(2, 8) & t.rlike("[0-9]") & t.rlike(rf"(?i)\b{ANY_DATE}\b") & (names >= 2) & (names >= n * 0.6)
    named = first.between("A", "Z") & t.rlike(NAME_ONLY)
    listed = t.contains(":") & (t.rlike(LABELLED) | t.rlike(FORM_LINE)) | t.contains(",") & t.rlike(ADDRESS)
    signed = t.contains("/") & t.rlike("(?i)/s/") | (n <= 3) & t.rlike(rf"(?i)^{ANY_DATE}$")
    dotted = first.between("0", "9") & t.rlike(r"^[0-9]+(?:\.[0-9]+)+")
    return (F.length(t) >= 3) & ~heading & ~dotted & ((n <= 2) | named | listed | signed | dated)


CONTACT_ONLY = r"(?i)^(?:By:|/s/|Signed:|Signature:|Attn:{B}+|Attention:{B}+|If{B}+to{B}+|With{B}+a{B}+copy{B}+to:)".replace("{B}", BLANK)


def is_contact(c: Column) -> Column:
    """A line that a window of nothing else is skipped for."""
    return strip(c).rlike(CONTACT_ONLY)
