"""Text cleaning and measuring as Spark column expressions.

All take and give columns, treat null as the empty text, and stay inside the JVM. Character classes are spelled out because Java's
\\s, \\d and \\w are ASCII: BLANK is every character that Unicode counts as white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, in the syntax that Java and RE2 share.
BLANK = r"[ \t\n\r\f\x0B\x1C-\x1F\x85\xA0\p{Z}]"
#: The same characters, one by one.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PAGE_LINE = rf"(?imd)^{BLANK}*(?:Page{BLANK}*)?-{BLANK}*\p{{Nd}}+{BLANK}*-{BLANK}*$"
PAGE_FRAGMENT = rf"(?i)Page{BLANK}*-{BLANK}*\p{{Nd}}+{BLANK}*-{BLANK}*"
CONTROL_OR_BLOCK = r"[\x00-\x08\x0B\x0E-\x1F\x7F\x{25A0}-\x{25FF}]"
NOT_PRINTABLE = r"[^\n\t\p{L}\p{N}\p{P}\p{S}\p{Z}]"
#: Words that open an exception to a clause.
TRIGGER = r"(?i)\b(except|provided that|subject to|notwithstanding|unless)\b"
EDGE_FRACTION = 0.15


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text_of(c), F.lit(BLANKS))


def bare(c: Column) -> Column:
    """strip() of a column that is at hand, as it is named often: a text with a visible character of ASCII at either end needs no search."""
    seen = lambda x: x.between("!", "~")
    return F.when(seen(F.left(c, F.lit(1))) & seen(F.right(c, F.lit(1))), c).otherwise(strip(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; where body names it often, Catalyst would put the whole expression in each place."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Any character but the printable ones of ASCII. Without one a text has no white space but single characters, which the rules below use.
NOT_PLAIN = r"[^ -~]"


def words(c: Column) -> Column:
    """The runs between white space. Plain texts are split at a character, which needs no pattern."""
    s = text_of(c)
    return F.array_remove(F.when(s.rlike(NOT_PLAIN), F.split(s, rf"{BLANK}+")).otherwise(F.split(s, " ")), "")


def normalize(c: Column) -> Column:
    """Line ends as \\n, without page numbers, trailing blanks, long gaps and what can't be shown; stripped.

    All rules but those of page numbers, which have a hyphen, are about characters that a plain text lacks; its only white space is a blank.
    """
    s = text_of(c)
    return F.when(s.rlike(r"[^ -,.-~]"), _normalized(s)).otherwise(F.trim(s))


def _normalized(c: Column) -> Column:
    s = F.regexp_replace(c, r"\r\n?", "\n")
    s = F.translate(s, "\f\u037e", "\n;")
    s = F.regexp_replace(s, PAGE_LINE, "")
    s = F.regexp_replace(s, PAGE_FRAGMENT, "")
    s = F.regexp_replace(s, r"[ \t]+\n", "\n")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, CONTROL_OR_BLOCK, " ")
    s = F.regexp_replace(s, NOT_PRINTABLE, " ")
    return strip(s)


def squeeze(c: Column) -> Column:
    """Lower case, single spaces."""
    s = text_of(c)
    return F.when(s.rlike(NOT_PLAIN) | s.contains("  "), F.regexp_replace(strip(F.lower(s)), rf"{BLANK}+", " ")).otherwise(F.lower(F.trim(s)))


def match_key(c: Column) -> Column:
    """What quotes are compared by."""
    return let(normalize(c), squeeze)


def token_estimate(c: Column) -> Column:
    """Four characters a token; 0 for blank texts, else 1 at least."""
    n = F.length(strip(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int"))).cast("int")


def count_class(c: Column, cls: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, cls, ""))


def upper_ratio(c: Column) -> Column:
    """Upper-case letters among letters, 0 without letters."""
    return F.coalesce(F.try_divide(count_class(c, r"\p{Lu}").cast("double"), count_class(c, r"\p{L}").cast("double")), F.lit(0.0))


def title_ratio(c: Column) -> Column:
    """Words that begin upper-case and have a lower-case letter, among words."""
    w = words(c)
    return F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.rlike(r"(?s)^\p{Lu}.*\p{Ll}"))).cast("double"), F.size(w).cast("double")), F.lit(0.0))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital and the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    capital = lambda x: F.when(x.startswith("ß"), F.lit("Ss")).otherwise(F.upper(F.substring(x, 1, 1)))
    return F.array_join(F.transform(runs, lambda x: F.concat(capital(x), F.lower(F.substring(x, 2, 1 << 30)))), "")


def join_hyphens(c: Column) -> Column:
    """A word broken by a hyphen and \\n is joined; then line ends become \\n."""
    return F.regexp_replace(F.regexp_replace(text_of(c), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), r"\r\n?", "\n")


def strip_page_fragment(c: Column) -> Column:
    return strip(F.regexp_replace(text_of(c), rf"(?i)^{BLANK}*Page{BLANK}*-{BLANK}*\p{{Nd}}+{BLANK}*-{BLANK}*", ""))


def bullet_kind(c: Column) -> Column:
    # no pattern asks for more than six characters; one that fails would be tried at each place of a longer text
    s = F.left(F.ltrim(text_of(c), F.lit(BLANKS)), F.lit(6))
    return (
        F.when(s.rlike(rf"^[-*\x{{2022}}]{BLANK}+"), F.lit("symbol"))
        .when(s.rlike(rf"^\(?\p{{Nd}}{{1,3}}[).\]]{BLANK}+"), F.lit("number"))
        .when(s.rlike(rf"^[A-Za-z][).\]]{BLANK}+"), F.lit("letter"))
        .otherwise(F.lit(""))
    )


def is_bullet(c: Column) -> Column:
    return bullet_kind(c) != ""


def has_trigger(c: Column) -> Column:
    return text_of(c).rlike(TRIGGER)


def trigger_edges(c: Column, fraction: float = EDGE_FRACTION) -> Column:
    """struct(near_start, near_end): the first trigger begins, the last one begins, within the outer fraction of the text."""
    s = text_of(c)
    n = F.length(s)
    edge = F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0).cast("int"))
    first = F.regexp_instr(s, F.lit(TRIGGER)) - 1
    last = F.length(F.regexp_extract(s, r"(?is)^(.*)\b(except|provided that|subject to|notwithstanding|unless)\b", 1))
    told = lambda start, end: F.struct(start.alias("near_start"), end.alias("near_end"))
    # most texts have none, and needn't be read from both ends
    return F.when(has_trigger(s), told(first <= edge, last >= F.greatest(F.lit(0), n - edge))).otherwise(told(F.lit(False), F.lit(False)))


def slug(c: Column) -> Column:
    s = F.replace(F.lower(strip(c)), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def without_label(c: Column, label: str) -> Column:
    """Stripped, and without a leading `label:` in any case."""
    s = strip(c)
    return F.when(F.lower(s).startswith(f"{label}:"), strip(F.substring(s, len(label) + 2, 1 << 30))).otherwise(s)


def short_label(c: Column) -> Column:
    """Up to the first en dash, else em dash, else hyphen."""
    s = strip(c)
    cut = F.when(F.instr(s, "–") > 0, F.split_part(s, F.lit("–"), F.lit(1))).when(F.instr(s, "—") > 0, F.split_part(s, F.lit("—"), F.lit(1)))
    return squeeze(cut.otherwise(F.split_part(s, F.lit("-"), F.lit(1))))


def escape_html(c: Column) -> Column:
    s = text_of(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def upload_name(job: Column, name: Column) -> Column:
    """job__name with letters, digits and -_. and space kept; upload.pdf where nothing is left."""
    kept = F.regexp_replace(text_of(name), r"[^\p{L}\p{N}\-_. ]", "")
    return F.concat(job, F.lit("__"), F.when(kept == "", F.lit("upload.pdf")).otherwise(kept))
