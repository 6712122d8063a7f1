"""Secret scans: fixed patterns, and values that would be hard to guess (operator 2).

Three patterns give the base spans. Besides, the value that follows a credential word (its context) is split into parts, words of a
ranked list, dates, repeats, keyboard walks and brute-force runs, so that the number of guesses is least; the search is a dynamic
program over the value's places. A value that takes MIN_GUESSES or more is reported with the kind "guess".
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm._common import by_bytes, field_ddl, ship, strings

#: Decimal logarithm of the guesses from which a value counts as a secret.
MIN_GUESSES = 10.0
#: Shorter values are too easily words.
MIN_VALUE = 8
#: Longest unit of a repeat, and the least length of a keyboard walk.
MAX_UNIT, MIN_WALK = 64, 4
#: Units of a value whose cost is remembered at once.
MAX_UNITS = 20_000
#: What each part after the first costs for its place in the split.
NEXT_PART = 0.3
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
KINDS = [*BASE, "guess"]
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: A credential word, up to two further words of its name, a mark or a linking word, and the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth|bearer|login|pin)(?:[ _-][a-z]{1,12}){0,2}["']?\s{0,3}(?::|=>?|\bis\b)\s{0,3}["']?([!-~]{8,})""",
    re.I | re.A,
)
#: Rows of common keyboards.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Signs that stand for letters.
LEET = str.maketrans("4@301!$57", "aaeoiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d|(?:19|20)\d\d)")


class Ranks(dict):
    """Ranks of words, and the length of the longest."""

    longest = 0


@lru_cache(maxsize=1)
def word_ranks(vocabulary: str) -> Ranks:
    """Rank, from 1, of the letter words of three or more characters in a vocabulary file whose ids follow frequency."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = Ranks()
    for token, _ in sorted(vocab.items(), key=lambda x: x[1]):
        word = token.lstrip("Ġ").lower()
        if len(word) > 2 and word.isascii() and word.isalpha():
            out.setdefault(word, len(out) + 1)
    out.longest = max(map(len, out), default=0)
    return out


@lru_cache(maxsize=1)
def neighbours() -> frozenset[str]:
    """Pairs of keys side by side, in either direction, and of one column in neighbouring rows."""
    out = set()
    for r, row in enumerate(ROWS):
        out.update(row[i : i + 2] for i in range(len(row) - 1))
        if r:
            above = ROWS[r - 1]
            out.update(a + b for i, b in enumerate(row) for a in above[i + (r == 1) : i + (r == 1) + 2])
    return frozenset(out | {p[::-1] for p in out})


#: Character classes, with how many characters each has.
CLASSES = (10, 26, 26, 33)
#: Of each set of classes (its bits) the logarithm of the alphabet's size.
ALPHABET = [math.log10(max(1, sum(n for i, n in enumerate(CLASSES) if s >> i & 1))) for s in range(1 << len(CLASSES))]


def class_of(c: str) -> int:
    return 1 if c.isdigit() else 2 if c.islower() else 4 if c.isupper() else 8


def brute(text: str) -> float:
    """log10 of the guesses for a run of characters of the classes that it has."""
    kinds = 0
    for c in text:
        kinds |= class_of(c)
    return len(text) * ALPHABET[kinds]


def word_cost(own: str, low: str, plain: str, ranks: dict[str, int]) -> float:
    """Of a word of the list, also in other cases or with signs for letters; infinite for others."""
    r = ranks.get(low) or ranks.get(plain)
    if r is None:
        return math.inf
    return math.log10(r + 1) + math.log10(2) * (own != low and own.upper() != own) + 0.3 * (own != low) + 0.3 * (plain != low)


def repeat_cost(unit: float, times: int) -> float:
    """Of a unit that is repeated, from what its own cheapest split takes."""
    return unit + math.log10(times)


def walk_cost(size: int) -> float:
    return math.log10(94 * 2) + 0.4 * size


DATE_COST = math.log10(365 * 120)


def guesses(value: str, ranks: dict[str, int], limit: float = math.inf, units: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest split takes, or `limit` if it takes more.

    best[j] is the cost of the first j characters. A last part that ends at j is a word, a date, a repeat of a unit, a keyboard walk or
    a brute-force run over the classes that it has. Words, dates and units are bounded in length. For walks, and for runs over each set
    of classes, only the cheapest beginning is remembered, since all grow by the same amount. For repeats of a unit, beginnings that
    can't become the cheapest any more are dropped; a unit is priced by its own cheapest split, which `units` remembers. So time grows with the length of the value alone, as far as best stays below the limit.
    """
    n = len(value)
    units = {} if units is None else units
    low = value.lower()
    plain = low.translate(LEET)
    near = neighbours()
    longest = ranks.longest if isinstance(ranks, Ranks) else max(map(len, ranks), default=0)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if m := DATE.match(value, i):
            dates.setdefault(m.end(), []).append(i)
    best = [0.0] + [math.inf] * n
    runs = [math.inf] * len(ALPHABET)  # cheapest beginning of a run over each set of classes, less what its length costs
    walk = math.inf  # the same for a walk
    steps = 0  # neighbouring pairs up to here
    same = [0] * (MAX_UNIT + 1)  # how many characters up to here equal the one a unit before
    begun: dict[tuple[int, int], list[tuple[int, float]]] = {}  # (unit's length, place modulo it): beginnings and their costs
    alive = 0
    reach = max(longest, 2 * MAX_UNIT, 10) + 1
    for j in range(1, n + 1):
        i = j - 1
        start = best[i] + (NEXT_PART if i else 0.0)
        kind = class_of(value[i])
        least = math.inf
        for s in range(1, len(ALPHABET)):
            if s & kind:
                runs[s] = min(runs[s], start - i * ALPHABET[s])
                least = min(least, runs[s] + j * ALPHABET[s])
            else:
                runs[s] = math.inf
        steps = steps + 1 if i and low[i - 1 : j] in near else 0
        if steps == 0:
            walk = math.inf
        if steps >= MIN_WALK - 1:
            at = j - MIN_WALK
            walk = min(walk, best[at] + (NEXT_PART if at else 0.0) + walk_cost(0) - 0.4 * at)
            least = min(least, walk + 0.4 * j)
        for size in range(3, min(longest, j) + 1):
            at = j - size
            if (before := best[at]) < least:
                least = min(least, before + (NEXT_PART if at else 0.0) + word_cost(value[at:j], low[at:j], plain[at:j], ranks))
        for at in dates.get(j, ()):
            least = min(least, best[at] + (NEXT_PART if at else 0.0) + DATE_COST)
        for u in range(1, min(MAX_UNIT, i) + 1):
            if low[i] != low[i - u]:
                same[u] = 0
                continue
            same[u] += 1
            if same[u] >= u:
                least = min(least, _repeated(best, j, u, same[u], _unit(value[j - 2 * u : j - u], ranks, units), limit, begun))
        best[j] = least if least < limit else math.inf
        if best[j] < math.inf:
            alive = j
        elif j - alive > reach:
            break
    return min(best[n], limit)


def _unit(unit: str, ranks: dict[str, int], units: dict[str, float]) -> float:
    cost = units.get(unit)
    if cost is None:
        if len(units) >= MAX_UNITS:  # begin anew; results don't depend on it
            units.clear()
        cost = units[unit] = guesses(unit, ranks, units=units)
    return cost


def _repeated(best: list[float], j: int, u: int, same: int, unit: float, limit: float, begun: dict[tuple[int, int], list[tuple[int, float]]]) -> float:
    """The least cost of a split whose last part repeats a unit of u characters, itself of cost `unit`, up to j. same: u more than that many repeat.

    A beginning is dropped once a later one costs no more, or once an earlier one is at least as good here: the difference that the
    number of times makes only shrinks.
    """
    first = j - u - same  # the earliest place from which all repeats
    begins = [b for b in begun.get((u, j % u), ()) if b[0] >= first]
    at = j - 2 * u
    cost = best[at] + (NEXT_PART if at else 0.0) + unit
    if cost < limit:
        begins = [b for b in begins if b[1] < cost] + [(at, cost)]
    kept, least = [], math.inf
    for b in begins:  # from the earliest
        total = b[1] + math.log10((j - b[0]) // u)
        if total < least:
            kept.append(b)
            least = total
    begun[u, j % u] = kept
    return least


def spans_of(text: str, ranks: dict[str, int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind as listed. Base spans, and guess spans that no base span overlaps."""
    out = []
    for m in BASE["assign"].finditer(text):
        if len(m[2]) >= MIN_ASSIGN:
            out.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in BASE["access"].finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in BASE["hex"].finditer(text)]
    base = sorted((s, e) for s, e, _ in out)
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip("\"'.,;:)!?")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) >= MIN_VALUE and not any(s < end and start < e for s, e in base) and guesses(value, ranks, MIN_GUESSES) >= MIN_GUESSES:
            out.append((start, end, "guess"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], order[x[2]], x[1]))


def scan_secrets(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans: array of (kind, start, end) in code points, end exclusive, by start and then kind; a row for each row.

    Null and empty texts have none; null and repeated ids pass through. A context's value is looked at once, by the whole-text
    pattern's leftmost match. Only id_col and text_col are read, so further columns can't clash.
    """
    ship(df.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        ranks = word_ranks(vocabulary)
        for b in by_bytes(batches, "__text"):
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t, ranks)] for t in strings(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    picked = df.select(df[id_col], df[text_col].alias("__text"))
    return picked.mapInArrow(run, f"{field_ddl(picked, id_col)}, spans array<struct<kind: string, start: bigint, end: bigint>>")
