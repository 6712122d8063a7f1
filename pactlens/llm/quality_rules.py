"""Quality rules: a learned decision list over text statistics, on DataFrame functions alone (operator 1).

Sequential covering: a rule is a conjunction of thresholds on statistics that covers documents labelled bad. It grows, threshold by
threshold, on two thirds of the labelled sample by information gain; it is cut back to the prefix that is best on the other third;
covered rows leave, and the next rule is learned from the rest. Each step is one aggregation that returns a count for each
statistic and bin. The list becomes an ordered conditional expression; documents that no rule covers are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm._common import Stage
from pactlens.llm.native import BLANKS, UPPER, count_of, let, words_of

#: Labelled rows that the list is learned from, those of the smallest hash; the bound keeps learning the same at every size.
FIT_ROWS = 20_000
#: Thresholds tried for a statistic lie midway between these many quantiles of all and of the bad rows of the sample.
QUANTILES = 24
MAX_RULES, MAX_CONDITIONS = 6, 3
#: A rule is kept if this share of what it covers in the held-back third is bad, and it covers so many bad rows there.
MIN_PRECISION, MIN_COVERED = 0.9, 3
#: Widest window of words counted as repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _repeated(words: Column) -> Column:
    """Words that lie in a WINDOW-word window which the text has twice or more, the first one included.

    Windows are compared by 64-bit hashes. If all differ there is nothing to do; else (hash, place) pairs are sorted, those beside an
    equal hash are kept, and the lengths of the union of their windows are added up.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)]))

    def beside(s: Column) -> Column:
        same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
        return F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))

    def union(p: Column) -> Column:
        length = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(length, F.lit(0), lambda a, x: a + x)

    def counted(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        places = F.sort_array(F.transform(let(pairs, beside), lambda e: e["p"]))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places, union))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted))


def statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and n_shouts of a whole text, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return {
        "__words": of_words,
        "__lines": of_lines,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS).cast("long"),
        "n_upper": count_of(text, UPPER).cast("long"),
        "n_shouts": count_of(text, "!?").cast("long"),
    }


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """row, a struct of all columns of df under their own names, and stats, a struct of the statistics and base_failed."""
    found = statistics(df[text_col])
    inner = df.select(F.struct("*").alias("row"), F.struct(*[v.alias(k) for k, v in found.items()]).alias("raw"))
    raw = F.col("raw")
    n, repeated = raw["__words"]["n"], raw["__words"]["r"]
    fields = [n.alias("n_words"), raw["word_chars"].alias("word_chars"), raw["n_symbols"].alias("n_symbols"), raw["__lines"]["n"].alias("n_lines")]
    fields += [raw["__lines"]["d"].alias("n_dup_lines"), repeated.alias("n_repeat_words")] + [raw[c].alias(c) for c in ("n_upper", "n_shouts")]
    fields.append(((n < 10) | (100 * repeated > 20 * n)).alias("base_failed"))
    return inner.select("row", F.struct(*fields).alias("stats"))


def measures(s: Column) -> dict[str, Column]:
    """What rules may test, from the struct of statistics; 0 where a denominator is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "words": s["n_words"].cast("double"),
        "word_length": share(s["word_chars"], s["n_words"]),
        "symbol_share": share(s["n_symbols"], s["word_chars"]),
        "repeat_share": share(s["n_repeat_words"], s["n_words"]),
        "dup_line_share": share(s["n_dup_lines"], s["n_lines"]),
        "line_words": share(s["n_words"], s["n_lines"]),
        "upper_share": share(s["n_upper"], s["word_chars"]),
        "shout_share": share(s["n_shouts"], s["n_words"]),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def on(self, values: dict[str, Column]) -> Column:
        return values[self.measure] > self.threshold if self.above else values[self.measure] <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class RuleList:
    rules: tuple[tuple[Condition, ...], ...] = ()

    def keeps(self, stats: Column) -> Column:
        """False for a document that a rule covers, in the list's order; else true."""
        values, out = measures(stats), F
        for rule in self.rules:
            covered = F.lit(True)
            for c in rule:
                covered = covered & c.on(values)
            out = out.when(covered, F.lit(False))
        return F.lit(True) if out is F else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("drop if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Measures, bad and grow of those of at most `rows` labelled documents that pass the base rule.

    An id labelled more than once counts as its smallest label; of several documents of one id the one of the smallest measures is taken.
    """
    ids = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids), "id")  # at most `rows` ids
    stats = with_statistics(picked, "text").filter(~F.col("stats.base_failed"))
    values = F.struct(*[v.alias(k) for k, v in measures(F.col("stats")).items()])
    one = stats.select("row.id", "row.y", values.alias("m")).groupBy("id", "y").agg(F.min("m").alias("m"))
    return one.select("m.*", (F.col("y") == 0).alias("bad"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) > 0).alias("grow"))


def simplified(conditions: list[Condition]) -> tuple[Condition, ...]:
    """Of conditions on the same side of a measure the last, which is the narrowest."""
    return tuple({(c.measure, c.above): c for c in conditions}.values())


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> RuleList:
    """Learn a list from labels (1 good, 0 bad) of a bounded sample. Without labels of both kinds the list is empty and keeps all."""
    stage = Stage(docs.sparkSession, "quality-rules")
    found = stage.table(labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows), "found")
    sample = stage.table(found.coalesce(1), "sample")  # `rows` rows at most, so that each of many small steps is one task
    stage.drop("found")
    names = [c for c in sample.columns if c not in ("bad", "grow")]
    levels = [i / QUANTILES for i in range(QUANTILES + 1)]
    cuts = sample.agg(*[F.percentile_approx(c, levels, 2000).alias(c) for c in names], *[F.percentile_approx(F.when(F.col("bad"), F.col(c)), levels, 2000).alias(f"bad {c}") for c in names]).first()
    seen = {c: sorted({*(cuts[c] or []), *(cuts[f"bad {c}"] or [])}) for c in names}
    edges = {c: [(a + b) / 2 for a, b in zip(seen[c], seen[c][1:])] for c in names}

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[c])).cast("array<double>"), lambda t: F.col(c) > t)).alias(f"bin {c}")

    binned = sample.select("bad", "grow", *names, *map(bin_of, names))

    def counts(rows: DataFrame) -> tuple[dict, dict]:
        """Bad and good rows of the growing third by measure and bin, and the held-back totals."""
        grow = {c: [[0, 0] for _ in range(len(edges[c]) + 1)] for c in names}
        held = [0, 0]
        cells = rows.select("bad", "grow", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"bin {c}").alias("b")) for c in names])).alias("x"))
        for r in cells.groupBy("bad", "grow", "x.c", "x.b").count().collect():  # as many rows as there are bins
            if r["grow"]:
                grow[r["c"]][r["b"]][not r["bad"]] += r["count"]
            elif r["c"] == names[0]:
                held[not r["bad"]] += r["count"]
        return grow, held

    rules: list[tuple[Condition, ...]] = []
    values = {c: F.col(c) for c in names}
    rest = binned
    while len(rules) < MAX_RULES:
        conditions: list[Condition] = []
        rows, cover = rest, []
        grow, held = counts(rows)
        while len(conditions) < MAX_CONDITIONS:
            p0, n0 = (sum(x[k] for x in grow[names[0]]) for k in (0, 1))
            if not p0 or not n0:
                break
            best, chosen = 0.0, None
            for c in names:
                below = [0, 0]
                for b, t in enumerate(edges[c]):
                    below = [below[0] + grow[c][b][0], below[1] + grow[c][b][1]]
                    for above, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best + 1e-9:
                            best, chosen = gain, Condition(c, above, t)
            if chosen is None:
                break
            conditions.append(chosen)
            rows = rows.filter(chosen.on(values))
            grow, held = counts(rows)
            cover.append(held)
        worth = [((p - n) / (p + n) if p + n else -1.0, p) for p, n in cover]
        if not worth:
            break
        at = max(range(len(worth)), key=lambda i: (worth[i][0], worth[i][1], -i))
        p, n = cover[at]
        if p < MIN_COVERED or p / (p + n) < MIN_PRECISION:
            break
        rule = simplified(conditions[: at + 1])
        rules.append(rule)
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.on(values)
        rest = rest.filter(~hit)
    stage.drop("sample")
    return RuleList(tuple(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the statistics, base_failed and kept of every document, a row each.

    A null text counts as empty and, as any text of fewer than ten words, fails the base rule. Null ids are scored but never
    labelled; repeated rows and ids are scored each. Other columns are not read.
    """
    rules = fit(docs, labels, id_col=id_col, text_col=text_col)
    picked = with_statistics(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text")
    return picked.select(F.col("row.id").alias(id_col), "stats.*", (~F.col("stats.base_failed") & rules.keeps(F.col("stats"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns under any name, that pass the base rule and that no learned rule covers.

    Null, empty and short texts fail the base rule; repeated rows are judged alike; an empty table stays empty.
    """
    rules = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = with_statistics(docs, text_col)
    return scored.filter(~F.col("stats.base_failed") & rules.keeps(F.col("stats"))).select("row.*")
