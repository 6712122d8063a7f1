"""Overlapping token windows over the paragraphs of a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.headings import is_contact, is_top_heading
from pactlens.functions.text import let, strip, token_estimate, trigger_edges

WINDOW_TOKENS, STRIDE_TOKENS, MAX_CHARS, PER_PARAGRAPH = 1100, 300, 60_000, 40


def starts_of(tokens: Column, stride: int = STRIDE_TOKENS) -> Column:
    """Places where windows start: 0, then each first place that is `stride` tokens or more after the one before."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("since"), F.array(F.lit(0)).alias("out"))

    def add(s: Column, t: Column) -> Column:
        full = s["since"] + t >= stride
        return F.struct((s["at"] + 1).alias("at"), F.when(full, F.lit(0).cast("long")).otherwise(s["since"] + t).alias("since"), F.when(full, F.concat(s["out"], F.array(s["at"] + 1))).otherwise(s["out"]).alias("out"))

    return F.aggregate(tokens, zero, add, lambda s: F.filter(s["out"], lambda x: (x == 0) | (x < s["at"])))


def body(sectioned: DataFrame) -> DataFrame:
    """Paragraphs without top headings, with b, the place in the section's body, and tokens."""
    rows = sectioned.filter(~is_top_heading(F.col("heading"))) if "heading" in sectioned.columns else sectioned
    at = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("idx")) - 1
    return rows.withColumn("b", at.cast("int")).withColumn("tokens", token_estimate(F.col("text")).cast("long"))


def plan_windows(bodies: DataFrame, window: int = WINDOW_TOKENS, stride: int = STRIDE_TOKENS, fraction: float | None = 0.15) -> DataFrame:
    """doc_id, section, window_id, start_pos, end_pos (half open, in body places), main_start, main_end of every window.

    A window runs from a start to the first place where it holds `window` tokens, or to the section's end. One that lies inside the
    kept one before it leaves; ends never fall, so that is one whose end is no later. With a fraction, a window whose text has an
    exception trigger near an edge grows by about a stride on that side.

    Sums run over the exchange that also gathers a section; windows are planned within its array, so no text is copied for a start,
    and texts are gathered only where triggers are looked for.
    """
    part = Window.partitionBy("doc_id", "section").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    row = ["b", "tokens", F.sum("tokens").over(part).alias("upto"), "idx", *(["text"] if fraction is not None else [])]
    rows = bodies.select("doc_id", "section", F.struct(*row).alias("x"))
    per = rows.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list("x")).alias("p"))
    p, n = F.col("p"), F.size("p")

    def planned(sums: Column) -> Column:
        reach = lambda at, need: first_from(sums, at, n, F.get(sums, at) + need)
        starts = starts_of(F.transform(p, lambda x: x["tokens"]), stride)
        ends = F.transform(starts, lambda s: F.struct(s.alias("s"), F.greatest(reach(s, window), F.least(n, s + 1)).alias("e")))

        def grown(w: Column, edges: Column | None) -> Column:
            s, e = w["s"], w["e"]
            left, right = s, e
            if edges is not None:
                back = F.greatest(first_from(sums, F.lit(0), n, F.get(sums, s) - stride + 1) - 1, F.lit(0))
                left = F.when(edges["near_start"] & (s > 0), back).otherwise(s)
                right = F.when(edges["near_end"] & (e < n), reach(e, stride)).otherwise(e)
            name = F.format_string("w_%04d_%04d", F.get(p, s)["idx"], F.get(p, e - 1)["idx"])
            return F.struct(name.alias("window_id"), left.alias("start_pos"), right.alias("end_pos"), s.alias("main_start"), e.alias("main_end"))

        def told(w: Column) -> Column:
            if fraction is None:
                return grown(w, None)
            text = F.array_join(F.transform(F.slice(p, w["s"] + 1, w["e"] - w["s"]), lambda x: x["text"]), "\n\n")
            near = let(let(text, lambda t: trigger_edges(t, fraction)), lambda edges: grown(w, edges))
            # a window of the whole section can't grow
            return F.when((w["s"] > 0) | (w["e"] < n), near).otherwise(grown(w, None))

        return let(ends, lambda every: F.transform(F.filter(every, lambda w, i: (i == 0) | (w["e"] > F.get(every, i - 1)["e"])), told))

    sums = F.concat(F.array(F.lit(0).cast("long")), F.transform(p, lambda x: x["upto"]))
    return per.select("doc_id", "section", F.inline(let(sums, planned)))


def first_from(sums: Column, lo: Column, hi: Column, least: Column) -> Column:
    """First place from lo on, by halving, where ascending sums are at least `least`; hi if there is none before it."""
    begin = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), least.cast("long").alias("least"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        there = F.get(sums, mid) >= s["least"]
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & ~there, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & there, mid).otherwise(s["hi"]).alias("hi"), s["least"].alias("least"))

    # as many halvings as the places between have binary digits
    steps = F.length(F.bin(F.greatest(hi - lo, F.lit(0))))
    return F.aggregate(F.sequence(F.lit(1), steps), begin, halve, lambda s: s["lo"])


def members(windows: DataFrame, bodies: DataFrame) -> DataFrame:
    """A row for each paragraph of each window: the window's places are spelled out, so the join is on equality alone."""
    spelled = windows.withColumn("b", F.explode(F.sequence(F.col("start_pos"), F.col("end_pos") - 1)))
    return spelled.join(bodies.select("doc_id", "section", "b", "idx", "text", "tokens"), ["doc_id", "section", "b"])


def split_oversize(size_of: Column, start: Column, limit: int = MAX_CHARS) -> Column:
    """(part, start, end) of the parts of a window whose paragraphs have these sizes: packed greedily, one paragraph shared."""
    zero = F.struct(F.lit(0).alias("from"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        over = (s["size"] + x > limit) & (s["at"] > s["from"])
        shared = F.when(s["at"] - s["from"] > 1, s["at"] - 1).otherwise(s["at"])
        carried = F.when(s["at"] - s["from"] > 1, F.get(size_of, s["at"] - 1)).otherwise(F.lit(0).cast("long"))
        # the shared paragraph stays behind if even with it alone the next one does not fit
        alone = over & (carried + x > limit)
        begin = F.when(alone, s["at"]).otherwise(shared)
        done = F.array(F.struct(s["from"].alias("s"), s["at"].alias("e")))
        more = F.when(alone & (shared < s["at"]), F.concat(done, F.array(F.struct(shared.alias("s"), s["at"].alias("e"))))).otherwise(done)
        return F.struct(
            F.when(over, begin).otherwise(s["from"]).alias("from"),
            (s["at"] + 1).alias("at"),
            F.when(over, F.when(alone, x).otherwise(carried + x)).otherwise(s["size"] + x).alias("size"),
            F.when(over, F.concat(s["out"], more)).otherwise(s["out"]).alias("out"),
        )

    parts = F.aggregate(size_of, zero, add, lambda s: F.concat(s["out"], F.array(F.struct(s["from"].alias("s"), s["at"].alias("e")))))
    return F.transform(parts, lambda x, i: F.struct(i.alias("part"), (start + x["s"]).alias("start"), (start + x["e"]).alias("end")))


def skip_contact_windows(member_rows: DataFrame) -> DataFrame:
    """(doc_id, section, window_id) of windows with more than contact and signature lines."""
    text = strip(F.col("text"))
    return member_rows.groupBy("doc_id", "section", "window_id").agg(F.bool_and((text == "") | is_contact(F.col("text"))).alias("__only")).filter("NOT __only").drop("__only")


def chunks(member_rows: DataFrame) -> DataFrame:
    """doc_id, section, window_id, text (paragraphs with a blank line between), size (with PER_PARAGRAPH for each), n."""
    ordered = member_rows.groupBy("doc_id", "section", "window_id").agg(F.sort_array(F.collect_list(F.struct("b", "text"))).alias("p"))
    size = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]) + PER_PARAGRAPH)
    return ordered.select("doc_id", "section", "window_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), size.alias("size"), F.size("p").alias("n"))
