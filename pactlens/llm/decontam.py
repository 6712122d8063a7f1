"""Benchmark decontamination by a prefix-filtered set join, on DataFrame functions alone (operator 7).

An item's windows are sets of word shingles with their places. The shingles are ordered by how rare they are in the whole corpus. A
document that contains a window contains all its shingles, so for exact containment a prefix of one shingle, the rarest, is enough:
documents join windows on it alone. Where such a shingle occurs, the window must begin at that place less the shingle's offset
(positional bound) and end within the document (length bound); the words there are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm._common import Stage
from pactlens.llm.native import let, lower_ascii

#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: Rows of shingles (about 30 bytes) or windows (about 150 bytes) up to which a table made from the items is broadcast.
BROADCAST_ROWS = 250_000


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and all characters from U+0080; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: w_id, words, n, items (the sorted ids, as strings, of the items that hold it)."""
    words = items.select(items[item_col].cast("string").alias("item"), alnum_words(items[text_col]).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (WINDOW - 1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("all"), i, WINDOW))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("w_id"), "words", F.size("words").alias("n"), "items")


def shingles(words: Column, width: int) -> Column:
    """An array of (p, s): place from 0, and 64-bit hash of the `width` words there."""

    def joined(h: Column) -> Column:
        firsts = F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - (width - 1)))
        return F.transform(firsts, lambda x, i: F.struct(i.alias("p"), F.xxhash64(F.lit(width), x, *[F.get(h, i + j) for j in range(1, width)]).alias("s")))

    return let(F.transform(words, lambda w: F.xxhash64(w)), joined)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def occurrences(docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(heads, found): each document's key and number of words; each document with a window: key and its occurrences (start, n, items)."""
    windows = stage.table(windows_of(items, item_col, item_text_col), "windows")
    n_windows = windows.count()
    per = F.when(F.col("n") >= SHINGLE, shingles(F.col("words"), SHINGLE))
    for width in range(1, SHINGLE):
        per = per.when(F.col("n") == width, shingles(F.col("words"), width))
    parts = stage.table(windows.select("w_id", "n", F.inline(per)), "parts")  # w_id, n, p, s
    widths = [r[0] for r in parts.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # SHINGLE numbers at most
    wanted = stage.table(parts.select("s").distinct(), "wanted")

    source = docs.select(docs[id_col].alias("k1"), F.xxhash64(docs[text_col]).alias("k2"), docs[text_col].alias("text"))

    def tokens(words: Column) -> Column:
        head = F.array(F.struct(F.size(words).alias("p"), F.lit(None).cast("long").alias("s")))
        return F.concat(head, *[shingles(words, k) for k in sorted(widths)])

    # one row a document, its number of words at s = null, and one for each place of a shingle that some window has
    each = source.select("k1", "k2", F.inline(let(alnum_words(F.col("text")), tokens)))
    marked = each.join(_small(wanted.withColumn("hit", F.lit(True)), wanted.count()), "s", "left").filter("s IS NULL OR hit").select("k1", "k2", "p", "s")
    hits = stage.table(marked, "hits")
    heads = hits.filter("s IS NULL").select("k1", "k2", F.col("p").cast("long").alias("n_words"))
    places = hits.filter("s IS NOT NULL")

    # rarity over all documents; a window with a shingle that no document has can't occur
    rarity = places.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "s", "p"))
    prefix = parts.join(rarity, "s", "left").groupBy("w_id", "n").agg(rarest.alias("r")).filter("r.df > 0").select("w_id", "n", F.col("r.s").alias("s"), F.col("r.p").alias("offset"))
    prefix = stage.table(prefix, "prefix")
    begun = places.join(_small(prefix, n_windows), "s").select("k1", "k2", (F.col("p") - F.col("offset")).alias("start"), "n", "w_id").filter("start >= 0")
    begun = begun.join(_small(windows.select("w_id", "words", "items"), n_windows), "w_id")
    candidates = begun.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "words", "items")).alias("begun"))

    same = source.withColumnRenamed("k1", "d1").withColumnRenamed("k2", "d2").join(candidates, F.col("d1").eqNullSafe(F.col("k1")) & (F.col("d2") == F.col("k2")))

    def verified(words: Column) -> Column:
        fits = lambda c: (c["start"] + c["n"] <= F.size(words)) & (F.slice(words, c["start"] + 1, c["n"]) == c["words"])
        return F.filter(F.col("begun"), fits)

    sure = same.select("k1", "k2", let(alnum_words(F.col("text")), verified).alias("found")).filter(F.size("found") > 0)
    found = sure.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["items"].alias("items"))).alias("found"))
    return heads, found


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, items (sorted ids as strings), contaminated; a row for each document row.

    A document word is hit if it lies in an occurrence of a window. Null and empty texts have no words, neither hit nor hold
    windows; an item without words has no window, and without items nothing is hit. Repeated document rows get equal rows, as do
    null ids; items with one id share it; an item with a null id hits words but is not listed. Only the named columns are read.
    """
    stage = Stage(docs.sparkSession, "decontam")
    heads, found = occurrences(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, stage=stage)

    def covered(at: Column) -> Column:
        """Length of the union of [start, start + n) over occurrences sorted by start."""
        step = lambda a, c: F.struct(
            (a["n"] + F.greatest(F.lit(0), c["start"] + c["n"] - F.greatest(c["start"], a["end"]))).alias("n"), F.greatest(a["end"], c["start"] + c["n"]).alias("end")
        )
        return F.aggregate(F.sort_array(at), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    spans = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n")))
    listed = F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"]))))
    hit = found.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), covered(spans).cast("long").alias("n_hit"), listed.alias("items"))
    rows = heads.join(hit, F.col("k1").eqNullSafe(F.col("f1")) & F.col("k2").eqNullSafe(F.col("f2")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("k1").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        items.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with their columns under any name, in which no window of an item occurs. Null and empty texts stay."""
    stage = Stage(docs.sparkSession, "decontam")
    _, found = occurrences(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, stage=stage)
    hit = stage.table(found.select(F.col("k1").alias("id"), F.col("k2").alias("version")), "hit")
    stage.drop("windows", "parts", "wanted", "hits", "prefix")
    d, g = docs.alias("d"), _small(hit, hit.count()).alias("g")
    return d.join(g, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("g.version")), "left_anti")
