"""Line dedup by an exact set-similarity join (operator 10).

A line's tokens are its distinct five-word shingles (its whole sequence if it has fewer words). They are ordered by how rare they
are in the corpus; two sets of similarity 0.75 or more have a token in common among the first n - ceil(0.75 n) + 1 of each. So only
those prefixes are joined, under the length filter and the positional filter, and the surviving pairs are verified on full sets.

A line goes if an earlier line of the corpus, in the order (document, line), is equal or similar to it. Only the existence of one
earlier match matters: under each prefix token a set first meets the earliest one alone (a star). Where many share a token, those still
without a match meet the earliest of themselves (a second star). Those without a match after that meet the others. Rarity only orders tokens, and any one order gives the same result: counts are kept in a table of a fixed size.

Before full sets are fetched, parity bitmaps refute candidates; they bound the symmetric difference from below and lose no pair. Lines
are equal if both 64-bit names of their sets are; pairs of candidates go by the first name alone, and all sets of that name are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, ship, strings
from pactlens.llm.native import BLANKS, let
from pactlens.llm.shingles import identity, line_sets, parity

#: Similarity in hundredths from which two lines match.
THRESHOLD = 75
#: Cells of the table of token counts (4 bytes each, shared by all tokens of the same low bits).
RARITY_CELLS = 1 << 18
#: Cells that go through the shuffle as one row.
RARITY_BLOCK = 1 << 12
#: Ids up to which the documents whose line sets are needed are found by a broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Names of sets in candidate pairs up to which these sets are found by a broadcast (8 bytes each); else by a join.
BROADCAST_NAMES = 1_000_000
#: Removed lines (and their documents) up to which they go to the texts by a broadcast, about 16 bytes each; else by a join.
BROADCAST_LINES = 2_000_000
#: Sets with lines to remove up to which they go to the lines by a broadcast, about 60 bytes each and the id; else by a join.
BROADCAST_SETS = 200_000
BATCH = 2 << 20
#: Sets under a token from which those without a match meet the earliest of themselves before they meet all others; the result is the same.
CROWD = 8
#: Columns of the wide parity bitmap, 64 bits each.
WIDE = ["w1", "w2", "w3", "w4"]


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many lines hold the tokens of each cell, over all documents."""

    def run(batches):
        total = np.zeros(RARITY_CELLS, np.int64)
        for b in by_bytes(batches, "__text", BATCH):
            hashes, *_ = line_sets(strings(b.column("__text")))
            total += np.bincount((hashes & np.uint64(RARITY_CELLS - 1)).astype(np.int64), minlength=RARITY_CELLS)
        yield blocks(dict(enumerate(total.reshape(-1, RARITY_BLOCK))))

    def add(batches):
        total = {}
        for b in batches:
            for k, n in zip(b.column("block").to_pylist(), b.column("n").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, np.int64)
        yield blocks(total)

    def blocks(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n.tobytes() for n in total.values()], pa.binary())], names=["block", "n"])

    form = "block long, n binary"
    out = np.zeros(RARITY_CELLS, np.int64)
    for k, n in docs.select(docs[text_col].alias("__text")).mapInArrow(run, form).repartition("block").mapInArrow(add, form).collect():  # RARITY_CELLS numbers
        out[k * RARITY_BLOCK : (k + 1) * RARITY_BLOCK] = np.frombuffer(n, np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - -(-THRESHOLD * n // 100) + 1


def ranked(hashes: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all tokens, set after set, in each by rarity (the count's number of bits), then by hash."""
    rare = np.frexp(counts[(hashes & np.uint64(RARITY_CELLS - 1)).astype(np.int64)].astype(np.float64))[1].astype(np.uint64)
    unit = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    bits = max(1, len(size).bit_length())
    if bits > 20:
        return np.lexsort((hashes, rare, unit))
    left = np.uint64(bits + 6)
    return np.argsort((unit << np.uint64(64 - bits)) | (rare << np.uint64(58 - bits)) | (hashes >> left))


def scan(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each line with words: its place, its set's name (c, b) and size n; tokens of its prefix, empty where the batch has
    sent the set's already, or where a set of one or two tokens can match equal sets alone; a small parity bitmap, and a wide one."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # RARITY_CELLS numbers

    def run(batches):
        counts = shared.value
        for b in by_bytes(batches, "__text", BATCH):
            hashes, size, text, line = line_sets(strings(b.column("__text")))
            c, b1 = identity(hashes, size)
            first = np.zeros(len(c), bool)
            first[np.unique(c, return_index=True)[1]] = True
            send = first & (size > 2)
            held = hashes[np.repeat(send, size)]
            n = size[send]
            order = ranked(held, n, counts)
            place = np.arange(len(held)) - np.repeat(np.cumsum(n) - n, n)
            sent = np.zeros(len(size), np.int64)
            sent[send] = prefix_length(n)
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(sent))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(held[order][place < np.repeat(prefix_length(n), n)].view(np.int64)))
            small = np.zeros(len(size), np.int64)
            small[send] = parity(held % np.uint64(PARITY_BITS), n, 1)[:, 0]
            wide = np.zeros((len(size), len(WIDE)), np.int64)
            wide[send] = parity(held, n, len(WIDE))
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(rows), b.column("version").take(rows), pa.array(line.astype(np.int64)), pa.array(c), pa.array(b1), pa.array(size.astype(np.int64)), tokens, pa.array(small), *map(pa.array, wide.T)],
                names=["id", "version", "line", "c", "b", "n", "tokens", "parity", *WIDE],
            )

    return docs.mapInArrow(run, f"{field_ddl(docs, 'id')}, version long, line long, c long, b long, n long, tokens array<long>, parity long, {', '.join(f'{w} long' for w in WIDE)}")


def sets_of(docs: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, b and s, the hashes, of the wanted sets among the lines of the documents in ids.id."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.join(ids.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("__text")

    def run(batches):
        for b in by_bytes(batches, "__text", BATCH):
            hashes, size, *_ = line_sets(strings(b.column("__text")))
            c, b1 = identity(hashes, size)
            big = np.flatnonzero(size > 2)
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size[big]))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes[np.repeat(size > 2, size)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c[big]), pa.array(b1[big]), found], names=["c", "b", "s"])

    return picked.mapInArrow(run, "c long, b long, s array<long>").join(wanted, "c", "left_semi").dropDuplicates(["c", "b"])


#: Bits of a token's row for the coarse order of the document, a parity bitmap of the set, the set's size and the token's place in the
#: order; sizes and places that are larger are not filtered.
ORDER_BITS, PARITY_BITS, SIZE_BITS, PLACE_BITS = 12, 21, 16, 14


def packed(order: Column, parity: Column, n: Column, p: Column) -> Column:
    """All in one number, smaller for earlier documents."""
    size, place = F.least(n, F.lit((1 << SIZE_BITS) - 1)), F.least(p, F.lit((1 << PLACE_BITS) - 1))
    out = F.shiftleft(order, PARITY_BITS).bitwiseOR(parity)
    return F.shiftleft(F.shiftleft(out, SIZE_BITS).bitwiseOR(size.cast("long")), PLACE_BITS).bitwiseOR(place.cast("long"))


def _size(np: Column) -> Column:
    return F.shiftright(np, PLACE_BITS).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def coarse_order(docs: DataFrame) -> Column:
    """The place of an integer id between the least and the greatest, in ORDER_BITS bits; it only chooses which set of a token is the star."""
    if docs.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.lit(0).cast("long")
    low, high = docs.agg(F.min("id"), F.max("id")).first()
    if low is None or high == low:
        return F.lit(0).cast("long")
    share = (F.col("id").cast("double") - F.lit(float(low))) / F.lit(float(high - low))
    return F.coalesce((F.least(share, F.lit(1.0)) * F.lit((1 << ORDER_BITS) - 1)).cast("long"), F.lit(0).cast("long"))


def _bits_allow(apart: Column, sizes: Column) -> Column:
    """Similar sets differ in (1 - s) / (1 + s) of the sum of their sizes at most."""
    return (100 + THRESHOLD) * apart <= (100 - THRESHOLD) * sizes


def _could_match(a: str, b: str) -> Column:
    """Length filter, bitmap filters, and positional filter: with this as the first common token the rest must hold enough."""
    x, y = F.col(f"{a}.np"), F.col(f"{b}.np")
    p = lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    na, nb = _size(x), _size(y)
    large = (F.greatest(na, nb) == (1 << SIZE_BITS) - 1) | (F.greatest(p(x), p(y)) == (1 << PLACE_BITS) - 1)
    rest = F.least(na - p(x), nb - p(y))
    apart = F.bit_count(F.shiftright(x.bitwiseXOR(y), SIZE_BITS + PLACE_BITS).bitwiseAND(F.lit((1 << PARITY_BITS) - 1)))
    wide = F.lit(0)
    for w in WIDE:
        wide = wide + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    near = (100 * F.least(na, nb) >= THRESHOLD * F.greatest(na, nb)) & _bits_allow(apart, na + nb) & _bits_allow(wide, na + nb)
    return large | (near & ((100 + THRESHOLD) * rest >= THRESHOLD * (na + nb)))


def _with(pairs: DataFrame, side: str, table: DataFrame) -> DataFrame:
    """The pairs with the columns of the sets of the name on one side, their names preceded by it."""
    named = table.select(*[F.col(c).alias(side if c == "c" else f"{side}_{c}") for c in table.columns])
    return pairs.join(named, side)


def _later(pairs: DataFrame, sets: DataFrame, places: DataFrame) -> DataFrame:
    """Of the pairs whose full sets reach the threshold, the set (c, b) that first stands later in the corpus."""
    both = _with(_with(pairs, "b", sets), "a", sets)
    same = F.size(F.array_intersect("a_s", "b_s"))
    sure = both.filter(100 * same >= THRESHOLD * (F.size("a_s") + F.size("b_s") - same)).select("a", "a_b", "b", "b_b")
    first = lambda side: places.select(F.col("c").alias(side), F.col("b").alias(f"{side}_b"), F.col("first").alias(f"{side}_first"))
    placed = sure.join(first("a"), ["a", "a_b"]).join(first("b"), ["b", "b_b"])
    later = F.when(F.col("a_first") < F.col("b_first"), F.struct(F.col("b").alias("c"), F.col("b_b").alias("b")))
    return placed.select(later.otherwise(F.struct(F.col("a").alias("c"), F.col("a_b").alias("b"))).alias("x")).select("x.*").distinct()


def removed_lines(docs: DataFrame, stage: Stage) -> DataFrame:
    """(id, version, gone): the numbers of the lines that go, for each document with any. docs: id, version, __text."""
    lines = stage.table(scan(docs, rarity(docs, "__text")), "lines")
    firsts = stage.table(lines.groupBy("c", "b").agg(F.min(F.struct("id", "version", "line")).alias("first"), F.count(F.lit(1)).alias("held")), "firsts")
    info = lines.filter(F.size("tokens") > 0).select("c", *WIDE).dropDuplicates(["c"])

    # tokens that one set alone has leave at once, then the rows that several batches sent of one set are made one; then the wide bitmaps
    # come in, and each token's star, a set of the first documents
    dealt = lines.select("c", coarse_order(docs).alias("o"), "parity", "n", F.posexplode("tokens").alias("p", "token"))
    dealt = dealt.select("token", "c", packed(F.col("o"), F.col("parity"), F.col("n"), F.col("p")).alias("np"))
    by_token = Window.partitionBy("token")
    several = dealt.withColumn("last", F.max("c").over(by_token)).withColumn("least", F.min("c").over(by_token)).filter("least < last")
    several = several.groupBy("token", "c").agg(F.min("np").alias("np"))
    several = stage.table(several.select("token", "c", "np"), "several")
    stage.free()
    grouped = several.join(info, "c").withColumn("head", F.min(F.struct("np", "c", *WIDE)).over(by_token)).withColumn("crowd", F.count(F.lit(1)).over(by_token))
    grouped = stage.table(grouped.select("token", "c", "np", *WIDE, "head", "crowd"), "grouped")
    stage.drop("several")
    stage.free()
    others = grouped.filter("c <> head.c")

    def paired(candidates: DataFrame, first: str, second: str) -> DataFrame:
        return candidates.select(F.least(f"{first}.c", f"{second}.c").alias("a"), F.greatest(f"{first}.c", f"{second}.c").alias("b")).distinct()

    def matches(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stage.table(pairs, name)
        needed = stage.table(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b"))).distinct(), f"{name}-names")
        if needed.count() <= BROADCAST_NAMES:
            needed = F.broadcast(needed)
        places = stage.table(firsts.drop("held").join(needed, "c", "left_semi"), f"{name}-places")
        sets = stage.table(sets_of(docs, places.select("first.id").distinct(), needed), f"{name}-sets")
        later = stage.table(_later(pairs, sets, places), f"{name}-later")
        stage.drop(f"{name}-names", f"{name}-places", f"{name}-sets")
        stage.free()
        return later

    star = others.select(F.struct("c", "np", *WIDE).alias("x"), F.col("head").alias("y")).filter(_could_match("x", "y"))
    matched = matches(paired(star, "x", "y"), "star")

    def flagged(matched: DataFrame) -> DataFrame:
        # under a token of two sets the head has met the other one
        names = matched.select("c").distinct().withColumn("matched", F.lit(True))
        if names.count() <= BROADCAST_NAMES:
            names = F.broadcast(names)
        return others.filter("crowd > 2").drop("head").join(names, "c", "left")

    # where many sets share a token, those without an earlier match so far meet the earliest of themselves, so that a group of sets
    # similar to each other and not to the head is found by one pair a set
    alone = flagged(matched).filter(F.col("matched").isNull() & (F.col("crowd") >= CROWD)).withColumn("head", F.min(F.struct("np", "c", *WIDE)).over(by_token))
    second = alone.filter("c <> head.c").select(F.struct("c", "np", *WIDE).alias("x"), F.col("head").alias("y")).filter(_could_match("x", "y"))
    met = stage.spark.read.schema("a long, b long").parquet(stage.at("star"))
    matched = matched.union(matches(paired(second, "x", "y").join(met, ["a", "b"], "left_anti"), "second"))

    # the sets still without one meet the others under their tokens, and two such sets meet once
    rows = flagged(matched)
    x, y = rows.alias("x"), rows.filter(F.col("matched").isNull()).alias("y")
    once = (F.col("x.c") != F.col("y.c")) & (F.col("x.matched").isNotNull() | (F.col("x.c") < F.col("y.c")))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & once & _could_match("x", "y"))
    met = met.union(stage.spark.read.schema("a long, b long").parquet(stage.at("second")))
    more = matches(paired(rest, "x", "y").join(met, ["a", "b"], "left_anti"), "rest")
    stage.drop("grouped", "star", "second", "rest")

    # only sets of several lines, or similar to an earlier one, have lines that go
    similar = matched.union(more).distinct().withColumn("similar", F.lit(True))
    marked = stage.table(firsts.filter("held > 1").drop("held").join(similar, ["c", "b"], "full"), "marked")
    if marked.count() <= BROADCAST_SETS:
        marked = F.broadcast(marked)
    placed = lines.select("id", "version", "line", "c", "b").join(marked, ["c", "b"])
    gone = placed.filter(F.coalesce("similar", F.lit(False)) | (F.struct("id", "version", "line") != F.col("first")))
    return gone.groupBy("id", "version").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs with the text less its repeated lines, and __n_lines (lines with words) and __n_gone (those removed).

    Lines are the parts between line feeds; one without words always stays, as do null and empty texts. Equal documents of one id
    keep the same lines, since they stand at the same place; documents of one id but different texts follow the order of a hash of
    the text; null ids come first. drop_emptied leaves out documents that had lines with words and lost them all. All columns pass
    under any name, but for columns that are themselves called __n_lines or __n_gone: these give way to the counts.
    """
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "line-dedup")
    version = F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)).cast("long")
    keyed = docs.select(docs[id_col].alias("id"), version.alias("version"), docs[text_col].alias("__text"))
    gone = stage.table(removed_lines(keyed, stage), "gone")
    stage.drop("lines", "firsts", "star-later", "second-later", "rest-later", "marked")
    whole = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), version.alias("version"), docs[text_col].alias("text"))
    gone = gone.select(F.col("id").alias("of_id"), F.col("version").alias("of_version"), "gone")
    if gone.agg(F.sum(1 + F.size("gone"))).first()[0] in range(BROADCAST_LINES):
        gone = F.broadcast(gone)
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version")), "left")
    numbered = F.split("text", "\n")

    def left(parts: Column) -> Column:
        stay = F.array_except(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i.cast("long")), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i.cast("int"))), "\n")

    worded = F.size(F.filter(numbered, lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")
    zero = F.lit(0).cast("long")
    out = joined.withColumn("n_lines", F.coalesce(worded, zero)).withColumn("n_gone", F.coalesce(F.size("gone").cast("long"), zero))
    if drop_emptied:  # a text that loses no line stays, and its lines need no count
        out = out.filter("gone IS NULL OR n_gone < n_lines")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(numbered, left))
    others = [c for c in docs.columns if c not in ("__n_lines", "__n_gone")]
    passed = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in others]
    return out.select(*passed, F.col("n_lines").alias("__n_lines"), F.col("n_gone").alias("__n_gone"))
