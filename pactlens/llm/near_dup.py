"""MinHash near-duplicates by tensored banding (operator 3).

Two collections of M sub-keys, each the hash of R minhashes, give M * M tables: the key of table (i, j) combines sub-key i of the one
with sub-key j of the other, so that 2 * M * R minhashes do the work of 2 * R * M * M. Two sets of similarity s share a table with
probability (1 - (1 - s**R)**M)**2; for s = 0.75, R = 2, M = 10 that is 0.9995, for s = 0.8 it is 0.9999, and groups are linked many times.

Equal sets are one class from the start. In a table's bucket each class meets the smallest one (a star, not all pairs); candidates
that could reach the threshold are verified on their full sets, and linked classes become components. Only then do classes that
share a bucket but not a component meet each other, each pair once, so that a link inside a large bucket is not lost. Such pairs
come out of the join only if their sizes and parity bitmaps allow the threshold; both are bounds that lose no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, ship, strings
from pactlens.llm.shingles import identity, mix, parity, text_sets

M, R = 10, 2
#: Similarity in hundredths from which two sets are linked.
THRESHOLD = 75
#: Of 4-bit prints of all 2 * M * R minhashes, pairs at the threshold agree in 30.6 on average with a deviation of 2.7; fewer than
#: this (5.8 deviations below) are not verified.
MIN_AGREEING = 15
#: Numbers of 64 bits in a set's parity bitmap. It refutes nearly all pairs under 0.72 for sets of up to some hundred shingles.
BITMAP = 8
#: Ids up to which the documents whose sets are needed are found by a broadcast (8 bytes each).
BROADCAST_IDS = 500_000
_rng = np.random.Generator(np.random.PCG64(7))
_SALT = _rng.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 62, 2 * M * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRINT_BITS = 21


def signature(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Minhashes, one row per set and 2 * M * R columns; those of empty sets are 0."""
    out = np.zeros((len(size), 2 * M * R), np.uint64)
    full = np.flatnonzero(size)
    start = (np.cumsum(size) - size)[full]
    if len(full):
        for k in range(2 * M * R):
            out[full, k] = np.minimum.reduceat((hashes ^ _SALT[k]) * _FACTOR[k], start)
    return out


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low `bits` of each column of a row, packed into as few int64 columns as hold them whole."""
    per = 64 // bits
    out = np.zeros((len(values), -(-values.shape[1] // per)), np.uint64)
    for k in range(values.shape[1]):
        out[:, k // per] |= (values[:, k] & np.uint64((1 << bits) - 1)) << np.uint64(bits * (k % per))
    return out.view(np.int64)


def _longs(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version (a hash of the text), n (size of the set), c1, c2 (its name), keys (sub-keys), marks (4 bits of each minhash), prints (21 bits of each sub-key), bits (a parity bitmap)."""
    picked = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("__text"))

    def run(batches):
        for b in by_bytes(batches, "__text", 4 << 20):
            hashes, size = text_sets(strings(b.column("__text")))
            c1, c2 = identity(hashes, size)
            least = signature(hashes, size)
            keys = np.zeros((len(size), 2 * M), np.uint64)
            for k in range(R):
                keys = mix(keys + least[:, k::R])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("version"), pa.array(size.astype(np.int64)), pa.array(c1), pa.array(c2), _longs(keys.view(np.int64)), _longs(packed(mix(least), 4)), _longs(packed(keys, PRINT_BITS)), _longs(parity(hashes, size, BITMAP))],
                names=["id", "version", "n", "c1", "c2", "keys", "marks", "prints", "bits"],
            )

    return picked.mapInArrow(run, f"{field_ddl(picked, 'id')}, version long, n long, c1 long, c2 long, keys array<long>, marks array<long>, prints array<long>, bits array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c1, c2 (a set's name) and s (its hashes) of the documents whose id is in ids.id."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(ids, F.col("__id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches):
        for b in by_bytes(batches, "__text", 4 << 20):
            hashes, size = text_sets(strings(b.column("__text")))
            c1, c2 = identity(hashes, size)
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))], names=["c1", "c2", "s"])

    return picked.select("__text").mapInArrow(run, "c1 long, c2 long, s array<long>")


def _agreeing(a: Column, b: Column) -> Column:
    """How many 4-bit fields of two arrays of packed prints are equal."""
    fields, total = 2 * M * R, F.lit(0)
    for k in range(-(-fields // 16)):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(y)
    return F.lit(fields) - total


def _could_link(a: str, b: str) -> Column:
    """Sizes, parity bitmaps and prints allow the threshold. Similar sets differ in (1 - s) / (1 + s) of the sum of their sizes at most."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.lit(0)
    for k in range(BITMAP):
        apart = apart + F.bit_count(F.get(F.col(f"{a}.bits"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{b}.bits"), F.lit(k))))
    near = (100 * F.least(na, nb) >= THRESHOLD * F.greatest(na, nb)) & ((100 + THRESHOLD) * apart <= (100 - THRESHOLD) * (na + nb))
    return near & (_agreeing(F.col(f"{a}.marks"), F.col(f"{b}.marks")) >= MIN_AGREEING)


def _first_table(at: Column, a: Column, b: Column) -> Column:
    """Table `at` is the first that the two share: no earlier sub-key of either collection has equal prints."""
    per, mask = 64 // PRINT_BITS, (1 << PRINT_BITS) - 1
    out = F.lit(True)
    for side, own in ((0, F.floor(at / M)), (1, at % M)):
        for k in range(M - 1):
            f = side * M + k
            differs = F.shiftrightunsigned(F.get(a, F.lit(f // per)).bitwiseXOR(F.get(b, F.lit(f // per))), PRINT_BITS * (f % per)).bitwiseAND(F.lit(mask)) != 0
            out = out & ((own <= k) | differs)
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose full sets reach the threshold."""
    right = pairs.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    both = right.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * same >= THRESHOLD * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(c, root): for every node of edges (a, b) the smallest node of its component, by alternating large and small stars."""
    now = stage.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    before, step = None, 0  # a step's tables go when the next one is written
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("c"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before, step = mark, step + 1
        around = now.union(now.select(F.col("v"), F.col("u")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.table(large.filter("u <> v").distinct(), f"{name}-{step}-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stage.table(small.filter("u <> v").distinct(), f"{name}-{step}")
        stage.drop(f"{name}-{step}-large", f"{name}-{step - 1}")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version, n and component of every row; see near_duplicates."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "near-dup")
    rows = stage.table(sketches(docs, id_col, text_col), "rows")
    filled = rows.filter("n > 0")
    classes = filled.groupBy("c1", "c2").agg(F.min("id").alias("id"), *[F.first(x).alias(x) for x in ("n", "keys", "marks", "prints", "bits")])
    classes = stage.table(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so that c stays

    # one row for each class and table; rows that are alone in their bucket leave at once
    sub = lambda k: F.get(F.col("keys"), k)
    tables = F.transform(F.sequence(F.lit(0), F.lit(M * M - 1)), lambda t: F.xxhash64(t, sub(F.floor(t / M).cast("int")), sub(M + t % M)))
    dealt = classes.select("c", F.posexplode(tables).alias("at", "key"))
    bucket = Window.partitionBy("key")
    shared = dealt.withColumn("least", F.min("c").over(bucket)).withColumn("most", F.max("c").over(bucket)).filter("least < most").drop("most")
    shared = stage.table(shared, "shared")

    info = classes.select("c", "n", "marks", "bits")
    star = shared.filter("c > least").select(F.col("least").alias("a"), F.col("c").alias("b")).distinct()
    star = star.join(info.alias("x"), F.col("a") == F.col("x.c")).join(info.alias("y"), F.col("b") == F.col("y.c")).filter(_could_link("x", "y")).select("a", "b")
    star = stage.table(star, "star")

    def fetch(pairs: DataFrame, name: str) -> DataFrame:
        needed = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b"))).distinct()
        needed = stage.table(needed.join(classes.select("c", "c1", "c2", "id"), "c"), f"{name}-needed")
        found = sets_of(docs, needed.select("id").distinct(), id_col, text_col).join(needed.select("c", "c1", "c2"), ["c1", "c2"])
        return stage.table(found.select("c", "s").dropDuplicates(["c"]), name)

    links = stage.table(verified(star, fetch(star, "star-sets")), "star-links")
    stage.drop("star-sets")
    roots = stage.table(components(links, stage, "first"), "first-roots")

    # the rest of the pairs: classes that share a bucket, but no component; those outside the bucket's largest component meet all others
    placed = shared.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", F.col("top.root").alias("main"))
    alive = placed.join(mixed, "key").join(classes.select("c", "n", "marks", "prints", "bits"), "c").select("key", "at", "c", "root", "main", "n", "marks", "prints", "bits")
    alive = stage.table(alive, "apart")
    x, y = alive.filter("root <> main").alias("x"), alive.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
    rest = x.join(y, meet & _could_link("x", "y") & _first_table(F.col("x.at"), F.col("x.prints"), F.col("y.prints")))
    rest = rest.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).join(star, ["a", "b"], "left_anti").distinct()
    rest = stage.table(rest, "rest")
    more = stage.table(verified(rest, fetch(rest, "rest-sets")), "rest-links")
    stage.drop("rest-sets", "apart", "shared")

    roots = components(links.union(more), stage, "all")
    joined = classes.select("c", "c1", "c2", "id").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = joined.groupBy("root").agg(F.min("id").alias("component"))
    named = joined.join(least, "root").select("c1", "c2", "component")
    out = rows.select("id", "version", "n", F.when(F.col("n") > 0, F.col("c1")).alias("c1"), "c2").join(named, ["c1", "c2"], "left")
    return out.select("id", "version", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id of the component) and kept (id_col = component_id), a row a document.

    Null, empty and blank texts have an empty set and are alone; a text of one to four words has its whole sequence as its only
    shingle. Repeated rows are in one component, and rows that share the smallest id are all kept. A null id is larger than any
    other; a component of null ids alone has a null component_id, and its rows are kept. Only id_col and text_col are read.
    """
    out = _grouped(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with their columns, that near_duplicates keeps: of each component those with its smallest id."""
    gone = _grouped(docs, id_col, text_col).filter(~F.col("id").eqNullSafe(F.col("component"))).select("id", "version").distinct()
    gone = Stage(docs.sparkSession, "near-dup-gone").table(gone, "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    d, g = docs.alias("d"), gone.alias("g")
    return d.join(g, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("g.version")), "left_anti")
