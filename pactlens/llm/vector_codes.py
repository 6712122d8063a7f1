"""Product codes of vectors by Yinyang Lloyd iterations on whole numbers (operator 12).

Components are scaled and floored to integers; a vector is cut into parts, each with a codebook of its own. A codebook's entries are
clustered into a few groups once. For every part of every vector an upper bound of the distance to its own entry and, for each group, a
lower bound of that to the group's other entries are kept from round to round, in the table of the round. Entries move; the bounds
drift with them. Only groups whose bound no longer keeps them away are scanned. Bounds are floats rounded outwards, distances whole
numbers, so a tie is never missed and goes to the lower index.

A round is one pass: it writes the vectors with their new bounds and, a row a task, the sums for the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, field_ddl, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries for each group, on average.
PER_GROUP = 4
#: Labels, 24 bytes each, whose totals are broadcast; more are joined by a shuffle in which each label is dealt over SALTS tasks.
BROADCAST_LABELS, SALTS = 250_000, 64
FAR = np.iinfo(np.int64).max
F32 = np.float32


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(F32), F32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(F32), F32(-np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in doubles where all sums are below 2**53, else in whole numbers."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 8 * reach * reach * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


@dataclass
class Book:
    """A part's entries, their groups, and how far each entry, and at most each group's, has moved since the last round."""

    entries: np.ndarray
    groups: np.ndarray
    moved: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max(initial=-1)) + 1

    def next(self, entries: np.ndarray) -> Book:
        moved = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(u, v))) for u, v in zip(entries, self.entries)]
        return Book(entries, self.groups, np.array(moved))


def group_entries(entries: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry by a few rounds of means, from evenly spaced entries on; groups without entries leave."""
    x = entries.astype(np.float64)
    centers = x[np.linspace(0, len(x) - 1, n).astype(int)] if len(x) else x
    at = np.zeros(len(x), np.int64)
    for _ in range(rounds if len(x) else 0):
        at = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.stack([x[at == g].mean(0) if (at == g).any() else centers[g] for g in range(n)])
    return np.unique(at, return_inverse=True)[1]


def assign(x: np.ndarray, book: Book, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries and bounds of a part of some vectors, from those of the round before; and how many distances were computed."""
    group_moved = np.array([book.moved[book.groups == g].max() for g in range(book.n_groups)])
    upper = up(upper.astype(np.float64) + book.moved[own])
    lower = down(lower.astype(np.float64) - group_moved)
    own = own.copy()
    row = np.flatnonzero(lower.min(1) <= upper)
    if not len(row):
        return own, upper, lower, 0
    part, before = x[row], own[row]
    exact = ((part - book.entries[before]) ** 2).sum(1)
    upper[row] = up(np.sqrt(exact))
    failed = lower[row] <= upper[row][:, None]
    found = np.full((len(row), len(book.entries)), FAR)
    work = len(row)
    for g in range(book.n_groups):
        hit, members = np.flatnonzero(failed[:, g]), np.flatnonzero(book.groups == g)
        if len(hit):
            found[np.ix_(hit, members)] = squared(part[hit], book.entries[members])
            work += len(hit) * len(members)
    each = np.arange(len(row))
    found[each, before] = exact
    best = found.argmin(1)  # ties to the lower index, in whole numbers
    upper[row] = up(np.sqrt(found[each, best]))
    others = found.copy()
    others[each, best] = FAR
    for g in range(book.n_groups):
        least = others[:, book.groups == g].min(1)
        bound = np.where(least == FAR, F32(np.inf), down(np.sqrt(least)))
        # an unscanned group's bound holds on; one that has lost its vector's own entry is no farther than that
        lower[row, g] = np.where(failed[:, g], bound, np.minimum(lower[row, g], bound))
    own[row] = best
    return own, upper, lower, work


def cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where the width allows it."""
    return [slice(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def sha_of(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b.entries for c in e).encode()).hexdigest()


def quantized(values: np.ndarray, scale: int) -> np.ndarray:
    q = np.floor(scale * values.astype(np.float64))
    limit = math.isqrt((1 << 62) // max(1, values.shape[1])) // 2
    if np.abs(q).max(initial=0) > limit:
        raise ValueError(f"a component beyond {limit / scale:.0f}: squared distances of such vectors don't fit 64 bits")
    return q.astype(np.int64)


def fixed_rows(column: pa.Array, dtype: str) -> np.ndarray:
    """A binary column of values of equal size as a matrix."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), dtype).reshape(len(column), -1)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad))


class Coding:
    """A run over one table of vectors: rounds, codebooks, codes."""

    def __init__(self, books: list[Book], width: int, scale: int):
        self.books, self.scale = books, scale
        self.slices = cuts(width, len(books))

    def shape(self, p: int) -> tuple[int, int]:
        return self.books[p].entries.shape[0], self.books[p].entries.shape[1] + 1

    def state_type(self) -> np.dtype:
        groups = max((b.n_groups for b in self.books), default=1)
        return np.dtype([("own", "u1", (len(self.books),)), ("upper", "<f4", (len(self.books),)), ("lower", "<f4", (len(self.books), groups))])

    def advance(self, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, int]:
        """The state of some vectors after the codebooks have moved; None before the first round."""
        if state is None:
            state = np.zeros(len(x), self.state_type())
            state["upper"] = np.inf
        out, work = np.zeros(len(x), self.state_type()), 0
        for p, (b, at) in enumerate(zip(self.books, self.slices)):
            own, upper, lower, n = assign(x[:, at], b, state["own"][:, p].astype(np.int64), state["upper"][:, p], state["lower"][:, p, : b.n_groups])
            out["own"][:, p], out["upper"][:, p], out["lower"][:, p, : b.n_groups] = own, upper, lower
            work += n
        return out, work

    def round(self, rows: DataFrame, first: bool, last: bool) -> DataFrame:
        """One pass: the rows (id, label, vector or its integers and state) with their new state, and a row of sums for each task; or, at
        last, with code and error."""
        kinds = field_ddl(rows, "id", "label")
        read = (lambda b: (quantized(fixed(b), self.scale), None)) if first else (lambda b: (fixed_rows(b.column("q"), "<i4").astype(np.int64), fixed_rows(b.column("state"), self.state_type()).reshape(-1)))

        def fixed(b):
            return b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

        def run(batches):
            sums = [np.zeros(self.shape(p), np.int64) for p in range(len(self.books))]
            kind = None
            for b in batches:
                if not b.num_rows:
                    continue
                kind = [b.schema.field(k).type for k in ("id", "label")]
                x, state = read(b)
                state, _ = self.advance(x, state)
                own = state["own"]
                if last:
                    error = sum(((x[:, at] - k.entries[own[:, p]]) ** 2).sum(1) for p, (k, at) in enumerate(zip(self.books, self.slices)))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes().hex() for r in own]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])
                    continue
                for p, at in enumerate(self.slices):
                    np.add.at(sums[p], own[:, p], np.concatenate([x[:, at], np.ones((len(x), 1), np.int64)], 1))
                raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype("<i4"), state)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *raw, pa.nulls(len(x), pa.list_(pa.int64()))], names=["id", "label", "q", "state", "sums"])
            if kind and not last:
                flat = pa.array([np.concatenate([s.reshape(-1) for s in sums])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind[0]), pa.nulls(1, kind[1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), flat], names=["id", "label", "q", "state", "sums"])

        more = "code string, error long" if last else "q binary, state binary, sums array<long>"
        return rows.mapInArrow(run, f"{kinds}, {more}")

    def update(self, written: DataFrame) -> None:
        """The next codebooks, from the sums of all tasks; the driver gets a number for each component of each entry."""
        each = written.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "s"))
        got = {r["at"]: int(r["s"]) for r in each.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
        base, books = 0, []
        for p, b in enumerate(self.books):
            k, w = self.shape(p)
            entries = b.entries.copy()
            for e in range(k):
                n = got.get(base + e * w + w - 1, 0)
                if n:
                    entries[e] = [got[base + e * w + j] // n for j in range(w - 1)]
            books.append(b.next(entries))
            base += k * w
        self.books = books


def vector_codes(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id_col, label_col, code, error of every kept vector; the final codebooks, a matrix a part).

    Null vectors, empty ones and those with null or non-finite components leave, and so do those of another length than that of the
    smallest id. Codebooks begin as the parts of the vectors of the smallest ids, nulls last, repeated ids in order of components;
    of fewer vectors there are fewer entries. Where the length is no multiple of parts, parts differ by one. Repeated rows count each.
    A component so large that squared distances don't fit 64 bits is an error that says so. An empty table gives no rows and empty
    codebooks. At most 256 entries. Only the named columns are read, so further columns can't clash.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"{entries} entries don't fit two hexadecimal digits")
    spark = vectors.sparkSession
    ship(spark)
    stage = Stage(spark, "vector-codes")
    rows = usable(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")), "vector")
    ordered = [F.col("id").asc_nulls_last(), F.col("vector").asc()]
    one = rows.orderBy(*ordered).limit(1).collect()
    width = len(one[0].vector) if one else 0
    rows = rows.filter(F.size("vector") == width)
    seeds = [r.vector for r in rows.orderBy(*ordered).limit(entries).collect()]
    q = quantized(np.array(seeds, np.float64).reshape(len(seeds), width), scale)
    n_groups = max(1, len(q) // PER_GROUP)
    books = [Book(q[:, at], group_entries(q[:, at], n_groups), np.zeros(len(q))) for at in cuts(width, parts)]
    coding = Coding(books, width, scale)
    for r in range(rounds):
        written = stage.table(coding.round(rows, first=r == 0, last=False), f"round-{r}")
        coding.update(written)
        if r:
            stage.drop(f"round-{r - 1}")
        rows = written.filter("q IS NOT NULL").select("id", "label", "q", "state")
    coded = stage.table(coding.round(rows, first=rounds == 0, last=True), "codes")
    if rounds:
        stage.drop(f"round-{rounds - 1}")
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), [b.entries for b in coding.books]


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """A column label_error: the error of all rows of the row's label, nulls together."""
    totals = coded.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), coded[label_col].eqNullSafe(totals["__label"])).drop("__label")
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    each = totals.withColumn("__each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return salted.join(each, salted[label_col].eqNullSafe(each["__label"]) & (F.col("__salt") == F.col("__each"))).drop("__label", "__salt", "__each")


def codebook_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return sha_of([Book(c, np.zeros(0, int), np.zeros(0)) for c in codebooks])
