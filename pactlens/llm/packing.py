"""Packing of tokenized documents into sequences of power-of-two length (operator 13).

A document of n tokens is cut into whole sequences of the longest length and, for the rest, one piece for each binary digit of its
number, the longest first. Each piece is a sequence by itself: none crosses documents and none is padded. Equal lengths form a
bucket, from which batches of one shape are drawn; sequence ids run through the buckets, longest first.

No shuffle moves the ids: a task numbers the sequences of each bucket that it makes, and the counts of the tasks, a row for a task
and bucket, say where its numbers begin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, ship
from pactlens.llm.token_binary import tokenizing

LONGEST = 4096
#: Bytes of an id in a sequence.
WIDTH = 4
#: Counts of tasks and buckets, 32 bytes each, that are broadcast to number the sequences; more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the powers of two of the rest, falling."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def cut(df: DataFrame, vocabulary: str, *, end_id: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """id_col, start, length, ids, doc_tokens, and part, place: the task that made the piece and its number among those of its length."""
    end = end_id.to_bytes(WIDTH, "little")

    def run(batches):
        own = tokenizing(vocabulary, WIDTH)
        part = TaskContext.get().partitionId()
        made = np.zeros(longest.bit_length(), np.int64)
        for b in by_bytes(batches, "__text"):
            raw = own.ids([x or b"" for x in b.column("__text").cast(pa.binary()).to_pylist()], end)
            tokens = np.fromiter((len(x) // WIDTH for x in raw), np.int64, len(raw))
            lengths = [binary_lengths(n, longest) for n in tokens.tolist()]
            pieces = np.fromiter(map(len, lengths), np.int64, len(raw))
            length = np.fromiter((n for x in lengths for n in x), np.int64, int(pieces.sum()))
            upto = np.cumsum(length)
            doc = np.repeat(np.arange(len(raw)), pieces)
            start = upto - length - np.repeat(np.cumsum(tokens) - tokens, pieces)
            place = np.empty(len(length), np.int64)
            for bits in range(len(made)):
                at = np.flatnonzero(length == 1 << bits)
                place[at] = made[bits] + np.arange(len(at))
                made[bits] += len(at)
            ends = pa.py_buffer(np.concatenate([[0], upto * WIDTH]).astype(np.int64).tobytes())
            ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, ends, pa.py_buffer(b"".join(raw))])
            numbers = [pa.array(x, pa.int64()) for x in (tokens[doc], np.full(len(length), part), place)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ids.cast(pa.binary()), *numbers],
                names=[id_col, "start", "length", "ids", "doc_tokens", "part", "place"],
            )

    picked = df.select(df[id_col], df[text_col].alias("__text"))
    return picked.mapInArrow(run, f"{field_ddl(picked, id_col)}, start long, length long, ids binary, doc_tokens long, part long, place long")


def pack(df: DataFrame, vocabulary: str, *, end_id: int = 2, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start, length, ids (little-endian, 32 bits), doc_tokens, sequence_id and offset of every piece of every document.

    Null texts count as empty and have the end id alone. Null and repeated ids pass through, each row a document. An empty table
    gives no rows. Only id_col and text_col are read, so further columns can't clash. Sequence ids are gapless from 0, the longest
    sequences first, then in the order of the input's partitions; the offset is 0, as a piece is all its sequence holds.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"{longest} is no power of two")
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "packing")
    pieces = stage.table(cut(df, vocabulary, end_id=end_id, longest=longest, id_col=id_col, text_col=text_col), "pieces")
    counts = stage.table(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    buckets = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each power of two
    base, first = F, 0
    for length in sorted(buckets, reverse=True):
        base = base.when(F.col("length") == length, F.lit(first).cast("long"))
        first += buckets[length]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", (F.coalesce(before, F.lit(0)) + (base if buckets else F.lit(0))).alias("__first"))
    if counts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    numbered = pieces.join(starts, ["length", "part"])
    return numbered.select(id_col, "start", "length", "ids", "doc_tokens", (F.col("__first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet under a folder for each length, in order of sequence_id, so that a file holds sequences of one shape."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed.repartitionByRange(n, "sequence_id").sortWithinPartitions("sequence_id").write.partitionBy("length").parquet(path)
