"""Importance resampling of a corpus towards a target by hashed word features (operator 11).

Features are the runs of one to `grams` words; their bucket is the CRC-32 of their bytes modulo `buckets`. A first pass writes the
corpus as packed 16-bit bucket streams, a row for a block of documents, with the documents' sizes. The streams are sorted run by run
and run-length encoded, so counts of buckets are all that is shuffled. A last pass over the streams, not the texts, gathers the
buckets' gains and adds them up document by document. Weights get a Gumbel noise of the id's hash; the highest scores are drawn.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, ship
from pactlens.llm.token_binary import Remembered

BUCKETS, SHARE, MIN_WORDS, SEED = 10_000, 25, 20, 7
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Text bytes of a block, if it is not one longer document; a reader of the streams holds some thousand blocks at once.
BLOCK_BYTES = 128 << 10
#: Features that are sorted in one run.
RUN_FEATURES = 4 << 20
#: Distinct words that a worker remembers before it begins anew.
CACHE_WORDS = 500_000
#: Words of more bytes are added to a CRC one occurrence at a time, shorter ones by table.
TABLED = 64


def shift_tables(longest: int = TABLED) -> np.ndarray:
    """[n, k, v]: what byte k of a CRC, of value v, becomes when n zero bytes follow. A CRC's parts do so independently of each other."""
    step = np.array([zlib.crc32(bytes([v])) for v in range(256)], np.uint32)
    step ^= step[0]
    one = lambda c: (c >> np.uint32(8)) ^ step[c & np.uint32(255)]
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest + 1):
        out[n] = one(out[n - 1])
    return out


class Hashing:
    """Bucket streams of texts. A pair's CRC is made of those of its words, so that each distinct word is hashed once."""

    def __init__(self, buckets: int, grams: int = 2):
        self.buckets, self.grams, self.tables = buckets, grams, shift_tables()
        self.reset()

    def reset(self) -> None:
        self.words: list[bytes] = []
        self.number = Remembered(self.add)
        self.crc, self.spaced, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, word: bytes) -> int:
        self.words.append(word)
        return len(self.words) - 1

    def longer(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRCs after a blank and the word."""
        size = self.size[word] + 1
        after = np.zeros(len(crc), np.uint32)
        near = np.minimum(size, TABLED)
        for k in range(4):
            after ^= self.tables[near, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        out = after ^ self.spaced[word]
        for i in np.flatnonzero(size > TABLED):
            out[i] = zlib.crc32(b" " + self.words[word[i]], int(crc[i]))
        return out

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, features of each text, words of each text): a text's words, then its pairs."""
        if len(self.words) > CACHE_WORDS:
            self.reset()
        found = [WORD.findall(t.lower()) for t in texts]  # bytes: A-Z alone are lowered
        n = np.fromiter(map(len, found), np.int64, len(texts))
        known = len(self.words)
        word = np.fromiter((i for w in found for i in map(self.number.__getitem__, w)), np.int64, int(n.sum()))
        if len(self.words) > known:
            new = self.words[known:]
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
            self.spaced = np.concatenate([self.spaced, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new))])
        ends = np.cumsum(n)
        crc = self.crc[word]
        size = n.copy()
        levels = [(crc, np.arange(len(word)))]
        for g in range(2, self.grams + 1):
            crc, at = levels[-1]
            held = np.repeat(ends, n)[at] - at >= g  # the run stays within its text
            at = at[held]
            levels.append((self.longer(crc[held], word[at + g - 1]), at))
            size += np.maximum(n - g + 1, 0)
        out = np.empty(int(size.sum()), np.uint16)
        text = np.repeat(np.arange(len(texts)), n)
        first, begin = np.cumsum(size) - size, ends - n
        for g, (crc, at) in enumerate(levels):
            to = first[text[at]] + at - begin[text[at]]
            out[to + sum(np.maximum(n - k, 0) for k in range(g))[text[at]] if g else to] = crc % np.uint32(self.buckets)
        return out, size, n


def streams(df: DataFrame, *, id_col: str | None, text_col: str, buckets: int, grams: int, seed: int) -> DataFrame:
    """A row for each block: ids, their hashes, words and features of each document, and the stream of buckets."""
    spark = df.sparkSession
    ship(spark)
    key = df[id_col] if id_col else F.lit(None).cast("long")
    spread = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    picked = df.select(key.alias("__id"), F.conv(F.substring(spread, 1, 8), 16, 10).cast("long").alias("__hash"), df[text_col].alias("__text"))
    kind = picked.schema["__id"].dataType.simpleString()

    def run(batches):
        own = Hashing(buckets, grams)
        for b in by_bytes(batches, "__text", BLOCK_BYTES):
            out, size, n = own.stream([x or b"" for x in b.column("__text").cast(pa.binary()).to_pylist()])
            row = lambda a: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), a)
            yield pa.RecordBatch.from_arrays(
                [row(b.column(0)), row(b.column(1)), row(pa.array(n)), row(pa.array(size)), pa.array([out.astype("<u2").tobytes()], pa.binary())],
                names=["ids", "hashes", "n_words", "n_features", "stream"],
            )

    return picked.mapInArrow(run, f"ids array<{kind}>, hashes array<long>, n_words array<long>, n_features array<long>, stream binary")


def runs_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream, ascending, and how often each occurs: sorted and run-length encoded."""
    s = np.sort(stream, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded runs as one."""
    value, n = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    order = np.argsort(value, kind="stable")
    value, n = value[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[at], np.add.reduceat(n, at) if len(at) else n


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all blocks are in each bucket; the driver gets no more than a number for each."""

    def run(batches):
        held, size = [], 0
        runs = [runs_of(np.zeros(0, np.uint16))]
        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= RUN_FEATURES:
                    runs = [merge_runs([*runs, runs_of(np.concatenate(held))])]
                    held, size = [], 0
        value, n = merge_runs([*runs, runs_of(np.concatenate(held))]) if held else runs[0]
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], names=["bucket", "n"])

    found = blocks.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a feature of the bucket is in the target, rounded down; each bucket counts one more."""
    s, t = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    ratio = ((float(b + 1) * float(s)) / (float(a + 1) * float(t)) for a, b in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def scores(blocks: DataFrame, gains: np.ndarray, *, id_col: str) -> DataFrame:
    """id_col, n_words, n_features, weight, score of every document of the blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                ids, hashes, n, size = (b.column(c).flatten() for c in ("ids", "hashes", "n_words", "n_features"))
                size = size.to_numpy(zero_copy_only=False)
                stream = np.frombuffer(b.column("stream")[0].as_buffer(), "<u2")
                weight, full = np.zeros(len(size), np.int64), np.flatnonzero(size)
                if len(full):
                    weight[full] = np.add.reduceat(gains[stream], (np.cumsum(size) - size)[full]) // size[full]
                noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in hashes.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, n, pa.array(size), pa.array(weight), pa.array(weight + np.array(noise, np.int64))], names=[id_col, "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long")


def importance(
    docs: DataFrame, target: DataFrame, *, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, grams: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank (1 for the highest score drawn, null if not drawn) of every row of docs.

    Of the rows with min_words words, floor(share * N / 100) of the highest scores are drawn, ties by id_col, nulls first, then by
    weight and size. Null and empty texts have no features, a weight of 0 and are not drawn. Repeated rows count and are drawn each
    for itself; a null id hashes as an empty one. An empty docs table gives no rows, an empty target only smooths. Only the named
    columns are read, so further columns can't clash. At most 65,536 buckets.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets don't fit 16 bits")
    stage = Stage(docs.sparkSession, "resampling")
    how = {"buckets": buckets, "grams": grams, "seed": seed}
    own = stage.table(streams(docs, id_col=id_col, text_col=text_col, **how), "streams")
    wanted = streams(target, id_col=None, text_col=target_col, **how)
    gains = gains_of(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    scored = stage.table(scores(own, gains, id_col=id_col), "scores")
    stage.drop("streams")
    # scores are whole thousandths of logarithms: their number is bounded by a corpus' logarithm (some 100,000), not by its documents
    per = sorted(((r.score, r.n) for r in scored.filter(F.col("n_words") >= min_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    quota, above, cells = sum(n for _, n in per) * share // 100, 0, []
    for score, n in per:
        if above >= quota:
            break
        cells.append((score, above))
        above += n
    names = ["n_words", "n_features", "weight", "score"]
    if not cells:
        return scored.select(id_col, *names, F.lit(None).cast("long").alias("rank"))
    near = scored.join(F.broadcast(docs.sparkSession.createDataFrame(cells, "score long, __above long")), "score", "left")
    may = F.col("__above").isNotNull() & (F.col("n_words") >= min_words)
    at = F.col("__above") + F.row_number().over(Window.partitionBy("score").orderBy(id_col, "weight", "n_features", "n_words"))
    drawn = near.filter(may).withColumn("rank", at).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.select(id_col, *names, "rank").unionByName(near.filter(~may).select(id_col, *names, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that importance() draws, with all their columns; where an id is repeated, all its rows if one is drawn."""
    kept = importance(docs, target, id_col=id_col, **how).filter("rank IS NOT NULL").select(F.col(id_col).alias("__drawn"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__drawn"]), "left_semi")
