"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network (operator 4).

Every word (a run of letters, of digits or of marks) falls into one of BUCKETS and has a sparse random index vector, made from its
hash. Its word vector is the sum of its neighbours' index vectors over the texts that the classifier is fitted on, scaled to
length 1. A document is the mean of its words' vectors and a few figures of its text. A numpy network with one hidden layer, fitted
on the labelled sample, gives a logit; a temperature, fitted on rows held back from the network, makes it a calibrated probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, ship, strings
from pactlens.llm.shingles import _BASE, _BYTE, _power, mix, text_sets, word_hashes

BUCKETS, DIMENSIONS, NONZERO = 1 << 14, 32, 4
#: Words on each side that count as neighbours.
REACH = 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
#: Labelled rows that the classifier is fitted on, those of the smallest hash, and the tasks that read them.
FIT_ROWS, FIT_TASKS = 20_000, 8
#: Score from which a document is predicted good.
GOOD = 0.7
BATCH = 2 << 20
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def index_vectors() -> np.ndarray:
    """NONZERO entries of +1 or -1 in each bucket's row."""
    rng = np.random.Generator(np.random.PCG64(11))
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIMENSIONS, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word of a batch."""
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[buf]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    start, end = edge, np.append(edge[1:], len(buf))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    forward, back = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * forward, out=total[1:])
    bucket = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _BASE) & np.uint64(BUCKETS - 1)
    ends = np.cumsum([len(x) + 1 for x in raw])
    return bucket.astype(np.int64), np.searchsorted(ends, start, "right")


def context_sums(texts: list[str], index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors for each bucket."""
    bucket, text = words(texts)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float64)
    for d in range(1, REACH + 1):
        near = text[d:] == text[:-d]
        a, b = bucket[:-d][near], bucket[d:][near]
        for j in range(DIMENSIONS):
            out[:, j] += np.bincount(a, index[b, j], BUCKETS) + np.bincount(b, index[a, j], BUCKETS)
    return out


def features(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, then figures of its length, repetition, letters and marks."""
    bucket, text = words(texts)
    n = np.bincount(text, minlength=len(texts))
    out = np.zeros((len(texts), DIMENSIONS + 6), np.float64)
    full = np.flatnonzero(n)
    start = (np.cumsum(n) - n)[full]
    if len(full):
        out[full, :DIMENSIONS] = np.add.reduceat(vectors[bucket], start) / n[full, None]
    raw = [t.encode() for t in texts]
    size = np.array([len(x) for x in raw])
    _, distinct = text_sets(texts)
    blank, at = word_hashes(b"\n".join(raw))
    per = np.bincount(np.searchsorted(np.cumsum(size + 1), at, "right"), minlength=len(texts))
    kinds = np.zeros((len(texts), 3))
    for i, x in enumerate(raw):
        b = np.frombuffer(x, np.uint8)
        kinds[i] = np.count_nonzero(_CLASS[b] == 3), np.count_nonzero((b >= 65) & (b <= 90)), np.count_nonzero(_CLASS[b] == 2)
    out[:, DIMENSIONS] = np.log1p(per)
    out[:, DIMENSIONS + 1] = 1 - distinct / np.maximum(1, per - 4)
    out[:, DIMENSIONS + 2 : DIMENSIONS + 5] = kinds / np.maximum(1, size)[:, None]
    out[:, DIMENSIONS + 5] = size / np.maximum(1, per) / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss over mini-batches, then the temperature of least log loss on every fifth row, which training leaves out."""
    rng = np.random.Generator(np.random.PCG64(3))
    width = x.shape[1]
    scale = x.std(0)
    net = Network(x.mean(0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    held = np.arange(len(y)) % 5 == 4
    z, t = ((x - net.mean) / net.scale)[~held], y[~held].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            zb, tb = z[order[at : at + 256]], t[order[at : at + 256]]
            h = np.tanh(zb @ params[0] + params[1])
            e = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - tb) / len(tb)
            dh = np.outer(e, params[2]) * (1 - h * h)
            grads = [zb.T @ dh + DECAY * params[0], dh.sum(0), h.T @ e + DECAY * params[2], np.array([e.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if held.any() and len(np.unique(y[held])) == 2:
        logit, truth = net.logits(x[held]), y[held]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / k).mean() for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network | float]:
    """(word vectors, network) from labelled rows that are not held out; with labels of one kind, or none, a constant score.

    An id labelled more than once counts as its smallest label; of several documents of one id the text of the smallest hash is used.
    """
    stage = Stage(docs.sparkSession, "classifier")
    ids = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    ids = ids.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids), "id")  # at most `rows` ids
    one = picked.withColumn("order", F.xxhash64("text")).groupBy("id", "y").agg(F.min_by("text", F.struct("order", "text")).alias("text"))
    sample = stage.table(one.select("id", "y", "text"), "sample").coalesce(FIT_TASKS)
    index = index_vectors()

    def sums(batches):
        total = np.zeros((BUCKETS, DIMENSIONS), np.float64)
        for b in by_bytes(batches, "text", BATCH):
            total += context_sums(strings(b.column("text")), index)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float64)
    for row in sample.select("text").mapInArrow(sums, "sums binary").toLocalIterator():  # FIT_TASKS rows of BUCKETS * DIMENSIONS floats
        vectors += np.frombuffer(row["sums"], np.float32).reshape(BUCKETS, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.where(length > 0, vectors / np.maximum(length, 1e-9), 0).astype(np.float32)

    def pooled(batches):
        for b in by_bytes(batches, "text", BATCH):
            x = features(strings(b.column("text")), vectors)
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["id", "y", "x"])

    got = sample.mapInArrow(pooled, "id string, y int, x array<float>").orderBy(F.xxhash64("id"), "id", "x").toPandas()  # at most `rows` labelled ids
    stage.drop("sample")
    y = got["y"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return vectors, float(y[0]) if len(y) else 1.0
    return vectors, train(np.stack(got["x"].to_numpy()).astype(np.float64), (y > 0).astype(np.int64))


def held_out(id_column):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id_col, held_out, score (0 to 1, higher for good) and predicted (score >= GOOD) of every row.

    Null and empty texts are scored as texts without words. Null and repeated ids pass through. Only the id and the text are read;
    the score depends on the text alone.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))  # a fixed size

    def run(batches):
        vectors, net = model.value
        for b in by_bytes(batches, "__text", BATCH):
            texts = strings(b.column("__text"))
            score = np.full(len(texts), net) if isinstance(net, float) else net.scores(features(texts, vectors))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("__text"))
    scored = picked.mapInArrow(run, f"{field_ddl(picked, 'id')}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
