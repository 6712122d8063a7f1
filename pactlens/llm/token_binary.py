"""Token ids in binary files, coded by a static range asymmetric numeral system (operator 8).

A corpus is tokenized once and its ids are counted; the counts, scaled to a power of two, are the one frequency table that all
files share. Each file holds a run of documents in ascending order. Its tokens are cut into independent blocks; a block is coded
by interleaved lanes, token i by lane i mod lanes, all lanes in one numpy step. The file's index is a list of checkpoints, a block's
first token, place, size and CRC-32 of its ids, so that blocks can be decoded in parallel and damage is found.

File (little-endian): MAGIC, sizes of the three parts, blocks, index (numpy records), documents (Arrow stream), a line feed.
"""

from __future__ import annotations

import io
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm._common import Stage, by_bytes, field_ddl, read_blobs, ship, write_blobs

MAGIC = b"RANSIDS1"
#: Lower bound of a lane's state; states stay below 2**63 and are renormalized by 32-bit words.
LOW = 1 << 31
#: Bits of the scaled frequencies.
BITS = 20
LANES = 2048
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 23
INDEX = np.dtype([("first", "<u8"), ("tokens", "<u8"), ("at", "<u8"), ("size", "<u8"), ("lanes", "<u4"), ("crc32", "<u4")])
#: Distinct pieces, and words without their marks, that a worker remembers before it begins anew.
CACHE_PIECES = 400_000
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Frequencies:
    """A scaled frequency for each id that occurs; they add up to 2**bits."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int = BITS):
        if len(ids) > 1 << bits:
            raise ValueError(f"{len(ids)} ids need more than {bits} bits")
        self.ids, self.bits = np.asarray(ids, np.uint32), bits
        total, target = int(counts.sum()), 1 << bits
        f = np.maximum(1, np.round(counts * (target / max(total, 1)))).astype(np.int64)
        over = int(f.sum()) - target
        for i in np.argsort(-f, kind="stable"):  # the most frequent pay for the rounding
            if not over or not len(f):
                break
            take = min(over, int(f[i]) - 1) if over > 0 else over
            f[i] -= take
            over -= take
        self.f = f.astype(np.uint64)
        self.c = np.cumsum(self.f) - self.f
        self.place = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 1, np.uint32)
        self.place[self.ids] = np.arange(len(self.ids))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.f.astype(np.int64))
        return self._slots


def encode_block(table: Frequencies, ids: np.ndarray, lanes: int = LANES) -> tuple[bytes, int]:
    """Final states and renormalization words of one block, and the number of lanes."""
    lanes = max(1, min(lanes, len(ids) // 64 or 1))
    sym = table.place[ids]
    f, c = table.f[sym], table.c[sym]
    bits, low32 = np.uint64(table.bits), np.uint64(0xFFFFFFFF)
    x = np.full(lanes, LOW, np.uint64)
    top = np.uint64((LOW >> table.bits) << 32)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        ft, ct = f[at : at + lanes], c[at : at + lanes]
        xt = x[: len(ft)]
        full = xt >= top * ft
        words.append((xt[full] & low32).astype("<u4"))
        xt = np.where(full, xt >> np.uint64(32), xt)
        q = xt // ft
        x[: len(ft)] = (q << bits) + (xt - q * ft) + ct
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words)), lanes


def decode_block(table: Frequencies, data: bytes, tokens: int, lanes: int) -> np.ndarray:
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    out = np.empty(tokens, np.uint32)
    bits, mask, at_word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    slots, f, c = table.slots, table.f, table.c
    for at in range(0, tokens, lanes):
        xt = x[: min(lanes, tokens - at)]
        slot = xt & mask
        sym = slots[slot.astype(np.int64)]
        out[at : at + lanes] = sym
        xt = f[sym] * (xt >> bits) + slot - c[sym]
        need = np.flatnonzero(xt < LOW)
        xt[need] = (xt[need] << np.uint64(32)) | words[at_word : at_word + len(need)]
        at_word += len(need)
        x[: len(xt)] = xt
    if at_word != len(words) or np.any(x != LOW):
        raise ValueError("the block's states do not end where they began")
    return table.ids[out]


def encode_file(table: Frequencies, ids: np.ndarray, docs: pa.Table, partition: int, number: int, block_tokens: int = BLOCK_TOKENS) -> bytes:
    blocks, index, at = [], [], 0
    for first in range(0, len(ids), block_tokens):
        part = ids[first : first + block_tokens]
        data, lanes = encode_block(table, part)
        blocks.append(data)
        index.append((first, len(part), at, len(data), lanes, zlib.crc32(part.astype("<u4").tobytes())))
        at += len(data)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    tail = np.array(index, INDEX).tobytes()
    return MAGIC + struct.pack("<IIQQQ", partition, number, at, len(tail), len(sink.getvalue())) + b"".join(blocks) + tail + sink.getvalue()


def decode_file(table: Frequencies, data: bytes, blocks: slice = slice(None)) -> tuple[tuple[int, int], np.ndarray, pa.Table]:
    """((partition, number), ids of the chosen blocks, documents). Raises ValueError where a checksum fails."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of coded token ids")
    head = struct.Struct("<IIQQQ")
    partition, number, body, tail, docs = head.unpack_from(data, len(MAGIC))
    start = len(MAGIC) + head.size
    index = np.frombuffer(data, INDEX, tail // INDEX.itemsize, start + body)
    out = []
    for b in index[blocks]:
        at = start + int(b["at"])
        ids = decode_block(table, data[at : at + int(b["size"])], int(b["tokens"]), int(b["lanes"]))
        if zlib.crc32(ids.astype("<u4").tobytes()) != b["crc32"]:
            raise ValueError(f"block at token {b['first']}: its ids do not have the checksum")
        out.append(ids)
    listed = pa.ipc.open_stream(data[start + body + tail : start + body + tail + docs]).read_all()
    return (partition, number), np.concatenate(out) if out else np.zeros(0, np.uint32), listed


class Remembered(dict):
    """Values by key, each made when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Tokenizing:
    """Ids of texts by the tokenizers library, which sees each distinct word once.

    The vocabulary's pre-tokenizer drops white space, no match, special token or normalization runs over it, and letters are
    lower-cased. So texts are cut at spaces and line feeds; ASCII letters are lower-cased, as the library would, and a run of ASCII marks after an ASCII letter, a pre-token of its own, is looked up by itself.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.library, self.code = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        self.model = self.library.model
        self.known, self.bases = Remembered(self.piece), Remembered(self.base)

    def base(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # lower-cased ASCII letters are a pre-token as they stand; the model alone does the rest
            return array(self.code, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        return array(self.code, self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def piece(self, piece: bytes) -> bytes:
        base = piece.rstrip(MARKS)
        if len(base) < len(piece) and base[-1:].isalpha() and b"<|" not in piece:
            return self.bases[base] + self.bases[piece[len(base) :]]
        return self.bases[piece]

    def ids(self, texts: list[bytes], end: bytes) -> list[bytes]:
        for kept in (self.known, self.bases):
            if len(kept) > CACHE_PIECES:
                kept.clear()
        look = self.known.__getitem__
        # special tokens are not lower-cased
        return [b"".join(map(look, (t if b"<|" in t else t.lower()).replace(b"\n", b" ").split(b" "))) + end for t in texts]


@lru_cache(maxsize=1)
def tokenizing(path: str, width: int) -> Tokenizing:
    return Tokenizing(path, width)


def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes that hold any id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 > end_id else 4


def token_ids(df: DataFrame, vocabulary: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """ids (little-endian unsigned integers of `width` bytes): the library's for the whole text, then end_id. Null counts as empty."""
    ship(df.sparkSession)
    end = end_id.to_bytes(width, "little")

    def run(batches):
        own = tokenizing(vocabulary, width)
        for b in by_bytes(batches, "__text"):
            texts = [x or b"" for x in b.column("__text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.ids(texts, end), pa.binary())], names=[id_col, "ids"])

    picked = df.select(df[id_col], df[text_col].alias("__text"))
    return picked.mapInArrow(run, f"{field_ddl(picked, id_col)}, ids binary")


def frequencies(ids: DataFrame, width: int, id_count_limit: int = 1 << BITS) -> Frequencies:
    """Counts of all ids of the corpus, one number for each id of the vocabulary, scaled. The driver gets no more than that."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).limit(id_count_limit + 1).toPandas().sort_values("id")
    return Frequencies(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write_ids(ids: DataFrame, table: Frequencies, path: str, *, width: int, id_col: str = "doc_id", file_tokens: int = FILE_TOKENS) -> None:
    """Files of (id_col, ids) in ascending order of id_col, nulls first; repeated ids follow the order of their bytes."""
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((table.ids, table.f))  # as large as the vocabulary

    def run(batches):
        table = Frequencies(*shared.value)
        partition = TaskContext.get().partitionId()
        held: list = []
        tokens = number = 0

        def flush():
            nonlocal held, tokens, number
            docs = pa.table({id_col: pa.concat_arrays([x[0] for x in held]), "tokens": pa.array(np.concatenate([x[1] for x in held]))})
            data = encode_file(table, np.frombuffer(b"".join(y for x in held for y in x[2]), f"<u{width}").astype(np.uint32), docs, partition, number)
            held, tokens, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in batches:
            for b in by_bytes([batch], "ids", width * file_tokens):
                raw = b.column("ids").to_pylist()
                size = np.fromiter((len(x) // width for x in raw), np.int64, len(raw))
                if held and tokens + size.sum() > file_tokens:
                    yield flush()
                held.append((b.column(0), size, raw))
                tokens += int(size.sum())
        if held:
            yield flush()

    spread = F.xxhash64("ids")  # rows that share an id need not share a task
    ordered = ids.select(id_col, "ids").repartitionByRange(n, id_col, spread).sortWithinPartitions(id_col, spread, "ids")
    write_blobs(ordered.mapInArrow(run, "file binary"), path, end="\n")


def read_ids(spark: SparkSession, path: str, table: Frequencies, like: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(part, number, first, n_tokens, ids_crc32, ids) of every document: its file, its first token there, and its ids."""
    shared = spark.sparkContext.broadcast((table.ids, table.f))

    def run(batches):
        table = Frequencies(*shared.value)
        for batch in batches:
            for content in batch.column("content"):
                (part, number), ids, docs = decode_file(table, content.as_buffer().to_pybytes())
                size = docs.column("tokens").to_numpy()
                ends, raw = np.cumsum(size), ids.astype("<u4").tobytes()
                own = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), size.tolist())]
                for at in range(0, len(own), 4096):
                    some = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(id_col).combine_chunks()[some] if docs.num_rows else pa.array([], docs.schema.field(id_col).type)]
                        + [pa.array([x] * len(own[some]), pa.int64()) for x in (part, number)]
                        + [pa.array((ends - size)[some], pa.int64()), pa.array(size[some], pa.int64()), pa.array([zlib.crc32(x) for x in own[some]], pa.int64()), pa.array(own[some], pa.binary())],
                        names=[id_col, "part", "number", "first", "n_tokens", "ids_crc32", "ids"],
                    )

    return read_blobs(spark, path).mapInArrow(run, f"{field_ddl(like, id_col)}, part long, number long, first long, n_tokens long, ids_crc32 long, ids binary")


def token_binary(df: DataFrame, vocabulary: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the coded files of a corpus into the shared folder, read them back: id_col, start, n_tokens, ids_crc32 of each document.

    Null texts count as empty and have the end id alone. Documents stand in ascending order of id_col, nulls first; equal ids in the
    order of their bytes, each a row. An empty table gives no files and no rows. Only id_col and text_col are read, so further
    columns can't clash.
    """
    spark = df.sparkSession
    stage = Stage(spark, "token-binary")
    width = id_width(vocabulary, end_id)
    ids = stage.table(token_ids(df, vocabulary, end_id, id_col=id_col, text_col=text_col, width=width), "ids")
    table = frequencies(ids, width)
    write_ids(ids, table, stage.at("files"), width=width, id_col=id_col)
    stage.drop("ids")
    docs = stage.table(read_ids(spark, stage.at("files"), table, df, id_col=id_col).drop("ids"), "documents")
    files = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("tokens"))  # one row a file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "number", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return docs.join(files, ["part", "number"]).select(id_col, (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
