"""Byte-level BPE encoding and decoding by DuckDB recursive queries (operator 9).

Each worker has its own in-memory DuckDB and queries it for its partitions, one after the other. The distinct pre-tokens it has not
seen yet become rows (word, position, id). A recursive query joins neighbouring rows to the merge table, contracts the leftmost pair
of minimum rank of every word, and ends when no word has a pair left.

Words that take more than STEPS steps go on in a query of the same kind that does more in a step. Up to a rank, a word falls into
blocks at the places that no token of this or a lower rank lies across; blocks can't meet and are contracted side by side as words are,
then the limit rises. And where a new token is in no merge of a lower rank, the block's other pairs of that rank come next anyway, from
left to right, and are contracted as well. Documents are the concatenation of their words' ids. Decoding joins the ids to the vocabulary and
concatenates the byte strings by an ordered aggregation.
"""

from __future__ import annotations

import base64
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm._common import by_bytes, field_ddl, ship, strings

#: Distinct pre-tokens whose ids a worker remembers, and their bytes; as many again from before are looked up as well.
CACHE_WORDS, CACHE_BYTES = 250_000, 8 << 20
#: Bytes of pre-tokens that go through one recursive query, one pre-token at least.
QUERY_BYTES = 1 << 18
#: Text bytes encoded and decoded at once.
BATCH = 1 << 20
#: Where the limits of the blocks lie among the ranks at a word's inner places, and a rank above all.
LEVELS, NONE = (0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999), 1 << 31
#: Steps of one recursive query, which holds the rows of all its steps; unfinished words go on in the next one.
STEPS = 40

#: k numbers the symbols in order: the word's number, then the first byte's place. A word without a pair has no row in the next step,
#: so its rows of the greatest t are its result.
FINAL = "SELECT k, id, z.t AS t FROM step JOIN (SELECT k >> 32 AS w, max(t) AS t FROM step GROUP BY 1) z ON step.t = z.t AND k >> 32 = z.w ORDER BY k"
ENCODE = f"""
WITH RECURSIVE step(t, k, id) AS (
    SELECT 0, k, id FROM symbols
  UNION ALL
    (WITH pairs AS MATERIALIZED (
              SELECT t, k, k >> 32 AS w, id, lead(id) OVER o AS next_id, lead(k) OVER o AS next_k, lag(k) OVER o AS prev_k
              FROM step WHERE t < {STEPS} WINDOW o AS (ORDER BY k)),
          best AS (SELECT w, min(rank << 32 | (k & 4294967295)) AS m FROM pairs JOIN merges ON id = a AND next_id = b WHERE w = next_k >> 32 GROUP BY w)
     SELECT t + 1, k, CASE WHEN k = (w << 32 | (m & 4294967295)) THEN (m >> 32)::INTEGER ELSE id END
     FROM pairs JOIN best USING (w) WHERE prev_k IS NULL OR prev_k <> (w << 32 | (m & 4294967295)))
)
{FINAL}
"""
#: Pairs of a rank up to $most. hits: a word's pairs of its minimum rank; of neighbouring ones, which overlap, every second is taken from the left.
ENCODE_MORE = f"""
WITH RECURSIVE step(t, k, id) AS (
    SELECT 0, k, id FROM symbols
  UNION ALL
    (WITH pairs AS MATERIALIZED (
              SELECT t, k, k >> 32 AS w, id, lead(id) OVER o AS next_id, lead(k) OVER o AS next_k, lag(k) OVER o AS prev_k, row_number() OVER o AS i
              FROM step WHERE t < {STEPS} WINDOW o AS (ORDER BY k)),
          found AS MATERIALIZED (SELECT w, k, i, rank, alone FROM pairs JOIN merges ON id = a AND next_id = b WHERE w = next_k >> 32 AND rank <= $most),
          best AS MATERIALIZED (SELECT w, min(rank << 32 | (k & 4294967295)) AS m FROM found GROUP BY w),
          hits AS (SELECT k, i, i - row_number() OVER (ORDER BY k) AS run FROM found JOIN best USING (w) WHERE rank = m >> 32 AND (NOT alone OR k & 4294967295 = m & 4294967295)),
          taken AS MATERIALIZED (SELECT k FROM (SELECT k, i - min(i) OVER (PARTITION BY run) AS nth FROM hits) WHERE nth % 2 = 0)
     SELECT t + 1, p.k, CASE WHEN x.k IS NULL THEN id ELSE (m >> 32)::INTEGER END
     FROM pairs p JOIN best USING (w) LEFT JOIN taken x ON x.k = p.k LEFT JOIN taken y ON y.k = prev_k
     WHERE y.k IS NULL)
)
{FINAL}
"""

DECODE = "SELECT d, string_agg(s, '' ORDER BY p) FROM tokens JOIN vocabulary USING (id) GROUP BY d"


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def merge_rows(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, rank, alone) for every pair of tokens whose concatenation is a token; alone: that token is in a merge of a lower rank."""
    ranks = read_ranks(path)
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, r = np.array(rows, np.int64).reshape(-1, 3).T
    alone = np.isin(r, np.concatenate((a[a > r], b[b > r])))
    return a.astype(np.int32), b.astype(np.int32), r, alone


class Codec:
    """Encodes and decodes batches of texts in a DuckDB of its own."""

    def __init__(self, path: str, pattern: str, memory: str = "120MB"):
        import duckdb
        import regex

        self.ranks, self.words = read_ranks(path), regex.compile(pattern)
        self.spill = tempfile.TemporaryDirectory(prefix="pactlens-bpe-")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": self.spill.name, "preserve_insertion_order": True})
        a, b, r, alone = merge_rows(path)
        self._load("merges", a=a, b=b, rank=r, alone=alone)
        ids = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self._load("vocabulary", id=ids, s=pa.array([t.decode("latin-1") for t in self.ranks]))
        self.byte_id = np.array([self.ranks[bytes([x])] for x in range(256)], np.int32)
        self.sizes = sorted({len(t) for t in self.ranks if len(t) > 1})
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.known_bytes = 0

    def _load(self, name: str, **columns) -> None:
        rows = pa.table(columns)  # noqa: F841  DuckDB reads it by this name
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = [self.ranks[w].to_bytes(4, "little") if w in self.ranks else b"" for w in words]
        rest = [i for i, w in enumerate(words) if w and not out[i]]
        size = np.array([len(words[i]) for i in rest], np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        k, ids = (np.repeat(np.arange(len(rest), dtype=np.int64), size) << 32) | place, self.byte_id[flat]
        if len(k):
            k, ids, t = self._query(ENCODE, k, ids)
            open_words = np.unique(k[t == STEPS] >> 32)
            if len(open_words):
                at = np.isin(k >> 32, open_words)
                more_k, more = self._merge_long(k[at], ids[at], {int(w): words[rest[w]] for w in open_words})
                k, ids = np.concatenate((k[~at], more_k)), np.concatenate((ids[~at], more))
            w, raw = k >> 32, ids.astype("<u4").tobytes()
            edge = np.flatnonzero(np.diff(w, prepend=-1, append=-1)).tolist()
            for at, to in zip(edge, edge[1:]):
                out[rest[w[at]]] = raw[4 * at : 4 * to]
        return out

    def _query(self, query: str, k: np.ndarray, ids: np.ndarray, *most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        symbols = pa.table({"k": k, "id": ids})  # noqa: F841
        got = self.db.sql(query, params={"most": most[0]} if most else None).to_arrow_table()
        return tuple(got.column(c).to_numpy() for c in ("k", "id", "t"))

    def _across(self, word: bytes) -> np.ndarray:
        """The least rank of the tokens that lie across the place before each byte, as far as the word has them; NONE without any."""
        out = np.full(len(word), NONE, np.int64)
        for size in self.sizes:
            found = [(i, r) for i in range(len(word) - size + 1) if (r := self.ranks.get(word[i : i + size])) is not None]
            if found:
                start, rank = np.array(found, np.int64).T
                for d in range(1, size):
                    out[start + d] = np.minimum(out[start + d], rank)
        return out

    def _merge_long(self, k: np.ndarray, ids: np.ndarray, words: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of unfinished words, contracted to the end."""
        across = {w: self._across(text) for w, text in words.items()}
        for level in (*LEVELS, None):
            w, p = k >> 32, k & 0xFFFFFFFF
            border = np.empty(len(k), np.int64)
            edge = np.flatnonzero(np.diff(w, prepend=-1, append=-1)).tolist()
            for at, to in zip(edge, edge[1:]):
                border[at:to] = across[int(w[at])][p[at:to]]
                border[at] = NONE
            crossed = border[border < NONE]
            most = NONE - 1 if level is None or not len(crossed) else int(np.quantile(crossed, level))
            block = np.cumsum(border > most) - 1
            owner = w[border > most]
            now_k, now, done = (block << 32) | p, ids, []
            while len(now_k):
                now_k, now, t = self._query(ENCODE_MORE, now_k, now, most)
                done.append((now_k[t < STEPS], now[t < STEPS]))
                now_k, now = now_k[t == STEPS], now[t == STEPS]
            k, ids = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(k)
            k, ids = k[order], ids[order]
            k = (owner[k >> 32] << 32) | (k & 0xFFFFFFFF)
        return k, ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words.findall(t) for t in texts]
        if len(self.known) > CACHE_WORDS or self.known_bytes > CACHE_BYTES:
            self.known_before, self.known, self.known_bytes = self.known, {}, 0
        known, before = self.known, self.known_before
        new = []
        for w in set().union(*split).difference(known):
            if (ids := before.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
                self.known_bytes += len(w)
        raw = [w.encode() for w in new]
        ends = np.cumsum([0, *map(len, raw)])
        self.known_bytes += int(ends[-1])
        at = 0
        while at < len(raw):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + QUERY_BYTES, "right")) - 1)
            known.update(zip(new[at:to], self.merge(raw[at:to])))
            at = to
        return [b"".join(map(known.__getitem__, own)) for own in split]

    def decode(self, docs: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(docs), "<u4")
        size = np.fromiter((len(x) // 4 for x in docs), np.int64, len(docs))
        tokens = pa.table({"d": np.repeat(np.arange(len(docs), dtype=np.int32), size), "p": np.arange(len(flat), dtype=np.int32), "id": flat.astype(np.int32)})  # noqa: F841
        got = self.db.execute(DECODE).fetchall()
        out = [b""] * len(docs)
        for d, s in got:
            out[d] = s.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def codec_of(path: str, pattern: str) -> Codec:
    """A worker process keeps its codec, and what it remembers, over the partitions it handles."""
    return Codec(path, pattern)


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids (little-endian unsigned 32-bit integers, binary) of each text, and decoded (binary), the bytes those ids stand for.

    `vocabulary` is a rank file of base64 token and rank a line; each match of `pattern` is encoded by itself, special strings are
    ordinary text. Null texts count as empty: no ids, no bytes. Null and repeated ids pass through, a row each. Only id_col and
    text_col are read, so further columns can't clash.
    """
    ship(df.sparkSession)

    def run(batches):
        codec = codec_of(vocabulary, pattern)
        for b in by_bytes(batches, "__text", BATCH):
            ids = codec.encode(strings(b.column("__text")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(codec.decode(ids), pa.binary())], names=[id_col, "ids", "decoded"])

    picked = df.select(df[id_col], df[text_col].alias("__text"))
    return picked.mapInArrow(run, f"{field_ddl(picked, id_col)}, ids binary, decoded binary")
