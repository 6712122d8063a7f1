"""Token counts by rank-synchronous array merging (operator 5).

Batched pre-tokens are ragged numpy arrays: one flat array of symbol ids and the start of each sequence. In every round
each sequence looks up the ranks of its adjacent pairs and applies its lowest-ranked pair at all places, left to right and
without overlap, all sequences at once; sequences without a pair in the merge table leave. The surviving symbols are counted.
Merging all places of a pair at once equals merging them one by one when no merge can bring forth a pair of a lower rank
than its own; MergeTable checks that of its table and otherwise applies only the leftmost place in a round.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm._common import by_bytes, field_ddl, pieces, ship, strings, whole

#: Distinct pieces of text whose counts a worker remembers before it begins anew.
CACHE_PIECES = 400_000
#: Pieces whose pre-tokens go through one call of the array kernel.
KERNEL_PIECES = 100_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, shift = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + shift))
        shift += b not in own
    return out


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = len(vocab) + 1
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        # a pair listed twice keeps its last rank, as a map that is filled in order does
        last = np.append(key[order][1:] != key[order][:-1], True) if len(key) else np.zeros(0, bool)
        self.key, self.rank, self.made = key[order][last], order[last], made[order][last]
        self.bytes = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        highest = np.full(self.size, -1, np.int64)
        np.maximum.at(highest, self.made, self.rank)
        own = self.rank
        self.ordered = bool(np.all(highest[self.key // self.size] < own) and np.all(highest[self.key % self.size] < own))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a huge one) and place in the table of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], np.iinfo(np.int64).max), at


def merge_counts(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """How many symbols survive in each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = lengths.copy()
    live = np.flatnonzero(lengths > 1)
    if not len(live):
        return out
    keep = lengths > 1
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym = table.bytes[flat[np.repeat(keep, lengths)]]
    size = lengths[live]
    never = np.iinfo(np.int64).max
    while len(live):
        start = np.cumsum(size) - size
        seq = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(sym), never)
        rank[:-1], at = table.lookup(sym[:-1], sym[1:])
        rank[start + size - 1] = never  # the last symbol of a sequence has no right neighbour
        best = np.minimum.reduceat(rank, start)
        hit = (rank == best[seq]) & (rank != never)
        if table.ordered:  # in a run of overlapping places every other one, from the left
            place = np.flatnonzero(hit)
            first = np.ones(len(place), bool)
            first[1:] = (place[1:] != place[:-1] + 1) | (seq[place[1:]] != seq[place[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - head) % 2 == 0]
        else:
            place = np.flatnonzero(hit)
            place = place[np.unique(seq[place], return_index=True)[1]]
        sym[place] = table.made[at[place]]
        gone = np.zeros(len(sym), bool)
        gone[place + 1] = True
        size = size - np.bincount(seq[place], minlength=len(size))
        out[live] = size
        more = (best != never) & (size > 1)
        stay = ~gone & more[seq]
        sym, size, live = sym[stay], size[more], live[more]
    return out


@lru_cache(maxsize=2)
def table_of(path: str) -> MergeTable:
    """The merge table of a vocabulary, read and sorted once a worker."""
    return MergeTable(path)


class Counting:
    """Counts tokens of texts; remembers a bounded number of pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.table = table_of(path)
        self.words = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        base, split = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if any(x in text for x in self.table.special) else [text]
            base[i] = len(parts) - 1
            split.append([x for p in parts for x in pieces(p)] if len(parts) > 1 else pieces(text))
        if len(self.known) > CACHE_PIECES:  # begin anew; results don't depend on it
            self.known = {}
        known = self.known
        new = list(set().union(*split).difference(known))
        for at in range(0, len(new), KERNEL_PIECES):
            part = new[at : at + KERNEL_PIECES]
            found = [self.words.findall(whole(x)) for x in part]
            words = list({w for own in found for w in own})
            n = dict(zip(words, merge_counts(self.table, [w.encode() for w in words]).tolist()))
            known.update((x, sum(map(n.__getitem__, own))) for x, own in zip(part, found))
        return [b + sum(map(known.__getitem__, own)) for b, own in zip(base, split)]


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's text under a byte-level BPE `vocabulary` (.json).

    Null texts count as empty: 0 bytes and 0 tokens. Null and repeated ids pass through, a row each. Only id_col and text_col
    are read, so further columns can't clash. A special string in a text is one token, as the library has it by default.
    """
    ship(df.sparkSession)

    def run(batches):
        counting = Counting(vocabulary, pattern)
        for b in by_bytes(batches, "__text"):
            texts = strings(b.column("__text"))
            n = counting.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    picked = df.select(df[id_col], df[text_col].alias("__text"))
    return picked.mapInArrow(run, f"{field_ddl(picked, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
