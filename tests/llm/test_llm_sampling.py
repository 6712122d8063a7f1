"""Resampling, vector codes and packing against plain code, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pactlens.llm import queries as q
from pactlens.llm import vector_codes as vc
from pactlens.llm.packing import binary_lengths, pack, write_buckets
from pactlens.llm.resampling import BLOCK_BYTES, Hashing, draw, importance, merge_runs, runs_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight string, score string, ids string, __text string, rank string, length string"
ROWS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " \n\t "), (None, "four five six seven " * 6), (5, " ".join(f"w{i}" for i in range(30000))), (6, "Äpfel ÄPFEL straße x" * 9), (7, "y" * 90 + " " + "z" * 70 + " a")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_importance(docs, target, share=25, least=20, m=10000):
    """(doc_id, n_features, weight, score, rank) by the definition, document by document."""
    buckets = lambda t: [zlib.crc32(" ".join(g).encode()) % m for n in (1, 2) for g in zip(*(words(t)[k:] for k in range(n)))]
    of = [(d, buckets(t), len(words(t))) for d, t in docs]
    s, t = Counter(b for _, x, _ in of for b in x), Counter(b for x in target for b in buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m))))
    out = []
    for d, x, n in of:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(drawn[: len(drawn) * share // 100]):
        r[5] = k + 1
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in out), key=repr)


def test_resampling_query_equals_plain_code(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in q.op11_importance_resampling(spark, SF).collect()), key=repr)
    assert got == plain_importance(docs, target)
    assert 0 < sum(r[4] is not None for r in got) < len(got)


def test_resampling_of_hard_rows(spark):
    target = [(0, "w1 w2 w3 four five"), (1, None)]
    got = importance(table(spark, ROWS), table(spark, target), share=50)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain_importance(ROWS, [t for _, t in target], share=50)
    assert importance(table(spark, ROWS[:0]), table(spark, target)).count() == 0
    bare = importance(table(spark, ROWS), table(spark, []), share=100).collect()
    assert sorted(r.rank for r in bare if r.rank) == list(range(1, 1 + sum(r.n_words >= 20 for r in bare)))
    drawn = draw(table(spark, ROWS), table(spark, target), share=100)
    assert drawn.columns == table(spark, ROWS).columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in bare if r.n_words >= 20}


def test_pairs_hash_like_their_text():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abc1é") for _ in range(rng.choice([1, 3, 62, 63, 64, 65, 140]))) for _ in range(rng.randrange(12))) for _ in range(60)] + [""]
    own = Hashing(10000, 3)
    for _ in range(2):  # the second time with all words known
        out, size, n = own.stream([t.encode() for t in texts])
        want = [[zlib.crc32(" ".join(g).encode()) % 10000 for k in (1, 2, 3) for g in zip(*(t.split()[i:] for i in range(k)))] for t in texts]
        assert out.tolist() == [b for x in want for b in x] and size.tolist() == list(map(len, want)) and n.tolist() == [len(t.split()) for t in texts]


def test_runs_count_like_a_counter():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 700, 3)]
    value, n = merge_runs([runs_of(p) for p in parts])
    assert dict(zip(value.tolist(), n.tolist())) == Counter(np.concatenate(parts).tolist())


def test_one_document_may_exceed_a_block(spark):
    rows = [(1, "word " * (BLOCK_BYTES // 4)), (2, "word two"), (3, "three")]
    got = importance(table(spark, rows).coalesce(1), table(spark, [(1, "word")]))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain_importance(rows, ["word"])


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    at = [([math.floor(4096 * x) for x in v][p * len(v) // parts : (p + 1) * len(v) // parts]) for _, v, _ in kept for p in range(parts)]
    books = [[list(at[i * parts + p]) for i in range(min(entries, len(kept)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, a: min(range(len(books[p])), key=lambda k: (square(a, books[p][k]), k))
    for _ in range(rounds):
        own = [nearest(i % parts, a) for i, a in enumerate(at)]
        for p in range(parts):
            for k in range(len(books[p])):
                held = [at[i] for i in range(p, len(at), parts) if own[i] == k]
                if held:
                    books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    own = [nearest(i % parts, a) for i, a in enumerate(at)]
    out = []
    for i, (d, _, label) in enumerate(kept):
        mine = own[i * parts : (i + 1) * parts]
        out.append((d, "".join(f"{k:02x}" for k in mine), sum(square(at[i * parts + p], books[p][k]) for p, k in enumerate(mine)), label))
    return out, books


def test_codes_equal_plain_lloyd_with_ties_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.5]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(300)]  # coarse: many ties
    rows += [(rows[5][0], *rows[5][1:]), (None, [0.5] * 16, None), (900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [math.inf] * 16, 2), (903, [math.nan] + [0.0] * 15, 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, q string, state string")
    coded, books = vc.vector_codes(df)
    want, plain = plain_codes(rows)
    assert [b.tolist() for b in books] == plain
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in coded.collect()), key=repr) == sorted(want, key=repr)
    totals = {label: sum(w[2] for w in want if w[3] == label) for label in (None, 1, 2)}
    for limit in (vc.BROADCAST_LABELS, 0):  # by broadcast and by salted shuffle
        before, vc.BROADCAST_LABELS = vc.BROADCAST_LABELS, limit
        try:
            got = vc.with_label_error(coded).collect()
        finally:
            vc.BROADCAST_LABELS = before
        assert len(got) == len(want) and all(r.label_error == totals[r.label] for r in got)
    flat = ",".join(str(c) for b in plain for e in b for c in e)
    assert vc.codebook_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_codes_of_few_empty_and_uneven_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = [(i, [float(i)] * 11, 1) for i in range(5)] + [(9, [1.0] * 7, 1)]
    coded, books = vc.vector_codes(spark.createDataFrame(few, schema))
    assert coded.count() == 5 and [b.shape for b in books] == [(5, n) for n in (1, 1, 2, 1, 1, 2, 1, 2)]
    assert {r.error for r in coded.collect()} == {0}
    none, books = vc.vector_codes(spark.createDataFrame([], schema))
    assert none.count() == 0 and vc.codebook_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="64 bits"):
        vc.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], schema))


def test_bounds_spare_distances_and_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    centers = rng.integers(-40000, 40000, (16, 8))
    x = centers[rng.integers(0, 16, 4000)] + rng.integers(-900, 900, (4000, 8))
    entries = x[:16].copy()
    book = vc.Book(entries, vc.group_entries(entries, 4), np.zeros(16))
    own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), book.n_groups), np.float32)
    spent = []
    for _ in range(8):
        own, upper, lower, work = vc.assign(x, book, own, upper, lower)
        exact = ((x[:, None] - book.entries[None]) ** 2).sum(2)
        assert (own == exact.argmin(1)).all()
        spent.append(work)
        book = book.next(np.array([x[own == k].sum(0) // max(1, (own == k).sum()) if (own == k).any() else book.entries[k] for k in range(16)]))
    assert spent[-1] < spent[0] / 4


def test_large_components_are_exact():
    x = np.array([[2**29, -(2**29)], [3, 4]], np.int64)
    assert vc.squared(x, x).tolist() == [[0, (2**29 - 3) ** 2 + (2**29 + 4) ** 2], [(2**29 - 3) ** 2 + (2**29 + 4) ** 2, 0]]


def test_lengths_are_the_binary_digits():
    for n in (1, 2, 4095, 4096, 4097, 12345):
        parts = binary_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 4096 for p in parts)
        assert len(parts) == n // 4096 + (n % 4096).bit_count()


def check_packing(rows, docs, end=2, longest=4096):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter(b"".join(i.to_bytes(4, "little") for i in library.encode(t or "", add_special_tokens=False).ids + [end]) for _, t in docs)
    whole, own = {}, {}
    for r in rows:  # ids of pieces of one document are joined again; repeated ids are told apart by their sequences' order
        own.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append((r.sequence_id, bytes(r.ids)))
    got = Counter()
    for starts in own.values():
        copies = len(starts[0])
        assert all(len(v) == copies for v in starts.values())
        for k in range(copies):
            got[b"".join(sorted(v)[k][1] for _, v in sorted(starts.items()))] += 1
    assert got == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    ordered = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert ordered == sorted(ordered, reverse=True)
    assert all(r.offset == 0 and len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.length <= longest for r in rows)


def test_packing_holds_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(pack(docs.repartition(5), P.path("word_bpe_49k.json")).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    for r in q.op13_packing(spark, SF).filter("length = 1").limit(50).collect():
        assert r.ids_crc32 == zlib.crc32((2).to_bytes(4, "little")) and r.start == r.doc_tokens - 1


def test_packing_of_hard_rows(spark):
    hard = [r for r in ROWS if r[0] != 3] + [(3, "one two three"), (3, "one two three")]
    check_packing(pack(table(spark, hard), P.path("word_bpe_49k.json"), longest=1024).collect(), hard, longest=1024)
    assert pack(table(spark, []), P.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        pack(table(spark, hard), P.path("word_bpe_49k.json"), longest=1000)


def test_buckets_are_written_by_length(spark, tmp_path):
    packed = pack(table(spark, ROWS), P.path("word_bpe_49k.json"))
    write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == packed.count() and back.filter(F.octet_length("ids") != 4 * F.col("length")).count() == 0
