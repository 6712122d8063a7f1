"""Every column of the queries that SQL can't express against plain code, and hard cases: empty tables, very long texts, clashing names."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import public_tokenizers as P
import pytest

from pactlens.llm import bpe_codec, classifier, secret_scan
from pactlens.llm import queries as q
from pactlens.llm.bpe_codec import encode_decode
from pactlens.llm.classifier import classify
from pactlens.llm.decontam import decontaminate, keep_clean
from pactlens.llm.line_dedup import dedup_lines
from pactlens.llm.near_dup import keep_one, near_duplicates
from pactlens.llm.quality_rules import keep_good, quality_rules
from pactlens.llm.secret_scan import scan_secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_quality_statistics_equal_plain_code(spark, documents):
    got = {r.doc_id: r for r in q.op1_quality_rules(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for d, t in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        places = {}
        for i in range(len(w) - 4):
            places.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        r, n = got[d], len(w)
        want = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(repeated), n < 10 or 100 * len(repeated) > 20 * n)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.kept and r.base_failed)


def test_secret_columns_equal_plain_code(spark, documents):
    kinds = ("assign", "access", "hex")
    for r in q.op2_secret_scan(spark, SF).collect():
        t, spans = documents[r.doc_id], []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            spans += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        found = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in found if x[0] != "guess"] == [x.split(":") for x in text.split(",") if x]
        order = [(int(s), (*kinds, "guess").index(k)) for k, s, _ in found]
        assert order == sorted(order)


def test_token_columns_equal_the_libraries(spark, documents):
    import tiktoken
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in q.op5_token_counts(spark, SF).collect():
        n = len(bpe.encode(documents[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 1024)
    words, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in q.op8_token_binary(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for d in sorted(documents):
        ids = words.encode(documents[d], add_special_tokens=False).ids + [1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(raw))
        at += len(ids)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in q.op9_bpe_codec(spark, SF).collect():
        ids = library.encode_ordinary(documents[r.doc_id])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        text = documents[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest())


def test_classifier_columns(spark, documents):
    got = q.op4_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= classifier.GOOD) and 0 <= r.score <= 1


def test_guesses_equal_the_plain_program():
    """All beginnings of a last part tried, for each end."""
    s, ranks, rng = secret_scan, secret_scan.word_ranks(P.path("byte_bpe_50k.json")), random.Random(2)

    @lru_cache(maxsize=None)
    def plain(value):
        n, low = len(value), value.lower()
        signs, near = low.translate(s.LEET), s.neighbours()
        dates = {(m.start(), m.end()) for i in range(n) if (m := s.DATE.match(value, i))}
        best = [0.0] + [math.inf] * n
        for e in range(1, n + 1):
            for a in range(e):
                z, part = e - a, low[a:e]
                costs = [s.brute(value[a:e])]
                if z > 2:
                    costs.append(s.word_cost(value[a:e], part, signs[a:e], ranks))
                units = [u for u in range(1, min(s.MAX_UNIT, z // 2) + 1) if z % u == 0 and part == part[:u] * (z // u)]
                costs += [plain(value[a : a + u]) + math.log10(z // u) for u in units]
                if z >= s.MIN_WALK and all(part[i : i + 2] in near for i in range(z - 1)):
                    costs.append(s.walk_cost(z))
                if (a, e) in dates:
                    costs.append(s.DATE_COST)
                best[e] = min(best[e], best[a] + min(costs) + (s.NEXT_PART if a else 0))
        return best[n]

    some = list(ranks)[:3000]
    makers = [
        lambda: rng.choice(some), lambda: "".join(rng.choices("abAB12$", k=rng.randint(1, 6))), lambda: "qwertyuiop"[rng.randint(0, 4) : rng.randint(5, 9)], lambda: "19990412",
        lambda: rng.choice("abz") * rng.randint(1, 20), lambda: "".join(rng.choices("aB", k=rng.randint(1, 5))) * rng.randint(1, 6), lambda: rng.choice(["P4ssw0rd", "Kx7qZ", "12-03-2001"]),
    ]
    for _ in range(300):
        v = "".join(rng.choice(makers)() for _ in range(rng.randint(1, 5)))
        want = plain(v)
        assert abs(s.guesses(v, ranks) - want) < 1e-9 and abs(s.guesses(v, ranks, 10.0) - min(want, 10)) < 1e-9
    assert s.guesses("z" * 256, ranks) < 4 and s.guesses("Zq" * 130, ranks) < 6 and s.guesses("kx7qz" * 3, ranks) < 8.3
    assert s.guesses("password" * 8, ranks) < 6
    for value in ("z" * 256, "password" * 8, "summer2019" * 4, "correcthorse" * 3):  # easy units stay easy
        assert s.spans_of("login: " + value, ranks) == []
    assert s.spans_of("login: Xq7/vT2+kP" + "z" * 8, ranks) != []
    assert s.guesses("".join(rng.choices("abcXYZ019+/", k=100_000)), ranks, 10.0) == 10


def test_long_words_in_the_codec():
    import numpy as np
    import tiktoken

    path, rng = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(4)
    codec = bpe_codec.Codec(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    texts = ["x" * 50_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=50_000)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(3000)), "=" * 5000 + "ab" * 999 + "1" * 4000]
    texts += ["".join(rng.choices("abcdefghij", k=rng.randint(60, 300))) for _ in range(200)] + ["".join(rng.choices("ab", k=rng.randint(60, 300))) for _ in range(100)]
    ids = codec.encode(texts)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts] and codec.decode(ids) == [t.encode() for t in texts]


NAMES = ["doc_id", "text", "row", "stats", "raw", "gone", "id", "version", "__id", "__of", "__lines", "__stats", "__raw", "__text"]


def test_columns_of_any_name_pass(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    table = spark.createDataFrame([(i, t, *(["z"] * 12)) for i, t in ((1, long), (2, None), (3, long), (None, "a few other words"))], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in NAMES))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a few other words")], "item_id long, text string")
    assert {r.doc_id: r.row for r in keep_good(table, labels).select(*NAMES).collect()} == {1: "z", 3: "z"}
    assert sorted(r.doc_id or 0 for r in keep_one(table).select(*NAMES).collect()) == [0, 1, 2]
    assert sorted(r.doc_id or 0 for r in keep_clean(table, items).select(*NAMES).collect()) == [1, 2, 3]
    out = dedup_lines(table)
    assert out.columns == [*NAMES, "__n_lines", "__n_gone"] and {r.doc_id: r.__n_gone if hasattr(r, "__n_gone") else r["__n_gone"] for r in out.collect()} == {1: 0, 2: 0, 3: 1, None: 0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a few other words")], "item_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    results = [quality_rules(none, labels), keep_good(none, labels), scan_secrets(none, P.path("byte_bpe_50k.json")), near_duplicates(none), keep_one(none), classify(none, labels)]
    results += [decontaminate(none, items), keep_clean(none, items), encode_decode(none, path, P.PATTERN), dedup_lines(none)]
    assert [x.count() for x in results] == [0] * len(results)


def test_ties(spark):
    """Two kinds of span at one place; a score at the limit counts as good."""
    ranks = secret_scan.word_ranks(P.path("byte_bpe_50k.json"))
    assert [k for _, _, k in secret_scan.spans_of("token: " + "a1b2c3d4" * 4, ranks)] == ["assign", "hex"]
    assert [int(s >= classifier.GOOD) for s in (0.7, 0.6999999)] == [1, 0]
