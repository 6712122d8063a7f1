"""Kernels of the corpus operators against libraries and plain code, without Spark."""

import hashlib
import gzip
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from pactlens.llm import bpe_codec, classifier, line_dedup, near_dup, secret_scan, shingles, token_binary, token_counts, warc

ALPHABET = list("abcdefgh ABC  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　éèñ漢字1234²½'stremvldl!?#$%́\U0001f600﻿\0")


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    extra = ["", " ", "a<|endoftext|>b <|startoftext|> X <|ENDOFTEXT|>.", "a" * 3000, "ab" * 2000, "".join(rng.choices("abcdef", k=4000)), "Word's it'S. x.y., a\"\". Ab...'t"]
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(n)] + extra


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    counting = token_counts.Counting(path, P.PATTERN)
    assert counting.table.ordered and counting.count(texts()) == want
    counting.table.ordered, counting.known = False, {}
    assert counting.count(texts(200, 5)) == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts(200, 5), add_special_tokens=False)]


def test_codec_equals_the_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe_codec.Codec(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    ids = codec.encode(texts())
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts()]
    assert codec.decode(ids) == [t.encode() for t in texts()]


def test_codec_remembers_words_in_other_surroundings(monkeypatch):
    codec, rng = bpe_codec.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200_000)]
    parts = [words[at : at + 20_000] for at in range(0, len(words), 20_000)]
    first = [codec.encode([" " + " ".join(part)]) for part in parts]
    merge, again = codec.merge, []
    monkeypatch.setattr(codec, "merge", lambda new: again.extend(new) or merge(new))
    more = [codec.encode([", " + ", ".join(part)]) for part in parts]
    assert set(again) <= {b","} and [len(x[0]) for x in more] == [len(x[0]) + 4 * len(part) for x, part in zip(first, parts)]


def test_tokenizing_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    assert token_binary.Tokenizing(path, 2).ids([t.encode() for t in texts()], b"") == want


def test_coded_files_round_trip_and_show_damage():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    all_ids = (rng.zipf(1.2, 20_000) % 5000).astype(np.uint32)
    table = token_binary.Frequencies(*np.unique(all_ids, return_counts=True))
    assert table.f.sum() == 1 << token_binary.BITS
    for n in (0, 1, 63, 64, 65, 5000):
        docs = pa.table({"doc_id": [7], "tokens": [n]})
        data = token_binary.encode_file(table, all_ids[:n], docs, 3, 4, block_tokens=700)
        key, ids, listed = token_binary.decode_file(table, data)
        assert key == (3, 4) and listed.equals(docs) and np.array_equal(ids, all_ids[:n])
    assert np.array_equal(token_binary.decode_file(table, data, slice(1, 3))[1], all_ids[700:2100])
    bad = bytearray(data)
    bad[200] ^= 1
    with pytest.raises(ValueError):
        token_binary.decode_file(table, bytes(bad))


def test_shingle_sets_equal_plain_sets():
    samples = texts(300) + ["A B c d e f", "a b c d e f a b c d e", "a\nb c\n\n x ", "one two"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = {i: i + 32 for i in range(65, 91)}

    def plain(t):
        w = word.findall(t.translate(low))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    hashes, size = shingles.text_sets(samples)
    assert size.tolist() == [len(plain(t)) for t in samples]
    names = {}
    for name, t in zip(zip(*shingles.identity(hashes, size)), samples):
        names.setdefault(name, set()).add(frozenset(plain(t)))
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set().union(*names.values()))
    _, size, text, line = shingles.line_sets(samples)
    want = [(i, k, len(plain(x))) for i, t in enumerate(samples) for k, x in enumerate(t.split("\n")) if word.search(x)]
    assert list(zip(text.tolist(), line.tolist(), size.tolist())) == want
    assert len(shingles.text_sets([])[1]) == 0


def test_minhash_agreement_is_the_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    a, b = np.concatenate((common, rng.integers(0, 1 << 62, 100, dtype=np.uint64))), np.concatenate((common, rng.integers(0, 1 << 62, 100, dtype=np.uint64)))
    s = near_dup.signature(np.concatenate((a, b)), np.array([700, 700]))
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.25


def test_prefix_holds_a_common_token():
    for n in range(1, 200):
        for m in range(n, min(200, -(-4 * n // 3) + 1)):
            need = -(-75 * (n + m) // 175)
            assert line_dedup.prefix_length(np.array([n]))[0] >= n - need + 1 and line_dedup.prefix_length(np.array([m]))[0] >= m - need + 1


def base_spans(t):
    """The fixed patterns, written plainly."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_secrets():
    ranks = secret_scan.word_ranks(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = ["password", "API_KEY", "apikey", "=", " : ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "toKen", " ", "x-y_z"]
    for _ in range(800):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert [x for x in secret_scan.spans_of(t, ranks) if x[2] != "guess"] == base_spans(t)
    assert secret_scan.spans_of("login: hunter2!Xq91zz9", ranks) == [(7, 22, "guess")]
    assert secret_scan.spans_of("the login is qwertyuiop", ranks) == [] and secret_scan.spans_of("", ranks) == []
    g = lambda v: secret_scan.guesses(v, ranks)
    assert g("aaaaaaaaaa") < g("password1") < g("Xk9$vQ2!pLr7") and g("2019-04-05") < 6 and g("qwertyuiop") < 8
    assert g("ab" * 5000) > 0


def sample_records(n=12):
    body = lambda i: (b"<p>%d</p>" % i) * 50
    return [warc.record(str(i), f"http://a/{i}\n ü", body(i), hashlib.sha256(body(i)).hexdigest(), None if i % 3 else "9") for i in range(n)]


def test_salvage():
    records = sample_records()
    members = [gzip.compress(r, mtime=0) for r in records]
    data = b"".join(members) + warc.EMPTY_MEMBER.encode("latin-1")
    assert [x.fields["warc-record-id"] for x in warc.salvage(data)] == [f"<urn:page:{i}>" for i in range(12)]
    at = len(members[0]) + len(members[1])
    bad = bytearray(data)
    bad[at + 40] ^= 0xFF
    found = list(warc.salvage(bytes(bad)))
    assert sum(x.fields is not None for x in found) == 11 and [(x.start, x.end) for x in found if x.fields is None] == [(at, at + len(members[2]))]
    cut = [x for x in warc.salvage(b"junk" + data[:-80]) if x.fields is None]
    assert (cut[0].start, cut[0].end) == (0, 4) and cut[-1].end == len(data) - 76
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + len(records[1]) - 20] ^= 1
    found = list(warc.salvage(bytes(plain)))
    assert sum(x.fields is not None for x in found) == 11 and len(found) == 12
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"xyz"))[0].reason


def test_false_version_lines_cost_no_search_of_the_rest():
    import time

    good, false = sample_records(2), b"WARC/1.1\r\n" * 40_000
    began = time.monotonic()
    found = list(warc.salvage(good[0] + false + good[1]))
    assert time.monotonic() - began < 5
    assert [x.fields is not None for x in found] == [True, False, True] and (found[1].start, found[1].end) == (len(good[0]), len(good[0]) + len(false))


def test_classifier_learns_and_is_bounded():
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "fee", "is", "paid", "on", "time"], k=40)) for _ in range(150)]
    bad = [" ".join(w + "$$$" for w in rng.choices(["the", "fee", "is"], k=40)) for _ in range(150)]
    vectors = classifier.index_vectors()
    x = classifier.features(good + bad, vectors)
    net = classifier.train(x, np.array([1] * 150 + [0] * 150))
    s = net.scores(x)
    assert ((s >= 0.5) == np.array([True] * 150 + [False] * 150)).mean() > 0.98
    empty = net.scores(classifier.features(["", "x" * 100_000], vectors))
    assert np.all((empty >= 0) & (empty <= 1))
