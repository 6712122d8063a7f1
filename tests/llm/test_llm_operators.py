"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pactlens.llm import queries as q
from pactlens.llm.bpe_codec import encode_decode
from pactlens.llm.classifier import classify
from pactlens.llm.decontam import decontaminate, keep_clean
from pactlens.llm.line_dedup import dedup_lines
from pactlens.llm.near_dup import keep_one, near_duplicates
from pactlens.llm.quality_rules import keep_good, quality_rules
from pactlens.llm.secret_scan import scan_secrets
from pactlens.llm.token_binary import token_binary
from pactlens.llm.token_counts import count_tokens
from pactlens.llm.warc import archive

SCHEMA = "doc_id long, text string, n_tokens string, kept string, id string"
LONG = " ".join(f"w{i}" for i in range(3000))
#: null and empty texts, a null id, a repeated row, a shared id, a long text; further columns have names that the operators use.
ROWS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " \n\t "), (None, "four five six seven eight nine ten"), (5, LONG), (6, LONG + " end"), (7, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in ROWS], SCHEMA)


def pairs(df, *names):
    return sorted(((r.doc_id, *[r[n] for n in names]) for r in df.collect()), key=repr)


def test_token_counts(docs):
    got = pairs(count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN), "n_bytes", "n_tokens", "over_limit")
    assert len(got) == len(ROWS) and (1, 0, 0, False) in got and (2, 0, 0, False) in got and got.count((3, 13, 3, False)) == 2
    assert count_tokens(docs.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_codec(docs):
    got = encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in ROWS)


def test_token_binary(spark, docs):
    got = token_binary(docs, P.path("word_bpe_49k.json")).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(got) == len(ROWS)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 4))
    assert token_binary(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_secrets(docs):
    got = pairs(scan_secrets(docs, P.path("byte_bpe_50k.json")), "spans")
    assert len(got) == len(ROWS) and all(s == [] for _, s in got)


def test_warc(spark):
    same = "y" * 200
    rows = [(1, "u", same), (2, None, same), (2, None, same), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", same), (6, "u", "é" * 60)]
    got = archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.gap_start is None for r in got)
    kinds = sorted(((r.page, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr)
    want = [(1, "response", None, 200), (2, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "revisit", 1, 200), (6, "response", None, 120)]
    assert kinds == sorted(want, key=repr)
    assert {r.payload_digest for r in got if r.page in (1, 2)} == {hashlib.sha256(same.encode()).hexdigest()}
    assert archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_lost_record_is_an_error(spark, tmp_path):
    import gzip

    from pactlens.llm import warc
    from pactlens.llm._common import Stage

    members = [gzip.compress(warc.record(str(i), None, b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None), mtime=0) for i in range(5)]
    files = lambda data: spark.createDataFrame([("a", data), ("b", None)], "path string, content binary")
    assert warc.all_of(warc.read_warc(files(b"".join(members))), 5, Stage(spark, "whole")).count() == 5
    damaged = b"".join(members[:2]) + members[2][:-1] + b"?" + b"".join(members[3:])
    with pytest.raises(warc.LostRecords, match="5 records written, 4 read, 1 gaps, one in a"):
        warc.all_of(warc.read_warc(files(damaged)), 5, Stage(spark, "damaged"))
    with pytest.raises(warc.LostRecords, match="5 records written, 4 read, 0 gaps"):
        warc.all_of(warc.read_warc(files(b"".join(members[1:]))), 5, Stage(spark, "short"))
    assert warc.archived_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(i, None, "y" * 5_000_000 if i == 1 else None, "z") for i in (1, 2, 2, None)], "page_id long, url string, html string, payload string").repartition(3)
    assert sorted((r.page or 0, r.payload_bytes) for r in warc.archived_records(pages).collect()) == [(0, 0), (1, 5_000_000), (2, 0), (2, 0)]


def near(i):
    words = [f"v{k}" for k in range(60)]
    words[i] = "changed"
    return " ".join(words)


def test_near_duplicates(spark, docs):
    extra = [(20, near(0)), (21, near(59)), (22, near(0).upper()), (23, "quite another text of a few words here")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(table).collect()}
    assert got[5] == (5, True) and got[6] == (5, False) and got[20] == (20, True) and got[21] == (20, False) and got[22] == (20, False) and got[23] == (23, True)
    assert got[1] == (1, True) and got[2] == (2, True) and got[3] == (3, True) and got[None] == (None, True)
    kept = keep_one(table.withColumn("component", F.lit(1))).select("doc_id").collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted([1, 2, 3, 3, 4, None, 5, 7, 20, 23], key=repr)


def test_empty_near_duplicates(docs):
    assert near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    a, b = " ".join(f"k{i}" for i in range(40)), " ".join(f"k{i}" for i in range(41))
    rows = [(1, f"{a}\nshort line\n\nown line of one"), (2, f"{b}\nshort line\nown line of two"), (3, None), (4, ""), (5, "short line"), (6, "short line\nshort line"), (5, "short line")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)))
    got = pairs(out, "text", "__n_lines", "__n_gone")
    want = [(1, rows[0][1], 3, 0), (2, "own line of two", 3, 2), (3, None, 0, 0), (4, "", 0, 0), (5, "", 1, 1), (5, "", 1, 1), (6, "", 2, 2)]
    assert got == sorted(want, key=repr)
    left = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), drop_emptied=True)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_wide_ids(spark):
    """Ids over the whole range of a long, null among them: the earliest keeps its line."""
    a = " ".join(f"k{i}" for i in range(40))
    rows = [(2**63 - 1, a), (-(2**63), f"{a} more"), (0, f"{a}\nown line"), (None, "short line"), (7, "short line")]
    got = pairs(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "text", "__n_gone")
    want = [(2**63 - 1, "", 1), (-(2**63), f"{a} more", 0), (0, "own line", 1), (None, "short line", 0), (7, "", 1)]
    assert got == sorted(want, key=repr)


def test_decontamination(spark, docs):
    item = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    items = spark.createDataFrame([(1, item), (2, "tiny"), (3, None), (4, "!!"), (None, "nine ten"), (1, item)], "item_id long, text string")
    rows = [(30, "so " + item.lower() + " so"), (31, item[:30]), (32, "it is tiny, tiny")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r["items"]) for r in decontaminate(table, items).collect()}
    assert got[30] == (14, 12, 1, ["1"]) and got[31][1] == 0 and got[32] == (4, 2, 1, ["2"]) and got[None][1:] == (2, 0, []) and got[1] == (0, 0, 0, [])
    assert {r.doc_id for r in keep_clean(table, items).collect()} == {1, 2, 3, 4, 5, 6, 7, 31}
    assert decontaminate(table, items.limit(0)).filter("n_hit > 0").count() == 0


def test_quality_rules(spark, docs):
    import random

    rng = random.Random(3)
    # no 5-word window twice, so that the base rule passes
    text = lambda bad: " ".join(f"w{rng.randint(0, 9999)}" + ("$$" if bad else "") for _ in range(40))
    rows = [(i, text(i % 3 == 0)) for i in range(240)] + [(900, None), (901, "few words"), (None, text(True)), (902, "a b c d e " * 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(180)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(table, labels).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in range(240)) and not got[None].kept
    assert got[900].base_failed and got[900].n_words == 0 and got[901].base_failed and got[902].n_repeat_words == 40 and got[902].base_failed
    assert keep_good(table.withColumn("words", F.lit(1)), labels).columns == ["doc_id", "text", "words"]
    none = labels.limit(0)
    assert {r.doc_id for r in quality_rules(table, none).filter("kept").collect()} == {*range(240), None}


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0), (None, 1)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 1.0 and r.predicted == 1 for r in classify(docs, labels.limit(0)).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op4_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("name", ["op3_near_duplicates", "op6_warc", "op7_decontamination", "op10_line_dedup"])
def test_query_equals_sql(spark, name):
    import duckdb

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(q.oracle_sql()[name])
    got = q.queries()[name](spark, sf).select(*[c[0] for c in want.description]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_pipeline_equals_plain_code(spark):
    """run() against the stages' decisions written plainly, with the learned list as it was fitted."""
    import corpus_pipeline as cp
    import tiktoken

    from pactlens.llm.bpe_codec import read_ranks

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in cp.quality(spark, docs, sf).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = {i: i + 32 for i in range(65, 91)}

    def shingle(t):
        w = word.findall(t.translate(low))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    seen, holders, texts = [], {}, {}
    for d in sorted(kept):
        left, had = [], False
        for line in kept[d].split("\n"):
            s = shingle(line)
            if not s:
                left.append(line)
                continue
            had = True
            near_by = {i for t in s for i in holders.get(t, ())}
            if not any(similar(s, seen[i]) for i in near_by):
                left.append(line)
            for t in s:
                holders.setdefault(t, []).append(len(seen))
            seen.append(s)
        if not had or any(shingle(x) for x in left):
            texts[d] = "\n".join(left)
    sets = {d: shingle(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    texts = {d: t for d, t in texts.items() if find(d) == d}
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = plain(r.text)
        windows.update(tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w)
    sizes = {len(w) for w in windows}
    clean = {d: t for d, t in texts.items() if not any(tuple(w[i : i + k]) in windows for w in [plain(t)] for k in sizes for i in range(len(w) - k + 1))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in cp.run(spark, sf).collect()}
    assert got == {d: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean.items()}
