"""The queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.bpe_codec import encode_decode
from pactlens.llm.classifier import classify
from pactlens.llm.decontam import decontaminate
from pactlens.llm.line_dedup import dedup_lines
from pactlens.llm.near_dup import near_duplicates
from pactlens.llm.packing import pack
from pactlens.llm.quality_rules import quality_rules
from pactlens.llm.resampling import importance
from pactlens.llm.secret_scan import KINDS, scan_secrets
from pactlens.llm.token_binary import token_binary
from pactlens.llm.token_counts import count_tokens
from pactlens.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, codebook_digest, vector_codes, with_label_error
from pactlens.llm.warc import archived_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
     both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
     reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r),
     least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each record read back; an error if any is lost. Null payloads count as empty, a null page id comes after all others."""
    read = archived_records(_table(spark, sf_dir, "pages"))
    return read.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


OP7_SQL = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
     grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT d.doc_id, d.w, z.k, unnest(range(1, len(d.w) - z.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM n) z WHERE len(d.w) >= z.k)),
     hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (k, s)),
     hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
     hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP10_SQL = """
WITH l AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
     w AS (SELECT doc_id, i, x, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
     k AS (SELECT *, list_sort(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda j: array_to_string(w[j:j + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
     c AS (SELECT s, min((doc_id, i)) AS first, len(s) AS n FROM k GROUP BY s),
     g AS (SELECT first, n, unnest(s) AS t FROM c WHERE n > 2),
     p AS (SELECT a.first AS x, b.first AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM g a JOIN g b ON a.t = b.t AND a.first < b.first GROUP BY 1, 2),
     near AS (SELECT DISTINCT y FROM p WHERE 100 * o >= 75 * (nx + ny - o)),
     gone AS (SELECT k.doc_id, k.i FROM k JOIN c USING (s) WHERE c.first <> (k.doc_id, k.i) OR c.first IN (SELECT y FROM near)),
     kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY l.doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark and, for those drawn, its rank. Null and empty texts weigh 0 and are not drawn."""
    found = importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector without null or non-finite components."""
    coded, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    square = "list_sum(list_transform(range(1, len(x.a) + 1), lambda i: (x.a[i] - b.c[i]) * (x.a[i] - b.c[i])))"
    ctes = [
        f"v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS place, list_transform(embedding, lambda z: floor({SCALE} * z::DOUBLE)::BIGINT) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0)",
        f"x AS (SELECT vec_id, label, place, p, q[p * len(q) // {PARTS} + 1:(p + 1) * len(q) // {PARTS}] AS a FROM v, range({PARTS}) r(p))",
        f"b0 AS (SELECT p, place - 1 AS k, a AS c FROM x WHERE place <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        near = f"SELECT x.vec_id, x.label, x.p, x.a, min((({square})::BIGINT, b.k)) AS m FROM x JOIN b{r} b USING (p) GROUP BY ALL"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, a, m[1] AS d, m[2] AS k FROM ({near}))")
        if r < ROUNDS:
            each = f"SELECT p, k, j, floor(sum(a[j]) / count(*))::BIGINT AS c FROM a{r}, range(1, len(a) + 1) z(j) GROUP BY p, k, j"
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.c, o.c) AS c FROM b{r} o LEFT JOIN (SELECT p, k, list(c ORDER BY j) AS c FROM ({each}) GROUP BY p, k) n USING (p, k))")
    return f"""WITH {', '.join(ctes)},
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
      sha AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, k), '')) AS codebooks_sha256 FROM b{ROUNDS})
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, sha"""


OP12_SQL = _op12_sql()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence. Null texts have their end id alone."""
    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_secret_scan": op2_secret_scan,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_counts": op5_token_counts,
        "op6_warc": op6_warc,
        "op7_decontamination": op7_decontamination,
        "op8_token_binary": op8_token_binary,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_line_dedup": op10_line_dedup,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_vector_codes": op12_vector_codes,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_duplicates": OP3_SQL,
        "op6_warc": OP6_SQL,
        "op10_line_dedup": OP10_SQL,
        "op7_decontamination": OP7_SQL,
        "op12_vector_codes": OP12_SQL,
    }
