"""The registered queries on the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions import findings as fn
from pactlens.functions import headings as hd
from pactlens.functions import text as tx
from pactlens.operators import findings as fo
from pactlens.operators import merging, segment, structure, windows
from pactlens.plans import duck as d
from pactlens.sources.contracts import contracts, unique_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, text: every line of every agreement as a paragraph."""
    return contracts(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("idx", "text"))


def cue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.classify(contract_lines(spark, sf_dir))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with all their fields."""
    return fo.grade(cue_findings(spark, sf_dir))


BOTH = f"WITH {d.CONTRACTS}, both_ AS (SELECT 'c' AS kind, doc_id, text FROM contracts UNION ALL SELECT 'd', doc_id, text FROM documents)"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), "doc_id", "text")
    return contracts(spark, sf_dir).select(F.lit("c").alias("kind"), "doc_id", "text").unionByName(docs)


@query(f"{BOTH} SELECT kind, doc_id, {d.normalize('text')} AS clean FROM both_")
def normalize_text(spark, sf_dir):
    return both(spark, sf_dir).select("kind", "doc_id", tx.normalize(F.col("text")).alias("clean"))


@query(f"{BOTH} SELECT kind, doc_id, {d.match_key('text')} AS match_key FROM both_")
def match_key(spark, sf_dir):
    return both(spark, sf_dir).select("kind", "doc_id", tx.match_key(F.col("text")).alias("match_key"))


@query(f"{BOTH} SELECT kind, doc_id, {d.tokens('text')} AS tokens FROM both_")
def token_estimate(spark, sf_dir):
    return both(spark, sf_dir).select("kind", "doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH {d.LINES} SELECT doc_id, idx, level, label, title FROM lines WHERE level IS NOT NULL")
def heading_parse(spark, sf_dir):
    rows = structure.with_headings(contract_lines(spark, sf_dir)).filter("heading IS NOT NULL")
    return rows.select("doc_id", "idx", "heading.level", "heading.label", "heading.title")


@query(f"WITH {d.LINES} SELECT level, label, count(*) AS n FROM lines WHERE level IS NOT NULL GROUP BY level, label")
def heading_kind_counts(spark, sf_dir):
    rows = structure.with_headings(contract_lines(spark, sf_dir)).filter("heading IS NOT NULL")
    return rows.groupBy(F.col("heading.level").alias("level"), F.col("heading.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_OPEN = ", ".join(f"last_value(CASE WHEN level = {k} THEN idx END IGNORE NULLS) OVER w AS i{k}" for k in range(4))


def _path_sql() -> str:
    parts = []
    for k in range(4):
        alive = f"o.i{k} IS NOT NULL" + "".join(f" AND o.i{k} > coalesce(o.i{a}, -1)" for a in range(k))
        parts += [f"CASE WHEN {alive} THEN coalesce(h{k}.{c}, '') ELSE '' END" for c in ("label", "title")]
    joins = " ".join(f"LEFT JOIN lines h{k} ON h{k}.doc_id = o.doc_id AND h{k}.idx = o.i{k}" for k in range(4))
    clean = f"list_filter(list_transform([{', '.join(parts)}], lambda p: array_to_string({d.words('p')}, ' ')), lambda p: p <> '')"
    kept = "array_to_string(list_filter(c, lambda p, i: i = 1 OR lower(p) <> lower(c[i - 1])), ' > ')"
    return f"""WITH {d.LINES}, opened AS (SELECT doc_id, idx, {_OPEN} FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
        SELECT doc_id, idx, {kept} AS path FROM (SELECT o.doc_id, o.idx, {clean} AS c FROM opened o {joins})"""


@query(_path_sql())
def section_path(spark, sf_dir):
    return structure.section_paths(contract_lines(spark, sf_dir)).select("doc_id", "idx", "path")


_OPENS = r"(?i)^([0-9]+(?:\.[0-9]+)*){B}*\.?{B}+([A-Z](?:[A-Z]|{B}){2,}?){B}+(?:\.{B}+|[0-9]+\.[0-9]+{B}+)?[A-Z]".replace("{B}", tx.BLANK)


def _sections_sql() -> str:
    w = f"({d.words(f'regexp_extract(raw, {d.lit(_OPENS)}, 2)')})[1:10]"
    cap = "len(list_filter(w, lambda q: length(q) > 1 AND regexp_matches(q, '\\p{Lu}') AND NOT regexp_matches(q, '\\p{Ll}')))"
    tit = "len(list_filter(w, lambda q: regexp_matches(q, '^\\p{Lu}') AND regexp_matches(q, '\\p{Ll}')))"
    opens = f"num <> '' AND NOT contains(num, '.') AND len(w) > 0 AND (len(w) <= 5 OR 2 * {cap} >= len(w) OR (len(w) BETWEEN 2 AND 4 AND 2 * {tit} >= len(w)))"
    return f"""{d.LINES}, marked AS (SELECT *, coalesce(level BETWEEN 0 AND 2, false) AS top, regexp_extract(raw, {d.lit(_OPENS)}, 1) AS num, {w} AS w FROM lines),
        cut AS (SELECT *, sum(CASE WHEN idx > 0 AND (top OR ({opens})) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM marked)"""


@query(f"WITH {_sections_sql()} SELECT doc_id, idx, section::INTEGER AS section, (row_number() OVER (PARTITION BY doc_id, section ORDER BY idx) - 1)::INTEGER AS pos FROM cut")
def section_split(spark, sf_dir):
    return structure.sections(contract_lines(spark, sf_dir)).select("doc_id", "idx", "section", "pos")


@query(f"WITH {d.LINES} SELECT doc_id, idx, raw FROM lines WHERE {d.signature('raw', 'level IS NULL')}")
def signature_filter(spark, sf_dir):
    return contract_lines(spark, sf_dir).filter(hd.is_signature(F.col("text"))).select("doc_id", "idx", tx.strip(F.col("text")).alias("raw"))


_BLOCKS = f"""WITH {d.CONTRACTS},
  split AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\r\\n?', chr(10), 'g'), chr(10)) AS a FROM contracts),
  every AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS line_no FROM split),
  classed AS (SELECT *, CASE WHEN raw = '' OR {d.has('raw', tx.PAGE_LINE.replace('(?imd)', '(?im)'))} THEN 'BRK' WHEN level IS NOT NULL THEN 'HEAD'
     WHEN {d.has('text', rf'^{tx.BLANK}*(?:[-*\x{{2022}}]|\(?\p{{Nd}}{{1,3}}[).\]]|[A-Za-z][).\]]){tx.BLANK}+')} THEN 'BUL' ELSE 'TXT' END AS cls FROM ({d.headings('every', 'text')})),
  state AS (SELECT *, last_value(CASE WHEN cls <> 'TXT' THEN cls END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
     lag(cls) OVER (PARTITION BY doc_id ORDER BY line_no) AS last FROM classed),
  begun AS (SELECT *, cls = 'HEAD' OR (cls = 'BUL' AND coalesce(prev, '') <> 'BUL') OR (cls = 'TXT' AND coalesce(prev, '') <> 'BUL' AND coalesce(last, '') <> 'TXT') AS begins FROM state),
  numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM begun)
  SELECT doc_id, block::BIGINT AS block, {d.strip(d.sub("string_agg(CASE WHEN begins THEN raw WHEN cls = 'BUL' THEN chr(10) || raw ELSE ' ' || raw END, '' ORDER BY line_no)", rf'(?i)^{tx.BLANK}*Page{tx.BLANK}*-{tx.BLANK}*\p{{Nd}}+{tx.BLANK}*-{tx.BLANK}*', ''))} AS text
  FROM numbered WHERE cls <> 'BRK' GROUP BY doc_id, block"""


@query(f"SELECT * FROM ({_BLOCKS}) WHERE text <> ''")
def line_segmentation(spark, sf_dir):
    return segment.blocks(segment.lines_of(contracts(spark, sf_dir)))


_PACKED = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS line_no FROM (SELECT doc_id,
    string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\r\\n?', chr(10), 'g'), chr(10)) AS a FROM documents)),
  t AS (SELECT doc_id, line_no, {d.strip('raw')} AS s FROM l),
  z AS (SELECT doc_id, line_no, list_filter(string_split({d.sub('s', f'([.!?]){tx.BLANK}+', chr(92) + '1' + chr(1))}, chr(1)), lambda x: x <> '') AS z FROM t WHERE length(s) > 1200),
  c AS (SELECT *, list_transform(range(1, len(z) + 1), lambda j: list_sum(list_transform(z[1:j], lambda x: length(x) + 1))) AS upto FROM z),
  p(doc_id, line_no, part, a, b) AS (
    SELECT doc_id, line_no, 0, 1, greatest(1, coalesce(list_max(list_filter(range(1, len(z) + 1), lambda j: upto[j] - 1 <= 1200)), 1)) FROM c UNION ALL
    SELECT p.doc_id, p.line_no, part + 1, p.b + 1, greatest(p.b + 1, coalesce(list_max(list_filter(range(p.b + 1, len(z) + 1), lambda j: upto[j] - upto[p.b] - 1 <= 1200)), p.b + 1)) FROM p JOIN c USING (doc_id, line_no) WHERE p.b < len(z))
  SELECT doc_id, line_no::INTEGER AS line_no, 0 AS part, s AS text FROM t WHERE length(s) <= 1200
  UNION ALL SELECT doc_id, line_no::INTEGER, part::INTEGER, array_to_string(z[a:b], ' ') FROM p JOIN c USING (doc_id, line_no)"""


@query(_PACKED)
def sentence_pack(spark, sf_dir):
    lines = segment.lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "line_no", F.posexplode(segment.pack_sentences(F.col("s"))).alias("part", "text"))


@query()
def paragraph_split(spark, sf_dir):
    return segment.paragraphs_of(contracts(spark, sf_dir))


@query()
def continuation_merge(spark, sf_dir):
    return segment.merge_continuations(segment.paragraphs_of(contracts(spark, sf_dir)))


_TIDY = f"""WITH RECURSIVE {d.LINES}, flags AS (SELECT doc_id, idx, text, level IS NOT NULL AS h, {d.signature('raw', 'level IS NULL')} AS s, len({d.words('text')}) AS n FROM lines),
  per AS (SELECT doc_id, list({{'idx': idx, 'text': text, 'h': h, 's': s, 'n': n, 'stops': n = 0 OR h OR n > 2}} ORDER BY idx) AS f FROM flags GROUP BY doc_id),
  ahead AS (SELECT doc_id, i, f[i] AS e, f[i:i + 4] AS a, coalesce(list_position(list_transform(f[i:i + 4], lambda x: x.stops), true), 0) AS stop FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i FROM per)),
  runs AS (SELECT doc_id, i, e, CASE WHEN stop = 0 THEN len(a) ELSE stop - 1 END AS size, NOT (e.s OR e.stops) AND (stop = 0 OR NOT a[stop].h) AS may FROM ahead),
  told AS (SELECT doc_id, i, e, may AND size >= 3 AS run, i + CASE WHEN may AND size >= 3 THEN size ELSE 1 END AS after FROM runs),
  met(doc_id, i) AS (SELECT doc_id, 1::BIGINT FROM per UNION ALL SELECT met.doc_id, told.after FROM met JOIN told USING (doc_id, i))
  SELECT doc_id, e.idx::INTEGER AS idx, e.text AS text FROM met JOIN told USING (doc_id, i) WHERE e.n > 0 AND (e.h OR NOT (e.s OR run))"""


@query(_TIDY)
def garbage_filter(spark, sf_dir):
    return structure.drop_garbage(contract_lines(spark, sf_dir)).select("doc_id", "idx", "text")


def one_section(docs: DataFrame) -> DataFrame:
    """Every line of the texts as a paragraph of one section."""
    lines = docs.select("doc_id", F.posexplode(F.split(tx.text_of(F.col("text")), "\n")).alias("idx", "text"))
    return windows.body(lines.withColumn("section", F.lit(0)))


def doc_bodies(spark, sf_dir) -> DataFrame:
    return one_section(table(spark, sf_dir, "documents"))


def tokens_sql(source: str, window: int, stride: int) -> str:
    """The windows of one section of the lines of a source's texts: bodies, sums and kept."""
    return f"""bodies AS (SELECT doc_id, b, x, {d.tokens('x')} AS tokens FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS b FROM {source})),
  sums AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY b) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM bodies),
  starts(doc_id, k, s) AS (SELECT DISTINCT doc_id, 0, 0 FROM bodies UNION ALL
    SELECT st.doc_id, st.k + 1, min(a.b) + 1 FROM starts st JOIN sums z ON z.doc_id = st.doc_id AND z.b = st.s JOIN sums a ON a.doc_id = st.doc_id AND a.b >= st.s AND a.upto - z.upto + z.tokens >= {stride} AND a.b + 1 < a.n GROUP BY st.doc_id, st.k, st.s),
  ends AS (SELECT st.doc_id, st.k, st.s, any_value(z.n) AS n, coalesce(min(CASE WHEN a.upto - z.upto + z.tokens >= {window} THEN a.b + 1 END), any_value(z.n)) AS e
    FROM starts st JOIN sums z ON z.doc_id = st.doc_id AND z.b = st.s JOIN sums a ON a.doc_id = st.doc_id AND a.b >= st.s GROUP BY st.doc_id, st.k, st.s),
  kept AS (SELECT * FROM (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM ends) WHERE prev IS NULL OR e > prev)"""


_TOKENS = tokens_sql("documents", windows.WINDOW_TOKENS, windows.STRIDE_TOKENS)


@query(f"WITH RECURSIVE {_TOKENS} SELECT doc_id, printf('w_%04d_%04d', s, e - 1) AS window_id, s::INTEGER AS start_pos, e::INTEGER AS end_pos FROM kept")
def window_plan(spark, sf_dir):
    return windows.plan_windows(doc_bodies(spark, sf_dir), fraction=None).select("doc_id", "window_id", "start_pos", "end_pos")


@query(f"""WITH RECURSIVE {_TOKENS} SELECT k.doc_id, printf('w_%04d_%04d', s, e - 1) AS window_id, count(*) AS n, sum(length(x) + 40)::BIGINT AS size, sum(tokens)::BIGINT AS tokens
  FROM kept k JOIN bodies m ON m.doc_id = k.doc_id AND m.b >= k.s AND m.b < k.e GROUP BY k.doc_id, s, e""")
def window_members(spark, sf_dir):
    bodies = doc_bodies(spark, sf_dir)
    rows = windows.members(windows.plan_windows(bodies, fraction=None), bodies)
    return rows.groupBy("doc_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text") + windows.PER_PARAGRAPH).cast("long").alias("size"), F.sum("tokens").cast("long").alias("tokens"))


@query(f"""WITH RECURSIVE {_TOKENS}, w AS (SELECT k.doc_id, k.s, k.e, list(length(x) + 40 ORDER BY m.b) AS z FROM kept k JOIN bodies m ON m.doc_id = k.doc_id AND m.b >= k.s AND m.b < k.e GROUP BY ALL),
  p(doc_id, s, e, z, part, a, b) AS (SELECT doc_id, s, e, z, 0, 1, greatest(1, coalesce(list_max(list_filter(range(1, len(z) + 1), lambda i: list_sum(z[1:i]) <= 2000)), 1)) FROM w UNION ALL
    SELECT doc_id, s, e, z, part + 1, greatest(b, a + 1), greatest(greatest(b, a + 1), coalesce(list_max(list_filter(range(greatest(b, a + 1), len(z) + 1), lambda i: list_sum(z[greatest(b, a + 1):i]) <= 2000)), 0)) FROM p WHERE b < len(z))
  SELECT doc_id, s::INTEGER AS main_start, part::INTEGER AS part, (s + a - 1)::INTEGER AS start_pos, (s + b)::INTEGER AS end_pos FROM p""")
def window_size_split(spark, sf_dir):
    bodies = doc_bodies(spark, sf_dir)
    rows = windows.members(windows.plan_windows(bodies, fraction=None), bodies)
    per = rows.groupBy("doc_id", "main_start").agg(F.sort_array(F.collect_list(F.struct("b", (F.length("text") + windows.PER_PARAGRAPH).cast("long").alias("z")))).alias("p"))
    per = per.select("doc_id", "main_start", F.transform("p", lambda x: x["z"]).alias("z"))
    return per.select("doc_id", "main_start", F.inline(windows.split_oversize(F.col("z"), F.col("main_start"), 2000))).select("doc_id", "main_start", "part", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


_EDGE = "greatest(1, round_even(length(text) * 0.15, 0))"
_LAST = "length(regexp_extract(text, '(?is)^(.*)\\b(except|provided that|subject to|notwithstanding|unless)\\b', 1))"
_FIRST = "length(regexp_extract(text, '(?is)^(.*?)\\b(except|provided that|subject to|notwithstanding|unless)\\b', 1))"


_GROWN = f"""WITH RECURSIVE {_sections_sql()},
  parts AS (SELECT {{'d': doc_id, 's': section}} AS doc_id, string_agg(text, chr(10) ORDER BY idx) AS text, list(idx ORDER BY idx) AS ids FROM cut WHERE NOT top GROUP BY cut.doc_id, section),
  {tokens_sql('parts', 40, 15)},
  texts AS (SELECT k.doc_id, k.s, k.e, k.n, string_agg(x, chr(10) || chr(10) ORDER BY m.b) AS text FROM kept k JOIN bodies m ON m.doc_id = k.doc_id AND m.b >= k.s AND m.b < k.e GROUP BY ALL),
  edges AS (SELECT *, {d.has('text', tx.TRIGGER)} AND {_FIRST} <= {_EDGE} AS near_start, {d.has('text', tx.TRIGGER)} AND {_LAST} >= greatest(0, length(text) - {_EDGE}) AS near_end FROM texts),
  before AS (SELECT doc_id, b, upto - tokens AS gone FROM sums UNION ALL SELECT doc_id, max(b) + 1, max(upto) FROM sums GROUP BY doc_id),
  grown AS (SELECT w.doc_id, w.s, w.e, any_value(w.near_start) AS near_start, any_value(w.near_end) AS near_end, any_value(w.n) AS n,
    max(CASE WHEN a.b <= w.s AND at_s.gone - a.gone >= 15 THEN a.b END) AS back, min(CASE WHEN a.b >= w.e AND a.gone - at_e.gone >= 15 THEN a.b END) AS forth
    FROM edges w JOIN before a USING (doc_id) JOIN before at_s ON at_s.doc_id = w.doc_id AND at_s.b = w.s JOIN before at_e ON at_e.doc_id = w.doc_id AND at_e.b = w.e GROUP BY w.doc_id, w.s, w.e)
  SELECT doc_id.d AS doc_id, doc_id.s::INTEGER AS section, printf('w_%04d_%04d', ids[s + 1], ids[e]) AS window_id, CASE WHEN near_start AND s > 0 THEN coalesce(back, 0) ELSE s END::INTEGER AS start_pos,
    CASE WHEN near_end AND e < n THEN coalesce(forth, n) ELSE e END::INTEGER AS end_pos, s::INTEGER AS main_start, e::INTEGER AS main_end FROM grown JOIN parts USING (doc_id)"""


@query(_GROWN)
def window_extend(spark, sf_dir):
    parted = structure.sections(contract_lines(spark, sf_dir))
    return windows.plan_windows(windows.body(parted), window=40, stride=15)


@query(f"WITH {d.CONTRACTS} SELECT doc_id, {d.has('text', tx.TRIGGER)} AS has_trigger, {d.has('text', tx.TRIGGER)} AND {_FIRST} <= {_EDGE} AS near_start, {d.has('text', tx.TRIGGER)} AND {_LAST} >= greatest(0, length(text) - {_EDGE}) AS near_end FROM contracts")
def trigger_edges(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", tx.has_trigger(F.col("text")).alias("has_trigger"), tx.trigger_edges(F.col("text")).alias("e")).select("doc_id", "has_trigger", "e.near_start", "e.near_end")


@query(f"WITH {d.LINES} SELECT doc_id, idx, {d.has('raw', hd.CONTACT_ONLY)} AS contact FROM lines WHERE raw <> ''")
def contact_lines(spark, sf_dir):
    return contract_lines(spark, sf_dir).withColumn("raw", tx.strip(F.col("text"))).filter("raw <> ''").select("doc_id", "idx", hd.is_contact(F.col("raw")).alias("contact"))


@query(f"WITH {d.FOUND} SELECT doc_id, idx, n, quote, category_id, severity, violation FROM found")
def cue_classify(spark, sf_dir):
    return cue_findings(spark, sf_dir)


@query(f"WITH {d.FOUND} SELECT doc_id, idx, category_id, {d.SEVERITY} AS severity, md5(quote) AS quote_md5, row_number() OVER (PARTITION BY doc_id ORDER BY idx, n, category_id) AS place FROM found")
def findings_order(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "idx", "category_id", "severity", F.md5(F.col("quote").cast("binary")).alias("quote_md5"), F.col("seq").cast("long").alias("place"))


_SCORES = f"""WITH {d.FOUND}, g AS (SELECT *, {d.SEVERITY} AS sev, row_number() OVER (PARTITION BY doc_id ORDER BY idx, n, category_id) AS seq FROM found)"""


@query(f"{_SCORES} SELECT doc_id, least(100, 20 * count(*) FILTER (sev = 'high') + 10 * count(*) FILTER (sev = 'medium'))::BIGINT AS risk_score, count(*) FILTER (sev = 'high') AS high, count(*) FILTER (sev = 'medium') AS medium, 0::BIGINT AS low FROM contracts LEFT JOIN g USING (doc_id) GROUP BY doc_id")
def risk_summary(spark, sf_dir):
    return fo.summarize(graded(spark, sf_dir), contracts(spark, sf_dir)).drop("top_categories").withColumn("risk_score", F.col("risk_score").cast("long"))


@query(f"{_SCORES} SELECT doc_id, category_id, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(seq)) AS rank FROM g GROUP BY doc_id, category_id QUALIFY rank <= 10")
def top_categories(spark, sf_dir):
    return fo.top_categories(graded(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query()
def summary_full(spark, sf_dir):
    return fo.summarize(merging.merge_findings(graded(spark, sf_dir), times=2).select("doc_id", "seq", "category_id", "severity"), contracts(spark, sf_dir))


@query()
def dedupe_full(spark, sf_dir):
    return merging.merge_findings(graded(spark, sf_dir))


@query(f"{_SCORES}, k AS (SELECT *, {d.dedupe_key('category_id', 'quote', "'- ' || category_id")} AS dedupe_key FROM g) SELECT doc_id, seq::INTEGER AS seq, dedupe_key FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, dedupe_key ORDER BY seq) = 1")
def dedupe_exact(spark, sf_dir):
    return fo.dedupe_exact(graded(spark, sf_dir)).select("doc_id", "seq", "dedupe_key")


@query(f"{_SCORES}, k AS (SELECT *, {d.match_key('quote')} AS key FROM g) SELECT doc_id, seq::INTEGER AS seq, category_id FROM k QUALIFY length(key) <= 20 OR row_number() OVER (PARTITION BY doc_id, category_id, key ORDER BY length(quote) DESC, seq) = 1")
def dedupe_quote_category(spark, sf_dir):
    return fo.best_by_quote(graded(spark, sf_dir)).select("doc_id", "seq", "category_id")


_GOES_ON = " OR ".join(f"(len(u) >= {n} AND len(v) >= {n} AND (u[-{n}:] = v[1:{n}] OR v[-{n}:] = u[1:{n}]))" for n in (3, 4, 5))
_TELLING = f"list_filter({{}}, lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(d.lit, fn.STOP))}))"


@query(f"""WITH {d.FOUND}, numbered AS (SELECT doc_id, category_id, quote, row_number() OVER (PARTITION BY doc_id ORDER BY idx, n, category_id) AS seq FROM found),
  pairs AS (SELECT doc_id, category_id, seq, lead(seq) OVER w AS other, {d.match_key('quote')} AS x, lead({d.match_key('quote')}) OVER w AS y FROM numbered WINDOW w AS (PARTITION BY doc_id, category_id ORDER BY seq)),
  worded AS (SELECT *, {d.words('x')} AS u, {d.words('y')} AS v FROM pairs WHERE other IS NOT NULL),
  telling AS (SELECT *, {_TELLING.format('u')} AS tu, {_TELLING.format('v')} AS tv, length(x) < length(y) AS x_is_less FROM worded),
  own AS (SELECT *, CASE WHEN x_is_less THEN tu ELSE tv END AS own, contains(x, y) OR contains(y, x) OR {_GOES_ON} AS continues FROM telling)
  SELECT doc_id, category_id, seq::INTEGER AS seq, other::INTEGER AS other, continues,
    continues OR len(list_intersect(tu, tv)) >= 3 OR len(list_filter(own, lambda w: list_contains(CASE WHEN x_is_less THEN v ELSE u END, w))) >= greatest(3.0, len(own) * 0.5) AS related FROM own""")
def quotes_intersect_pairs(spark, sf_dir):
    found = graded(spark, sf_dir).select("doc_id", "category_id", "seq", "quote")
    after = F.lead(F.struct("seq", "quote")).over(Window.partitionBy("doc_id", "category_id").orderBy("seq"))
    pairs = found.withColumn("next", after).filter("next IS NOT NULL")
    loose, strict = (fn.quotes_intersect(F.col("quote"), F.col("next.quote"), s) for s in (False, True))
    return pairs.select("doc_id", "category_id", "seq", F.col("next.seq").alias("other"), loose.alias("related"), strict.alias("continues"))


#: Quotes of an agreement that are looked for in it: as written, in other case and spacing, over a line's end, and one that is not there.
_QUOTES = [(1, "The goods consist of the following:"), (2, "the  GOODS consist of\tthe following:"), (3, "- spare parts; and\n\n(3) manuals for each"), (4, "The Supplier sells nothing at all"), (5, "the supplier MAY terminate this agreement at any time for convenience")]


#: Two more for the cascade: in other case over a line's end, and with a word that is not there.
_ALL_TIERS = [*_QUOTES, (6, "under this Agreement, that are in STOCK - spare"), (7, "The courts decide under the Housing Act of 1988 and common law on penalties")]


def located(spark, sf_dir, asked=tuple(_QUOTES), upto: int = 6) -> DataFrame:
    docs = contracts(spark, sf_dir).select("doc_id")
    quotes = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("quote_id"), F.lit(q).alias("quote")) for i, q in asked])))
    paragraphs = contract_lines(spark, sf_dir).withColumn("text", tx.normalize(F.col("text")))
    return fo.locate(quotes.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(1 << 20)), paragraphs, upto)


def _framed_sql(n: int) -> str:
    """What runs from the quote's first n words to its last n in t, null if they are not there."""
    first, last = f"array_to_string(kw[1:{n}], ' ')", f"array_to_string(kw[greatest(len(kw) - {n - 1}, 1):], ' ')"
    begin = f"instr(lower(t), {first})"
    end = f"instr(substr(lower(t), {begin}), {last})"
    return f"CASE WHEN len(kw) >= {n} AND {begin} > 0 AND {end} > 1 THEN {d.strip(f'substr(t, {begin}, {end} - 1 + length({last}))')} END"


_CASCADE = f"""WITH {d.RAW}, q(quote_id, quote) AS (VALUES {', '.join(f"({i}, {d.lit(q)})" for i, q in _ALL_TIERS)}), keyed AS (SELECT *, {d.words('key')} AS kw FROM (SELECT *, {d.match_key('quote')} AS key FROM q)),
  p AS (SELECT doc_id, idx, {d.normalize('text')} AS t, {d.match_key('text')} AS k FROM raw_lines),
  placed AS (SELECT *, sum(length(t) + 2) OVER w - length(t) - 2 AS from_t, sum(length(k) + 1) OVER w - length(k) - 1 AS from_k FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
  whole AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY idx) AS tt, string_agg(k, ' ' ORDER BY idx) AS kk FROM p GROUP BY doc_id),
  framed AS (SELECT *, {_framed_sql(5)} AS five, {_framed_sql(3)} AS three, instr(tt, quote) - 1 AS at_t, instr(kk, key) - 1 AS at_k FROM placed JOIN whole USING (doc_id), keyed),
  hits AS (SELECT doc_id, quote_id, 1 AS tier, idx, quote AS evidence FROM framed WHERE contains(t, quote)
    UNION ALL SELECT doc_id, quote_id, 2, idx, CASE WHEN length(five) >= length(quote) * 0.5 THEN five WHEN length(three) >= length(quote) * 0.5 THEN three ELSE quote END FROM framed WHERE length(key) > 20 AND contains(k, key)
    UNION ALL SELECT doc_id, quote_id, 3, idx, quote FROM framed WHERE at_t >= from_t AND at_t < from_t + length(t)
    UNION ALL SELECT doc_id, quote_id, 4, idx, quote FROM framed WHERE at_k >= from_k AND at_k < from_k + length(k)
    UNION ALL SELECT doc_id, quote_id, 6, idx, five FROM framed WHERE length(key) > 30 AND len(kw) >= 5 AND contains(k, array_to_string(kw[1:7], ' ')) AND length(five) >= length(quote) * 0.6)
  SELECT doc_id, quote_id::INTEGER AS quote_id, arg_min(tier, (tier, idx))::INTEGER AS tier, arg_min(idx, (tier, idx))::INTEGER AS idx, arg_min(evidence, (tier, idx)) AS evidence FROM hits GROUP BY doc_id, quote_id"""


@query(_CASCADE)
def quote_locate_cascade(spark, sf_dir):
    return located(spark, sf_dir, _ALL_TIERS)


_EXACT = f"""WITH {d.LINES}, q(quote_id, quote) AS (VALUES {', '.join(f"({i}, {d.lit(q)})" for i, q in _QUOTES if i in (1, 4))})
  SELECT doc_id, quote_id::INTEGER AS quote_id, min(idx)::INTEGER AS idx FROM (SELECT doc_id, idx, {d.normalize('text')} AS t FROM raw_lines) JOIN q ON contains(t, quote) GROUP BY doc_id, quote_id"""


@query(_EXACT)
def quote_locate_exact(spark, sf_dir):
    # a quote's place depends on no other quote, nor on tiers behind the one that finds it
    return located(spark, sf_dir, [q for q in _QUOTES if q[0] in (1, 4)], 1).filter("tier = 1").select("doc_id", "quote_id", "idx")


_KEYED = f"""WITH {d.LINES}, q(quote_id, key) AS (SELECT quote_id, {d.match_key('quote')} FROM (VALUES {', '.join(f"({i}, {d.lit(q)})" for i, q in _QUOTES if i in (2, 5))}) v(quote_id, quote))
  SELECT doc_id, quote_id::INTEGER AS quote_id, min(idx)::INTEGER AS idx FROM (SELECT doc_id, idx, {d.match_key('text')} AS t FROM raw_lines) JOIN q ON length(key) > 20 AND contains(t, key) GROUP BY doc_id, quote_id"""


@query(_KEYED)
def quote_locate_normalized(spark, sf_dir):
    return located(spark, sf_dir, [q for q in _QUOTES if q[0] in (2, 5)], 2).filter("tier = 2").select("doc_id", "quote_id", "idx")


@query(f"""WITH {d.LINES}, q(quote_id, quote) AS (VALUES {', '.join(f"({i}, {d.lit(q)})" for i, q in _QUOTES)}), k AS (SELECT doc_id, string_agg({d.match_key('text')}, ' ' ORDER BY idx) AS t FROM raw_lines GROUP BY doc_id)
  SELECT doc_id, quote_id::INTEGER AS quote_id FROM k, q WHERE NOT contains(t, {d.match_key('quote')})""")
def unlocated_anti_join(spark, sf_dir):
    docs = contracts(spark, sf_dir).select("doc_id")
    asked = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i, _ in _QUOTES])).alias("quote_id"))
    return asked.join(located(spark, sf_dir), ["doc_id", "quote_id"], "left_anti")


@query(f"""WITH {d.LINES}, quotes(quote) AS (VALUES ('e '), ('The Supplier'), ('agreement')), m AS (SELECT doc_id, idx, quote, text, unnest(range(1, length(text) + 1)) AS i FROM raw_lines, quotes WHERE contains(text, quote))
  SELECT doc_id, idx, quote AS quote_id, (i - 1)::INTEGER AS start, (i - 1 + length(quote))::INTEGER AS "end" FROM m WHERE substr(text, i, length(quote)) = quote""")
def highlight_ranges(spark, sf_dir):
    lines = contract_lines(spark, sf_dir)
    quotes = lines.select("doc_id", "idx", F.explode(F.array(*map(F.lit, ("e ", "The Supplier", "agreement")))).alias("quote")).withColumn("quote_id", F.col("quote"))
    return fo.highlight_ranges(lines, quotes)


_REFS = f"""WITH {d.LINES}, refs AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+ )+(?:Act|Regulations)(?: [0-9]{{4}}(?:, sections [0-9-]+)?)?|common law on [a-z]+|[A-Z][a-z]+ Department')) AS ref FROM raw_lines)"""


@query(f"{_REFS} SELECT doc_id, idx, ref, {d.valid_reference('ref')} AS valid FROM refs")
def legal_ref_filter(spark, sf_dir):
    pattern = r"((?:[A-Z][A-Za-z]+ )+(?:Act|Regulations)(?: [0-9]{4}(?:, sections [0-9-]+)?)?|common law on [a-z]+|[A-Z][a-z]+ Department)"
    refs = contract_lines(spark, sf_dir).select("doc_id", "idx", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("ref"))
    return refs.select("doc_id", "idx", "ref", fn.is_valid_reference(F.col("ref")).alias("valid"))


@query(f"{_REFS}, a AS (SELECT doc_id, count(*) AS n, count_if({d.valid_reference('ref')}) AS v FROM refs GROUP BY doc_id) SELECT doc_id, n, least(v, 6)::BIGINT AS kept, CASE WHEN v = 0 THEN 'regenerate' ELSE 'keep' END AS action FROM a")
def legal_ref_policy(spark, sf_dir):
    refs = legal_ref_filter(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("ref").alias("refs"))
    return refs.select("doc_id", F.size("refs").cast("long").alias("n"), fn.reference_policy(F.col("refs")).alias("p")).select("doc_id", "n", F.size("p.references").cast("long").alias("kept"), "p.action")


@query(f"SELECT p_partkey, {d.slug('p_name')} AS slug FROM part")
def category_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query(f"WITH s AS (SELECT p_partkey, {d.slug('p_type')} AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN s ELSE s || '_' || k END AS id FROM r")
def category_uniquify(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_type")).alias("id"))
    return unique_ids(rows, "p_partkey").select("p_partkey", "id")


@query(f"WITH t AS (SELECT {d.slug('n_name')} AS id, {d.squeeze('n_name')} AS name FROM nation), c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN ' ' || upper(n_name) || ' & Co' ELSE {d.slug('n_name')} END AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, category, coalesce((SELECT min(id) FROM t WHERE t.id = category), (SELECT min(id) FROM t WHERE t.name = {d.squeeze('category')}), {d.slug('category')}) AS category_id FROM c")
def category_resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    tax = nation.select(tx.slug(F.col("n_name")).alias("id"), F.col("n_name").alias("name"))
    named = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    k, n = F.col("s_suppkey") % 4, F.col("n_name")
    rows = named.select("s_suppkey", F.when(k == 0, n).when(k == 1, F.lower(n)).when(k == 2, F.concat(F.lit(" "), F.upper(n), F.lit(" & Co"))).otherwise(tx.slug(n)).alias("category"))
    return fo.resolve_categories(rows, tax).select("s_suppkey", "category", "category_id")


@query("WITH " + d.FOUND + f", routed AS (SELECT DISTINCT doc_id, idx, category_id FROM raw_lines JOIN cues ON {' OR '.join(f'(category_id = {d.lit(c.category_id)} AND {d.has("text", c.pattern)})' for c in fo.CUES)}) SELECT doc_id, idx, category_id FROM routed WHERE category_id IN ('audit_rights', 'uncapped_liability')")
def router_semi_join(spark, sf_dir):
    allowed = spark.createDataFrame([("audit_rights",), ("uncapped_liability",)], "category_id string")
    routed = fo.route(contract_lines(spark, sf_dir)).select("doc_id", "idx", F.explode("routed").alias("category_id"))
    return routed.join(F.broadcast(allowed), "category_id", "left_semi").select("doc_id", "idx", "category_id")


@query(f"SELECT conv_id, turn, {d.title_case('text')} AS title, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS html FROM conversations")
def title_and_escape(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", tx.title_case(F.col("text")).alias("title"), tx.escape_html(F.col("text")).alias("html"))


@query(f"SELECT page_id, 'job' || page_id || '__' || coalesce(nullif({d.sub('url', r'[^\p{L}\p{N}\-_. ]', '')}, ''), 'upload.pdf') AS name FROM pages")
def upload_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.upload_name(F.concat(F.lit("job"), F.col("page_id").cast("string")), F.col("url")).alias("name"))


@query(f"SELECT p_partkey, {d.squeeze('''split_part(p_type, '-', 1)''')} AS label, {d.strip('p_name')} AS name FROM part")
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.short_label(F.col("p_type")).alias("label"), tx.without_label(F.col("p_name"), "category").alias("name"))


#: Answers of a model, by event type, that extraction must cope with.
_ANSWERS = {
    "view": 'Here you are:\n```json\n{"findings": [{"category": "audit rights", "quote": "a {b}", "risk_assessment": {"severity_of_consequences": 7}, "risk_category": "PENALTY"}]}\n```',
    "signup": '{"findings": [{"evidence": "x", "consequences_category": "void", "risk_assessment": {"severity_of_consequences": "2"}, "risk_category": "Failure of obligations"}]}',
    "error": "no object here",
    "click": '{"findings": []}',
    "purchase": '{"findings": [{"category": "The termination for my convenience", "quote": "q", "risk_assessment": {"severity_of_consequences": 2.5}, "consequences_category": "odd"}, {"category": "Other Thing", "quote": "z"}]}',
}
_EXTRACTED = {
    "view": [("Audit Rights", "a {b}", 3, "Nothing", "Penalty")],
    "signup": [("Termination For Convenience", "x", 2, "Void", fn.LATE)],
    "purchase": [("Termination For Convenience", "q", 2, "Nothing", "Nothing"), ("Other Thing", "z", 0, "Nothing", "Nothing")],
}


@query(
    "SELECT event_id, category, quote, score, consequence, risk FROM events JOIN (VALUES "
    + ", ".join(f"({d.lit(t)}, {d.lit(c)}, {d.lit(q)}, {s}, {d.lit(k)}, {d.lit(r)})" for t, rows in _EXTRACTED.items() for c, q, s, k, r in rows)
    + ") v(t, category, quote, score, consequence, risk) ON event_type = t"
)
def json_extract_findings(spark, sf_dir):
    raw = F
    for t, a in _ANSWERS.items():
        raw = raw.when(F.col("event_type") == t, F.lit(a))
    found = table(spark, sf_dir, "events").select("event_id", F.inline(fn.parse_findings(raw)))
    return found.select("event_id", "category", "quote", F.col("severity_of_consequences").alias("score"), F.col("consequences_category").alias("consequence"), F.col("risk_category").alias("risk"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 2 THEN 'high' ELSE 'medium' END AS severity, CASE lower(l_returnflag) WHEN 'a' THEN 'Void' WHEN 'n' THEN 'Invalid' ELSE 'Nothing' END AS consequence FROM lineitem")
def enum_coercion(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", " VOID ").when(F.col("l_returnflag") == "N", "invalid").otherwise("else")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", fn.severity(F.col("l_linenumber")).alias("severity"), fn.consequence(flag).alias("consequence"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


def job_events(spark, sf_dir) -> DataFrame:
    from pactlens.streaming.jobs import job_log

    return job_log(table(spark, sf_dir, "events"))


@query(f"SELECT user_id AS job_id, arg_max({_STATUS}, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY user_id")
def job_current_state(spark, sf_dir):
    from pactlens.streaming.jobs import current_state

    return current_state(job_events(spark, sf_dir))


@query("WITH j AS (SELECT user_id AS job_id, max(ts) AS updated_at FROM events GROUP BY user_id) SELECT job_id FROM j WHERE updated_at < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def job_ttl(spark, sf_dir):
    from pactlens.streaming.jobs import current_state, expired

    return expired(current_state(job_events(spark, sf_dir))).select("job_id")


@query("WITH w AS (SELECT conv_id AS job_id, count(*) AS windows, count_if(turn % 2 = 0) AS done FROM conversations GROUP BY conv_id), s AS (SELECT *, windows * 2 * 90 / 12.0 AS s FROM w) SELECT job_id, greatest(1, floor(s / 60) + (CASE WHEN s % 60 > 0 THEN 1 ELSE 0 END) + 1)::BIGINT AS minutes, least(95, 55 + floor(40 * done / windows))::BIGINT AS progress FROM s")
def eta_estimate(spark, sf_dir):
    from pactlens.streaming.jobs import eta_minutes, progress

    per = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("job_id")).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("turn") % 2 == 0).alias("done"))
    return per.select("job_id", eta_minutes(F.col("windows"), 2).alias("minutes"), progress(F.col("done"), F.col("windows")).alias("progress"))


@query("WITH a AS (SELECT user_id, event_type AS category, lower(substr(props, 1, 100)) AS q, event_id % 2 AS attempt FROM events), n AS (SELECT user_id, attempt, count(*) AS n FROM a GROUP BY ALL), u AS (SELECT user_id, count(DISTINCT (category, q)) AS n FROM a GROUP BY ALL) SELECT u.user_id, max(n.n) AS best, u.n AS merged, u.n > max(n.n) AS take_union FROM u JOIN n USING (user_id) GROUP BY u.user_id, u.n")
def best_of_union(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("category"), F.lower(F.substring("props", 1, 100)).alias("q"), (F.col("event_id") % 2).alias("attempt"))
    best = tries.groupBy("user_id", "attempt").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("best"))
    merged = tries.dropDuplicates(["user_id", "category", "q"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("merged"))
    return best.join(merged, "user_id").withColumn("take_union", F.col("merged") > F.col("best"))


@query("WITH w AS (SELECT l_orderkey AS doc_id, l_returnflag AS page, l_linenumber, l_quantity AS top, l_linenumber * 10.0 AS x0, l_linenumber * 10.0 + l_tax AS x1, round_even(l_quantity / 2, 0) * 2 AS line_top FROM lineitem) SELECT doc_id, page, line_top, string_agg('w' || l_linenumber, ' ' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(top + 1) AS bottom FROM w GROUP BY doc_id, page, line_top")
def layout_lines(spark, sf_dir):
    n = F.col("l_linenumber")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("page"), F.concat(F.lit("w"), n.cast("string")).alias("text"), (n * 10.0).alias("x0"), (n * 10.0 + F.col("l_tax")).alias("x1"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 1).alias("bottom"))
    return segment.group_lines(words)


@query("SELECT item_id, doc_id, k FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)) WHERE k <= 2")
def fewshot_pick(spark, sf_dir):
    from pactlens.operators.fewshot import pick_examples

    return pick_examples(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"WITH {d.CONTRACTS} SELECT doc_id, CASE WHEN length(text) > 1200 THEN 'too long' WHEN {d.strip('text')} = '' THEN 'empty' END AS error FROM contracts")
def upload_check(spark, sf_dir):
    s = tx.strip(F.col("text"))
    return contracts(spark, sf_dir).select("doc_id", F.when(F.length("text") > 1200, "too long").when(s == "", "empty").alias("error"))


@query()
def wrap_lines(spark, sf_dir):
    from pactlens.operators.annotate import wrap

    return contract_lines(spark, sf_dir).select("doc_id", "idx", F.inline(wrap(F.col("text"), 60)))
