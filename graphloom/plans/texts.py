"""Queries on text functions: terms, coverage, labels, risks, secrets, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.functions import text as T
from graphloom.operators import ingest
from graphloom.plans.retrieval import BM25, STOP, bench, bm25

QSTOP = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)
quoted = lambda p: "'" + p.replace("'", "''") + "'"
TERMS = f"""
raw_terms AS (SELECT item_id, list_concat(list_transform(regexp_extract_all(text, '"[^"]+"|''[^'']+'''), lambda t: lower(trim(regexp_replace(t, '[''"]', '', 'g')))), regexp_split_to_array(lower(text), '[^a-z0-9.+#-]+')) AS k FROM benchmark),
kept_terms AS (SELECT item_id, list_filter(k, lambda t: length(t) >= 3 AND t NOT IN ({QSTOP})) AS k FROM raw_terms),
terms AS (SELECT item_id, list_slice(list_filter(k, lambda x, i: list_position(k, x) = i), 1, 8) AS terms FROM kept_terms)
"""
PAIRS = f"""
WITH {BM25}, {TERMS},
p AS (SELECT h.query_id, h.doc_id, t.terms, lower(d.text) AS low, regexp_split_to_array(lower(d.text), '[^a-z0-9.+#-]+') AS toks FROM hits h JOIN terms t ON t.item_id = h.query_id JOIN documents d USING (doc_id))
"""


def hit_texts(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25(spark, d).select("query_id", "doc_id")
    q = bench(spark, d).select("query_id", F.col("text").alias("query"))
    return hits.join(q, "query_id").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("query_terms", f"WITH {TERMS} SELECT item_id, array_to_string(terms, ' ') AS terms FROM terms")
def terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("coverage_ratio", f"""{PAIRS}
SELECT query_id, doc_id, CASE WHEN len(terms) > 0 THEN round(len(list_filter(terms, lambda t: CASE WHEN contains(t, ' ') THEN contains(low, t) ELSE list_contains(toks, t) END)) / CAST(len(terms) AS DOUBLE), 6) END AS ratio FROM p""")
def ratio(spark: SparkSession, d: str) -> DataFrame:
    return hit_texts(spark, d).select("query_id", "doc_id", F.round(T.coverage_ratio(T.query_terms(F.col("query")), F.col("text")), 6).alias("ratio"))


@query("coverage_map", f"""{PAIRS},
x AS (SELECT query_id, doc_id, t, contains(low, t) AS hit FROM (SELECT query_id, doc_id, low, unnest(terms) AS t FROM p)),
per AS (SELECT query_id, t, count(*) FILTER (hit) AS n_evidence FROM x GROUP BY ALL)
SELECT item_id AS query_id, len(terms) AS n_terms, coalesce(n_covered, 0) AS n_covered, coalesce(missing, '') AS missing, CASE WHEN len(terms) = 0 THEN 1.0 ELSE round(coalesce(n_covered, 0) / CAST(len(terms) AS DOUBLE), 2) END AS coverage
FROM terms LEFT JOIN (SELECT query_id, count(*) FILTER (n_evidence > 0) AS n_covered, string_agg(CASE WHEN n_evidence = 0 THEN t END, ', ' ORDER BY t) AS missing FROM per GROUP BY 1) m ON m.query_id = item_id""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for each term of a query among its hits; one row for each query, what is missing by name."""
    x = hit_texts(spark, d).select("query_id", F.lower("text").alias("low"), F.explode(T.query_terms(F.col("query"))).alias("t"))
    per = x.groupBy("query_id", "t").agg(F.count_if(F.contains("low", "t")).alias("n"))
    m = per.groupBy("query_id").agg(F.count_if(F.col("n") > 0).alias("n_covered"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("t")))), ", ").alias("missing"))
    q = bench(spark, d).select("query_id", F.size(T.query_terms(F.col("text"))).alias("n_terms")).join(m, "query_id", "left").fillna(0, ["n_covered"]).fillna("", ["missing"])
    return q.withColumn("coverage", F.when(F.col("n_terms") == 0, 1.0).otherwise(F.round(F.col("n_covered") / F.col("n_terms"), 2)))


@query("enrich_text", r"""
SELECT doc_id, CASE WHEN source IS NULL AND lang IS NULL THEN coalesce(text, '') ELSE
  '[' || concat_ws('] [', 'session: ' || source, 'participants: ' || lang, 'tags: ' || source || ', ' || lang) || ']' || chr(10) || coalesce(text, '') END AS enriched FROM documents""")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents")
    tags = F.array_compact(F.array("source", F.upper("source"), F.concat(F.lit("  "), "lang"), F.lit(" ")))
    return x.select("doc_id", T.enrich_text(F.col("text"), F.lit(None).cast("string"), F.col("source"), F.array_compact(F.array("lang", "lang")), tags, F.array().cast("array<string>")).alias("enriched"))


SLUG = lambda s: f"regexp_replace(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slugs", f"""
WITH x AS (SELECT doc_id, substr(text, 1, 90) AS label FROM documents)
SELECT doc_id, regexp_replace(lower(trim(label)), '\\s+', ' ', 'g') AS alias, 'entity:concept:' || substr({SLUG("regexp_replace(lower(trim(label)), '\\s+', ' ', 'g')")}, 1, 64) AS entity,
  'source://2024-02-01/' || CASE WHEN {SLUG("label")} = '' THEN 'untitled' ELSE substr({SLUG("label")}, 1, 60) END AS note FROM x""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    label = F.substring("text", 1, 90)
    return read(spark, d, "documents").select("doc_id", T.normalise_alias(label).alias("alias"), T.entity_id(F.lit("concept"), label).alias("entity"), T.note_id(F.lit("source"), label, F.to_date(F.lit("2024-02-01"))).alias("note"))


@query("classify_risk", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, {quoted('(?i)' + T.HIGH_RISK)}) THEN 'high' WHEN regexp_matches(text, {quoted('(?i)' + T.ELEVATED_RISK)}) THEN 'elevated' ELSE 'low' END AS risk FROM documents""")
def risk(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.classify_risk(F.col("text")).alias("risk"))


@query("has_key_signal", f"SELECT doc_id, {' OR '.join(f'regexp_matches(text, {quoted(p)})' for p in T.KEY_SIGNALS)} AS signal FROM documents")
def signal(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.has_key_signal(F.lit(""), F.col("text")).alias("signal"))


@query("tier_for_uri", """
WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'session://' WHEN 1 THEN 'synthesis://' WHEN 2 THEN 'decision://' ELSE 'https://' END || source AS uri FROM documents)
SELECT doc_id, CASE WHEN starts_with(uri, 'session://') THEN 'episodic' WHEN starts_with(uri, 'synthesis://') THEN 'semantic' WHEN starts_with(uri, 'decision://') THEN 'procedural' ELSE 'observation' END AS tier FROM x""")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    scheme = F.element_at(F.array(*[F.lit(s) for s in ("session://", "synthesis://", "decision://", "https://")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", T.tier_for_uri(F.concat(scheme, "source")).alias("tier"))


URI_SQL = rf"""
WITH u AS (SELECT page_id, url AS uri FROM pages UNION ALL
  SELECT page_id, (CASE page_id % 8 WHEN 0 THEN 'http://10.0.0.' WHEN 1 THEN 'ftp://files.example/' WHEN 2 THEN 'https://172.20.1.' WHEN 3 THEN 'http://2130706433/' WHEN 4 THEN 'arxiv:' WHEN 5 THEN 'no address ' WHEN 6 THEN 'https://[fe80::1]/' ELSE 'https://100.100.0.' END) || page_id FROM pages),
s AS (SELECT page_id, uri, lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)), '^\[|\]$', '', 'g') AS h FROM u)
SELECT page_id, uri, CASE WHEN length(uri) > 2048 THEN 'too_long' WHEN regexp_matches(uri, {quoted('^(?:' + '|'.join(T.INTERNAL_PREFIXES) + ')')}) THEN 'ok' WHEN scheme = '' THEN 'malformed' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'malformed'
  WHEN contains(h, ':') AND regexp_matches(h, '^(::1?$|f[cd]|fe[89ab]|::ffff:)') THEN 'host'
  WHEN NOT contains(h, ':') AND (regexp_matches(h, '^([0-9]+|0x[0-9a-f]+)$') OR regexp_matches(h, '^(127\.|10\.|192\.168\.|169\.254\.|0\.|localhost|metadata\.)') OR regexp_matches(h, '^172\.(1[6-9]|2[0-9]|3[01])\.') OR regexp_matches(h, '^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.')) THEN 'host'
  ELSE 'ok' END AS verdict FROM s"""


@query("uri_verdict", URI_SQL)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The pages' addresses, and for each page one of eight odd kinds."""
    p = read(spark, d, "pages").select("page_id", F.col("url").alias("uri"))
    odd = F.element_at(F.array(*[F.lit(s) for s in ("http://10.0.0.", "ftp://files.example/", "https://172.20.1.", "http://2130706433/", "arxiv:", "no address ", "https://[fe80::1]/", "https://100.100.0.")]), (F.col("page_id") % 8 + 1).cast("int"))
    both = p.unionByName(p.select("page_id", F.concat(odd, F.col("page_id").cast("string")).alias("uri")))
    return both.withColumn("verdict", T.uri_verdict(F.col("uri")))


STRIP = lambda s: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({s}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g'))"


@query("page_items", rf"""
SELECT page_id, nullif({STRIP("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title, {STRIP("regexp_replace(html, '(?is)<(script|style|nav)\\b.*?</(script|style|nav)>', ' ', 'g')")} AS text FROM pages""")
def page_items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"), T.page_text(F.col("html")).alias("text"))


@query("session_labels", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[user] ' || substr(text, 1, 80) WHEN role = 'assistant' AND turn % 5 = 1 THEN '[tool:Edit] ' || substr('notes/' || conv_id, 1, 80) WHEN role = 'assistant' THEN '[assistant] ' || substr(text, 1, 80) ELSE '[session-start] ' || substr(text, 1, 80) END AS label FROM conversations""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    tool = F.when((F.col("role") == "assistant") & (F.col("turn") % 5 == 1), F.lit("Edit"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.session_label(F.col("role"), F.col("text"), tool, F.concat(F.lit("notes/"), F.col("conv_id").cast("string"))).alias("label"))


EXTRA = [("token-hex", r'token = "[0-9a-f]{40}"')]


@query("secret_matches", f"""
WITH x AS (SELECT doc_id, unnest([{', '.join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN '{n}' END" for n, p in [*T.SECRETS, *EXTRA])}]) AS pattern FROM documents)
SELECT doc_id, pattern FROM x WHERE pattern IS NOT NULL""")
def secrets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(T.secret_matches(F.col("text"), EXTRA)).alias("pattern"))


def _redacted() -> str:
    out = "text"
    for n, p in [*T.SECRETS, *EXTRA]:
        out = f"regexp_replace({out}, {quoted(p)}, '[REDACTED:{n}]', 'g')"
    return out


@query("redact", f"SELECT doc_id, sha256(t) AS digest, (length(t) - length(replace(t, '[REDACTED:', ''))) / 10 AS n FROM (SELECT doc_id, {_redacted()} AS t FROM documents)")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", T.redact(F.col("text"), EXTRA).alias("t"))
    return x.select("doc_id", F.sha2("t", 256).alias("digest"), F.regexp_count("t", F.lit(r"\[REDACTED:")).cast("double").alias("n"))


KEYS = lambda s: f"list_distinct(list_filter(regexp_split_to_array(lower({s}), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({STOP})))"


@query("answer_containment", f"""
WITH {BM25}, p AS (SELECT h.query_id, h.doc_id, {KEYS('b.text')} AS want, {KEYS('d.text')} AS have FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d USING (doc_id))
SELECT query_id, doc_id, CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, have)) / CAST(len(want) AS DOUBLE), 6) ELSE 0 END AS containment FROM p""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    return hit_texts(spark, d).select("query_id", "doc_id", F.round(T.answer_containment(F.col("text"), F.col("query")), 6).alias("containment"))


ANSWER = lambda s: f"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({s}), {quoted(chr(91) + '.,!?;:' + chr(39) + chr(34) + r'()\[\]{}\-_/\\|`~@#$%^&*+=<>]')}, ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


@query("squad_f1", f"""
WITH t AS (SELECT conv_id, turn, {ANSWER('text')} AS k FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.k AS x, b.k AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
cx AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(x) AS w FROM p) GROUP BY ALL), cy AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(y) AS w FROM p) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(cx.n, cy.n)) AS shared FROM cx JOIN cy USING (conv_id, turn, w) GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(2.0 * coalesce(shared, 0) / (len(x) + len(y)), 6) END AS f1, CASE WHEN x = y THEN 1 ELSE 0 END AS exact
FROM p LEFT JOIN o ON o.conv_id = p.conv_id AND o.turn = p.turn""")
def squad(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as the answer to the next one: F1 over shared tokens, and whether they are the same."""
    t = read(spark, d, "conversations").select("conv_id", "turn", T.answer_tokens(F.col("text")).alias("x"))
    p = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    count = lambda k, w: F.size(F.filter(F.col(k), lambda u: u == w))
    both = F.aggregate(F.array_distinct(F.array_intersect("x", "y")), F.lit(0), lambda a, w: a + F.least(count("x", w), count("y", w)))
    f1 = F.when((F.size("x") == 0) & (F.size("y") == 0), 1.0).when((F.size("x") == 0) | (F.size("y") == 0), 0.0).otherwise(F.round(2 * both / (F.size("x") + F.size("y")), 6))
    return p.select("conv_id", "turn", f1.alias("f1"), (F.col("x") == F.col("y")).cast("int").alias("exact"))


@query("age_in_days", "SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 86.4e9) AS age FROM events")
def ages(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return read(spark, d, "events").select("event_id", T.age_in_days(F.col("ts"), now).alias("age"))


@query("chunks")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_uri"), F.col("source").alias("title"), "text")
    return ingest.chunk_nodes(ingest.chunks(x))


@query("chunk_nodes", """
WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CASE WHEN n > 1 THEN conv_id || '#chunk-' || i ELSE CAST(conv_id AS VARCHAR) END AS id, CASE WHEN n > 1 THEN 'talk ' || conv_id || ' [chunk ' || (i + 1) || '/' || n || ']' ELSE 'talk ' || conv_id END AS label,
  conv_id AS source_uri, i AS chunk_index, substr(text, 1, 1500) AS summary FROM n""")
def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as its chunks: ids, labels and summaries."""
    w = Window.partitionBy("conv_id")
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("source_uri"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), (F.row_number().over(w.orderBy("turn")) - 1).alias("chunk_index"), F.count("*").over(w).alias("n_chunks"), "text")
    return ingest.chunk_nodes(c)


@query("source_run_report", r"""
WITH i AS (SELECT *, 'doc:' || doc_id AS uri, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents),
old AS (SELECT CASE WHEN doc_id % 3 = 0 THEN uri ELSE uri || '#chunk-0' END AS id, CASE WHEN doc_id % 5 = 0 THEN 'older' ELSE digest END AS digest FROM i WHERE doc_id % 2 = 0),
c AS (SELECT i.source, CASE WHEN coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') = '' OR coalesce(a.digest, b.digest) = i.digest THEN 'skipped' WHEN coalesce(a.digest, b.digest) IS NOT NULL THEN 'updated' ELSE 'new' END AS status FROM i LEFT JOIN old a ON a.id = uri LEFT JOIN old b ON b.id = uri || '#chunk-0')
SELECT source AS source_id, count(*) AS items_seen, count(*) FILTER (status = 'new') AS items_new, count(*) FILTER (status = 'updated') AS items_updated, count(*) FILTER (status = 'skipped') AS items_skipped FROM c GROUP BY 1""")
def report(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents known before, some under their first chunk, some changed since."""
    i = read(spark, d, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_uri"), "text", "doc_id")
    known = i.filter("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 3 == 0, F.col("source_uri")).otherwise(F.concat("source_uri", F.lit("#chunk-0"))).alias("id"), F.when(F.col("doc_id") % 5 == 0, "older").otherwise(T.content_sha256(F.col("text"))).alias("digest"))
    return ingest.run_report(ingest.classify(i.drop("doc_id"), known))
