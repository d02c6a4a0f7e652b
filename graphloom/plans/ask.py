"""Queries on the way from a question to a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.functions import text as T
from graphloom.operators import ask, retrieval

NOW = "2024-02-15 00:00:00"
STOPS = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS)


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


#: Parts name entities; every fourth question is an entity's name, another its id.
ALIASES = """
e AS (SELECT 'part-' || p_partkey AS id, p_partkey AS seq, [lower(p_name), ' ' || p_name || ' ', p_brand || ' ' || p_partkey, 'P' || p_partkey, '', 'kind ' || p_type] AS aliases FROM part),
q AS (SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name WHEN 1 THEN 'part-' || p_partkey WHEN 2 THEN 'p' || p_partkey || ' ' ELSE 'what is ' || p_name END AS text FROM part),
na AS (SELECT regexp_replace(lower(trim(a)), '\\s+', ' ', 'g') AS norm, arg_min(id, seq) AS id FROM (SELECT id, seq, unnest(aliases) AS a FROM e) GROUP BY 1),
nm AS (SELECT query_id, text, coalesce(o.id, na.id) AS id FROM q LEFT JOIN e o ON o.id = trim(q.text) LEFT JOIN na ON na.norm = regexp_replace(lower(trim(q.text)), '\\s+', ' ', 'g')),
al AS (SELECT query_id, text, a, i FROM (SELECT query_id, text, unnest(aliases) AS a, unnest(range(1, 7)) AS i FROM nm JOIN e USING (id)) WHERE trim(a) <> '' AND lower(trim(a)) <> lower(trim(text))),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(a)) ORDER BY i) AS r FROM al) WHERE r = 1)
"""


@query("alias_queries", f"WITH {ALIASES} SELECT query_id, 0 AS variant, text FROM q UNION ALL SELECT query_id, CAST(variant AS INTEGER), a FROM fi WHERE variant <= 3")
def aliases(spark: SparkSession, d: str) -> DataFrame:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    key = k.cast("string")
    e = p.select(F.concat(F.lit("part-"), key).alias("id"), k.alias("seq"), F.array(F.lower("p_name"), F.concat(F.lit(" "), "p_name", F.lit(" ")), F.concat("p_brand", F.lit(" "), key), F.concat(F.lit("P"), key), F.lit(""), F.concat(F.lit("kind "), "p_type")).alias("aliases"))
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), "p_name")).when(k % 4 == 1, F.concat(F.lit("part-"), key)).when(k % 4 == 2, F.concat(F.lit("p"), key, F.lit(" "))).otherwise(F.concat(F.lit("what is "), "p_name"))
    return ask.alias_queries(p.select(k.alias("query_id"), text.alias("text")), e)


@query("alias_search")
def searched(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages of which every second is a name with aliases, searched by BM25 in documents (test_ask.py holds it against single searches)."""
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    e = b.filter("query_id % 2 = 0").select(F.concat(F.lit("e"), F.col("query_id").cast("string")).alias("id"), F.col("query_id").alias("seq"), F.array("text", F.upper("text"), F.substring("text", 1, 60), F.substring("text", 30, 60)).alias("aliases"))

    def search(texts: DataFrame, n: int) -> DataFrame:
        found = retrieval.bm25_topk(texts, read(spark, d, "documents"), n)
        return found.select("query_id", F.col("doc_id").alias("id"), (F.col("rank") - 1).alias("rank"), (1 / (1 + F.col("score"))).alias("distance"))

    return ask.alias_search(b, e, search, 5)


@query("ask_hits", f"""
WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN 'doc ' || doc_id END AS label, CASE WHEN doc_id % 2 = 0 THEN 'uri:' || doc_id END AS source_uri, source AS source_file, left(text, 20) AS summary, lang AS workspace FROM documents),
t AS (SELECT event_id AS id, ts FROM events WHERE event_id % 5 > 0)
SELECT event_id // 7 AS query_id, event_id % 300 AS id, (event_id * 37 % 200) / CAST(100 AS DOUBLE) AS distance, coalesce(label, CAST(event_id % 300 AS VARCHAR)) AS label, coalesce(source_uri, source_file) AS source_uri, summary, workspace, t.ts AS fetched_at,
  round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(t.ts)) / 86.4e9, 2) AS age_days FROM events LEFT JOIN n ON n.id = event_id % 300 LEFT JOIN t ON t.id = n.id""")
def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits on documents, some unknown, unlabelled or undated."""
    i, e = F.col("event_id"), read(spark, d, "events")
    at = e.filter(i % 5 > 0).select(i.alias("doc_id"), F.col("ts").alias("fetched_at"))
    n = read(spark, d, "documents").join(at, "doc_id", "left")
    k = F.col("doc_id")
    n = n.select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("doc "), k.cast("string"))).alias("label"), F.when(k % 2 == 0, F.concat(F.lit("uri:"), k.cast("string"))).alias("source_uri"), F.col("source").alias("source_file"), F.substring("text", 1, 20).alias("summary"), F.col("lang").alias("workspace"), "fetched_at")
    return ask.ask_hits(e.select(F.floor(i / 7).alias("query_id"), (i % 300).alias("id"), ((i * 37 % 200) / 100).alias("distance")), n, now())


@query("expand_resolved", """
WITH h AS (SELECT event_id // 7 AS query_id, event_id % 90 AS id, (event_id * 37 % 200) / CAST(100 AS DOUBLE) AS distance FROM events),
r AS (SELECT * FROM (SELECT i AS id, CASE WHEN i % 4 > 0 THEN [i * 5 % 300, i * 11 % 300, -1] ELSE CAST([] AS BIGINT[]) END AS docs FROM range(0, 90) t(i)) WHERE id % 3 = 0),
x AS (SELECT query_id, id, distance FROM h WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT query_id, doc, distance FROM (SELECT query_id, unnest(docs) AS doc, distance FROM h JOIN r USING (id)) WHERE doc IN (SELECT doc_id FROM documents)),
b AS (SELECT query_id, id, min(distance) AS distance FROM x GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM b""")
def expanded(spark: SparkSession, d: str) -> DataFrame:
    i, e, k = F.col("event_id"), read(spark, d, "events"), F.col("id")
    r = spark.range(90).filter("id % 3 = 0").select("id", F.when(k % 4 > 0, F.array(k * 5 % 300, k * 11 % 300, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")).alias("answer_docs"))
    h = e.select(F.floor(i / 7).alias("query_id"), (i % 90).alias("id"), ((i * 37 % 200) / 100).alias("distance"))
    return ask.expand_resolved(h, r, read(spark, d, "documents").select(F.col("doc_id").alias("id")))


#: Eight events are a query's results; of some queries nothing is remote, some have no results.
RESULTS = """
m AS (SELECT event_id // 8 AS query_id, event_id % 8 AS position, (event_id * 37 % 200) / CAST(100 AS DOUBLE) AS distance, CASE WHEN event_id % 5 = 0 THEN (event_id * 53 % 150) / CAST(100 AS DOUBLE) END AS vec,
  CASE WHEN event_id // 8 % 4 > 0 AND event_id % 3 > 0 THEN CASE WHEN event_id // 8 % 4 = 1 THEN 'p0' ELSE 'p' || user_id % 4 END END AS peer, CASE WHEN event_id // 8 % 4 = 2 AND event_id % 7 = 0 THEN ['p' || event_id % 5, 'local'] ELSE CAST([] AS VARCHAR[]) END AS also,
  CASE WHEN event_id % 6 > 0 THEN 'u' || user_id END AS uri, CASE WHEN event_id % 9 > 0 THEN ts END AS at_, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 30 AS DOUBLE) END AS age, CASE WHEN event_id % 4 = 0 THEN CAST(14 AS DOUBLE) ELSE CAST(7 AS DOUBLE) END AS lim,
  CASE WHEN event_id % 5 = 1 THEN false WHEN event_id % 5 > 2 THEN true END AS sig FROM events)
"""
#: One statement a component, as in the description of the score.
SATISFACTION = """
o AS (SELECT query_id, count(DISTINCT x) AS origins FROM (SELECT query_id, coalesce(peer, 'local') AS x FROM m UNION ALL SELECT query_id, unnest(also) FROM m) GROUP BY 1),
z AS (SELECT *, coalesce(vec, distance) AS d FROM m),
rt AS (SELECT query_id, avg(least(1, greatest(0, 1 - d))) AS retrieval FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS k FROM z WHERE d > 0) WHERE k <= 3 GROUP BY 1),
a AS (SELECT query_id, count(*) AS n, arg_min(distance, position) AS top, min(d) FILTER (d > 0) AS best, count(*) FILTER (age <= lim) AS fresh, count(*) FILTER (age > lim) AS stale, count(age) AS aged, min(age) AS youngest, count(*) FILTER (uri IS NOT NULL AND at_ IS NOT NULL) AS sourced,
  count(sig) AS signable, count(*) FILTER (sig) AS signed, count(*) FILTER (NOT sig) AS unsigned, bool_or(peer IS NOT NULL OR len(list_filter(also, lambda p: p <> 'local')) > 0) AS remote FROM z GROUP BY 1),
c AS (SELECT q.query_id, q.coverage, coalesce(n, 0) AS n, top, best, coalesce(fresh, 0) AS fresh, coalesce(stale, 0) AS stale, youngest, coalesce(sourced, 0) AS sourced, coalesce(unsigned, 0) AS unsigned, coalesce(origins, 0) AS origins, coalesce(remote, false) AS remote, retrieval,
  CASE WHEN aged > 0 THEN fresh / CAST(aged AS DOUBLE) END AS freshness, CASE WHEN n > 0 THEN sourced / CAST(n AS DOUBLE) END AS provenance, CASE WHEN n > 0 THEN CASE WHEN remote AND origins < 2 THEN 0.5 ELSE 1.0 END END AS consensus, CASE WHEN signable > 0 THEN signed / CAST(signable AS DOUBLE) END AS signature
  FROM qs q LEFT JOIN a USING (query_id) LEFT JOIN o USING (query_id) LEFT JOIN rt USING (query_id)),
p AS (SELECT *, CAST(provenance IS NOT NULL AS INTEGER) + CAST(consensus IS NOT NULL AS INTEGER) + CAST(signature IS NOT NULL AS INTEGER) AS k, n - sourced > n / CAST(2 AS DOUBLE) AS p1, n > 0 AND origins = 1 AND remote AS p2, n > 0 AND coalesce(top > 1.5, false) AS p3, stale > fresh AS p4, CAST(least(1, greatest(0, (1.2 - best) / CAST(0.7 AS DOUBLE))) AS DOUBLE) AS near FROM c),
g AS (SELECT *, CASE WHEN k > 0 THEN (coalesce(provenance, 0) + coalesce(consensus, 0) + coalesce(signature, 0)) / CAST(k AS DOUBLE) ELSE 0 END - least(0.4, CASE WHEN p1 THEN 0.15 ELSE 0 END + CASE WHEN p2 THEN 0.15 ELSE 0 END + CASE WHEN p3 THEN 0.2 ELSE 0 END + CASE WHEN p4 THEN 0.1 ELSE 0 END) AS kept,
  CASE WHEN best IS NOT NULL AND coverage IS NOT NULL THEN 0.6 * coverage + 0.4 * near WHEN best IS NOT NULL THEN near ELSE coverage END AS rel FROM p),
s AS (SELECT *, least(1, greatest(0, kept * coalesce(0.3 + 0.7 * rel, 1) * coalesce(0.3 + 0.7 * pow(0.5, youngest / 7), 1))) AS raw FROM g)
"""
CENTS = lambda c: f"floor({c} * 100 + 0.5) / 100"


def results(spark: SparkSession, d: str) -> DataFrame:
    e, i = read(spark, d, "events"), F.col("event_id")
    k, p = F.floor(i / 8), lambda c: F.concat(F.lit("p"), c.cast("string"))
    return e.select(
        k.alias("query_id"), (i % 8).alias("position"), ((i * 37 % 200) / 100).alias("distance"), F.when(i % 5 == 0, (i * 53 % 150) / 100).alias("vec_distance"),
        F.when((k % 4 > 0) & (i % 3 > 0), F.when(k % 4 == 1, "p0").otherwise(p(F.col("user_id") % 4))).alias("source_peer"), F.when((k % 4 == 2) & (i % 7 == 0), F.array(p(i % 5), F.lit("local"))).alias("also_from_peers"),
        F.when(i % 6 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("source_uri"), F.when(i % 9 > 0, F.col("ts")).alias("fetched_at"), F.when(i % 11 > 0, (i % 30).cast("double")).alias("age_days"), F.when(i % 4 == 0, 14.0).alias("stale_after_days"),
        F.when(i % 5 == 1, False).when(i % 5 > 2, True).alias("has_signature"),
    )


@query("satisfaction", f"""
WITH {RESULTS}, qs AS (SELECT query_id, CASE WHEN query_id % 3 > 0 THEN query_id % 10 / CAST(10 AS DOUBLE) END AS coverage FROM (SELECT DISTINCT query_id FROM m UNION ALL SELECT DISTINCT query_id + 1000000 FROM m WHERE query_id % 10 = 0)), {SATISFACTION}
SELECT query_id, {CENTS('raw')} AS score, n, fresh AS fresh_count, stale AS stale_count, unsigned AS unsigned_count, n - sourced AS missing_provenance, CAST(origins AS INTEGER) AS distinct_origins,
  concat_ws(',', CASE WHEN n > 0 AND top < 0.3 THEN 'close_top' END, CASE WHEN fresh > 0 THEN 'fresh' END, CASE WHEN origins >= 2 THEN 'origins' END, CASE WHEN provenance >= 0.8 THEN 'sourced' END) AS reasons,
  concat_ws(',', CASE WHEN p1 THEN 'unsourced' END, CASE WHEN p2 THEN 'one_remote_origin' END, CASE WHEN p3 THEN 'far_top' END, CASE WHEN p4 THEN 'stale' END) AS penalties,
  {CENTS('retrieval')} AS retrieval, {CENTS('freshness')} AS freshness, {CENTS('provenance')} AS provenance, {CENTS('consensus')} AS consensus, {CENTS('signature')} AS signature, CASE WHEN k > 0 THEN {CENTS('1 / CAST(k AS DOUBLE)')} END AS trust_weight,
  CAST(k + CAST(retrieval IS NOT NULL AS INTEGER) + CAST(freshness IS NOT NULL AS INTEGER) AS INTEGER) AS observed FROM s""")
def satisfied(spark: SparkSession, d: str) -> DataFrame:
    r, k = results(spark, d), F.col("query_id")
    q = r.select(k).distinct().unionByName(r.filter(k % 10 == 0).select((k + 1_000_000).alias("query_id")).distinct())
    out = ask.satisfaction(q.withColumn("coverage", F.when(k % 3 > 0, k % 10 / 10)), r)
    return out.withColumns({c: F.array_join(c, ",") for c in ("reasons", "penalties")})


@query("pull_telemetry", f"""
WITH {RESULTS.replace("m AS (", "m0 AS (")}, n AS (SELECT doc_id AS id, 'doc ' || doc_id || ' tion' AS label, CASE WHEN doc_id % 2 = 0 THEN 'uri:' || doc_id ELSE source END AS uri, source AS body, CASE WHEN doc_id % 3 > 0 THEN TIMESTAMP '2024-02-10' END AS at_ FROM documents),
mm AS (SELECT m0.* EXCLUDE (vec, uri, at_, age, lim), CAST(NULL AS DOUBLE) AS vec, coalesce(n.uri, m0.uri) AS uri, coalesce(n.at_, m0.at_) AS at_, CAST(14 AS DOUBLE) AS lim, coalesce(n.label, '') || ' ' || coalesce(n.body, '') AS said FROM m0 LEFT JOIN n ON n.id = (query_id * 8 + position) % 300),
m AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(at_)) / 86.4e9) AS age FROM mm),
tx AS (SELECT i.query_id, b.text FROM (SELECT DISTINCT query_id FROM m) i JOIN benchmark b ON b.item_id = i.query_id % 40), qs AS (SELECT query_id, CAST(NULL AS DOUBLE) AS coverage FROM tx), {SATISFACTION},
dc AS (SELECT s.query_id, n, {CENTS('raw')} AS score, k + CAST(retrieval IS NOT NULL AS INTEGER) + CAST(freshness IS NOT NULL AS INTEGER) AS seen, text, CASE WHEN regexp_matches(text, '(?i){T.HIGH_RISK}') THEN 'high' WHEN regexp_matches(text, '(?i){T.ELEVATED_RISK}') THEN 'elevated' ELSE 'low' END AS risk FROM s JOIN tx USING (query_id)),
b1 AS (SELECT *, CASE WHEN score >= 0.85 AND seen >= 4 THEN 'use_memory' WHEN score >= 0.65 THEN 'verify_one_source' WHEN score >= 0.4 THEN 'search' ELSE 'ask_user' END AS b FROM dc),
b2 AS (SELECT *, CASE WHEN risk = 'elevated' AND b = 'use_memory' THEN 'verify_one_source' WHEN risk = 'high' AND b IN ('use_memory', 'verify_one_source') THEN 'search' ELSE b END AS decision FROM b1),
us AS (SELECT query_id, count(DISTINCT uri) AS distinct_sources FROM m GROUP BY 1),
te AS (SELECT query_id, list_slice(list_filter(words, lambda t: length(t) >= 3 AND t NOT IN ({STOPS})), 1, 8) AS terms FROM (SELECT query_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT query_id, list_concat(list_transform(regexp_extract_all(text, '"[^"]+"|''[^'']+'''), lambda t: lower(trim(regexp_replace(t, '[''"]', '', 'g')))), regexp_split_to_array(lower(text), '[^a-z0-9.+#-]+')) AS w FROM tx))),
gp AS (SELECT query_id, t, bool_or(contains(lower(said), t)) AS hit FROM (SELECT b2.query_id, unnest(terms) AS t FROM b2 JOIN te USING (query_id) WHERE decision IN ('verify_one_source', 'search')) JOIN m USING (query_id) GROUP BY ALL)
SELECT b2.query_id, n AS result_count, coalesce(distinct_sources, 0) AS distinct_sources, score, decision, g.missing_terms FROM b2 LEFT JOIN us USING (query_id) LEFT JOIN (SELECT query_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (NOT hit), '') AS missing_terms FROM gp GROUP BY 1) g USING (query_id)""")
def pulled(spark: SparkSession, d: str) -> DataFrame:
    r, k = results(spark, d), F.col("query_id")
    doc = F.col("doc_id")
    n = read(spark, d, "documents").select(doc.alias("id"), F.concat(F.lit("doc "), doc.cast("string"), F.lit(" tion")).alias("label"), F.when(doc % 2 == 0, F.concat(F.lit("uri:"), doc.cast("string"))).alias("source_uri"), F.col("source").alias("source_file"), F.when(doc % 3 > 0, F.lit("2024-02-10 00:00:00").cast("timestamp")).alias("fetched_at"))
    m = r.select("query_id", "position", ((k * 8 + F.col("position")) % 300).alias("id"), "distance", "source_peer", "also_from_peers", "source_uri", "fetched_at", F.col("has_signature").alias("sig_valid"))
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("on"), "text")
    q = r.select("query_id").distinct().withColumn("on", k % 40).join(b, "on").select("query_id", "text")
    return ask.pull_telemetry(q, m, n, now()).withColumn("missing_terms", F.array_join("missing_terms", ","))
