"""Queries on look-ups between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import joins


@query("recall", """
WITH m AS (SELECT DISTINCT user_id AS entity, event_id AS id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 50 AS DOUBLE) END AS age, ts FROM events WHERE event_type <> 'error'),
v AS (SELECT entity, id, ts, round(pow(0.5, coalesce(age, 0) / 14), 9) AS value FROM m)
SELECT entity, id, value, place, total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, ts DESC, id) AS place, count(*) OVER (PARTITION BY entity) AS total FROM v) WHERE place <= 20""")
def recalled(spark: SparkSession, d: str) -> DataFrame:
    e, i = read(spark, d, "events"), F.col("event_id")
    edges = e.select(i.alias("source"), F.col("user_id").alias("target"), F.when(F.col("event_type") == "error", "next").otherwise("mentions").alias("relation"))
    return joins.recall(edges, e.select(i.alias("id"), F.when(i % 9 != 0, (i % 50).cast("double")).alias("age_days"), F.col("ts").alias("fetched_at")))


@query("resolve_alias", r"""
WITH s AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'e' || doc_id % 20 ELSE '  Word ' || doc_id % 30 || ' X' END AS surface FROM documents), e AS (SELECT 'e' || p_partkey AS id, p_partkey AS seq, p_partkey % 25 AS a FROM part WHERE p_partkey < 100000000),
n AS (SELECT 'word ' || a || ' x' AS norm, arg_min(id, seq) AS id FROM e GROUP BY 1)
SELECT surface, coalesce(o.id, n.id) AS id FROM s LEFT JOIN e o ON o.id = surface LEFT JOIN n ON n.norm = regexp_replace(lower(trim(surface)), '\s+', ' ', 'g')""")
def aliases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = read(spark, d, "documents").select(F.when(i % 3 == 0, F.concat(F.lit("e"), (i % 20).cast("string"))).otherwise(F.concat(F.lit("  Word "), (i % 30).cast("string"), F.lit(" X"))).alias("surface"))
    e = read(spark, d, "part").select(F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq"), F.array(F.concat(F.lit("WORD  "), (F.col("p_partkey") % 25).cast("string"), F.lit(" x"))).alias("aliases"))
    return joins.resolve_alias(s, e)


@query("resolve_calls", """
WITH c AS (SELECT o_orderkey AS call_id, o_custkey % 7 AS file, 'f' || o_custkey % 60 AS name FROM orders), f AS (SELECT c_custkey AS id, 'f' || (c_custkey * 3) % 50 AS name, c_custkey % 7 AS file FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey < 20),
n AS (SELECT name, count(*) AS n, min(id) AS first FROM f GROUP BY 1), h AS (SELECT name, file, min(id) AS here FROM f GROUP BY ALL)
SELECT call_id, CASE WHEN n IS NULL THEN 'unresolved:' || c.name ELSE CAST(coalesce(here, first) AS VARCHAR) END AS target, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'exact' ELSE 'heuristic' END AS confidence FROM c LEFT JOIN n ON n.name = c.name LEFT JOIN h ON h.name = c.name AND h.file = c.file""")
def calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 7).alias("file"), F.concat(F.lit("f"), (F.col("o_custkey") % 60).cast("string")).alias("callee"))
    f = read(spark, d, "customer").filter((k % 5 != 0) | (k < 20)).select(k.cast("string").alias("id"), F.concat(F.lit("f"), ((k * 3) % 50).cast("string")).alias("name"), (k % 7).alias("file"), k.alias("seq"))
    return joins.resolve_calls(c, f)


@query("changed_files", "SELECT doc_id AS path, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 1")
def changed(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents some are not stored, others under another digest."""
    f = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return joins.changed_files(f, f.filter("path % 4 <> 0").withColumn("digest", F.when(F.col("path") % 6 == 1, "old").otherwise(F.col("digest"))))


@query("rank_answerable", """
WITH q AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey <> 3), b AS (SELECT o_custkey AS id, min((o_orderkey % 97) / 50.0) AS best FROM orders GROUP BY 1)
SELECT q.id AS question_id, CAST(best AS DOUBLE) AS best, CAST(round(greatest(0, least(1, 1 - best)), 6) AS DOUBLE) AS confidence FROM q JOIN b USING (id) WHERE best <= 1.2 AND q.id NOT IN (SELECT s_suppkey FROM supplier)""")
def answerable(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_nationkey").cast("string").alias("asked_by"))
    h = read(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), ((F.col("o_orderkey") % 97) / 50).alias("distance"))
    return joins.rank_answerable(q, h, read(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id")), "3", 1.2)


@query("orphan_report", "SELECT count(*) AS scanned, count(d.doc_id) AS resolved, count(*) - count(d.doc_id) AS orphans, round(count(d.doc_id) / CAST(count(*) AS DOUBLE), 6) AS rate FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphan_report(read(spark, d, "embeddings").select(F.col("vec_id").alias("id")), read(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("seed_corpus_check", """
WITH s AS (SELECT substr(text, 1, 12) AS label, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS body, CASE doc_id % 6 WHEN 0 THEN 'odd' WHEN 1 THEN 'concept' ELSE 'source' END AS kind, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE source END AS uri FROM documents),
p AS (SELECT 'label' AS problem FROM s WHERE trim(coalesce(label, '')) = '' UNION ALL SELECT 'body' FROM s WHERE trim(coalesce(body, '')) = '' UNION ALL SELECT 'kind' FROM s WHERE kind NOT IN ('concept', 'source', 'decision', 'synthesis') UNION ALL SELECT 'uri' FROM s WHERE uri IS NOT NULL AND trim(uri) = '' UNION ALL SELECT 'duplicate' FROM (SELECT kind, lower(label) FROM s GROUP BY ALL HAVING count(*) > 1))
SELECT problem, count(*) AS n FROM p GROUP BY 1""")
def seeds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = read(spark, d, "documents").select(F.substring("text", 1, 12).alias("label"), F.when(i % 10 == 0, " ").otherwise(F.col("text")).alias("body"), F.when(i % 6 == 0, "odd").when(i % 6 == 1, "concept").otherwise("source").alias("kind"), F.when(i % 7 == 0, "").when(i % 7 != 1, F.col("source")).alias("uri"))
    return joins.corpus_check(s, ["concept", "source", "decision", "synthesis"])
