"""Queries on memory upkeep and answer decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.functions.text import has_key_signal
from graphloom.operators import evaluation, memory
from graphloom.operators.clusters import subject_clusters
from graphloom.plans.retrieval import DENSE, dense

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def now() -> F.Column:
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


CONTRACT = "CASE WHEN score >= 0.85 AND n >= 4 THEN 'use_memory' WHEN score >= 0.65 THEN 'verify_one_source' WHEN score >= 0.4 THEN 'search' ELSE 'ask_user' END"
EVENTS = f"""e AS (SELECT event_id, value / 100 AS score, CAST(event_id % 6 AS INTEGER) AS n, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'elevated' ELSE 'low' END AS risk, event_type, ts, user_id FROM events),
c AS (SELECT *, {CONTRACT} AS base FROM e),
d AS (SELECT *, CASE WHEN risk = 'elevated' AND base = 'use_memory' THEN 'verify_one_source' WHEN risk = 'high' AND base IN ('use_memory', 'verify_one_source') THEN 'search' ELSE base END AS decision FROM c)"""


def decided(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    risk = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "click", "elevated").otherwise("low")
    x = e.select("event_id", (F.col("value") / 100).alias("score"), (F.col("event_id") % 6).cast("int").alias("n"), risk.alias("risk"), "event_type", "ts", "user_id")
    return x.withColumn("decision", memory.decide_contract(F.col("score"), F.col("risk"), F.col("n")))


@query("decide_contract", f"WITH {EVENTS} SELECT event_id, decision FROM d")
def contract(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).select("event_id", "decision")


@query("reweight_score", """
WITH p AS (SELECT event_id, value / 100 AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS b, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 0.5 END AS c FROM events)
SELECT event_id, round((0.47 * a + coalesce(0.31 * b, 0) + coalesce(0.22 * c, 0)) / (0.47 + CASE WHEN b IS NULL THEN 0 ELSE 0.31 END + CASE WHEN c IS NULL THEN 0 ELSE 0.22 END), 6) AS score FROM p""")
def reweighted(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    parts = {"a": F.col("value") / 100, "b": F.when(i % 3 != 0, (i % 10) / 10), "c": F.when(i % 2 != 0, 0.5)}
    return read(spark, d, "events").select("event_id", F.round(memory.reweight(parts, {"a": 0.47, "b": 0.31, "c": 0.22}), 6).alias("score"))


RECEIPTS = f"""{EVENTS}, r AS (SELECT *, event_id % 4 = 0 AS would, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 5) / 4.0 END AS coverage, CASE event_id % 3 WHEN 0 THEN 'helped' WHEN 1 THEN 'useless' END AS signal FROM d),
j AS (SELECT *, CASE WHEN decision = 'use_memory' AND coverage = 1 THEN 'good_skip' WHEN would AND signal = 'helped' THEN 'bad_skip' WHEN would AND signal = 'useless' THEN 'good_search' END AS outcome FROM r)"""


def receipts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x = decided(spark, d).withColumn("would_search", i % 4 == 0).withColumn("coverage", F.when(i % 5 != 0, (i % 5) / 4)).withColumn("signal", F.when(i % 3 == 0, "helped").when(i % 3 == 1, "useless"))
    return x.withColumn("outcome", memory.judge_receipt(F.col("decision"), F.coalesce(F.col("coverage") == 1, F.lit(False)), F.col("would_search"), F.col("signal"), F.lit(None).cast("string")))


@query("judge_receipt", f"WITH {RECEIPTS} SELECT event_id, outcome FROM j")
def judged(spark: SparkSession, d: str) -> DataFrame:
    return receipts(spark, d).select("event_id", "outcome")


@query("shadow_summary", f"""
WITH {RECEIPTS} SELECT count(*) AS total, count(*) FILTER (decision = 'use_memory') AS used, count(*) FILTER (decision = 'verify_one_source') AS verified, count(*) FILTER (decision = 'search') AS searched, count(*) FILTER (decision = 'ask_user') AS asked,
  round(count(*) FILTER (decision = 'use_memory') / CAST(count(*) AS DOUBLE), 3) AS skip_rate, round(count(*) FILTER (would) / CAST(count(*) AS DOUBLE), 3) AS shadow_rate, round(avg(coverage), 3) AS mean_coverage, round(count(*) FILTER (outcome = 'bad_skip') / CAST(count(outcome) AS DOUBLE), 3) AS bad_skip_rate FROM j""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return memory.receipt_summary(receipts(spark, d))


GRID = "(SELECT CAST(unnest([0.6, 0.75, 0.9]) AS DOUBLE) AS threshold), (SELECT unnest([1, 3]) AS min_hits)"


@query("deny_sweep", f"""
WITH {EVENTS}, p AS (SELECT decision, score, n AS n_hits, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS in_corpus FROM d),
g AS (SELECT threshold, min_hits, count(*) FILTER (decision = 'use_memory' AND score >= threshold AND n_hits >= min_hits AND in_corpus = 1) AS true_deny, count(*) FILTER (decision = 'use_memory' AND score >= threshold AND n_hits >= min_hits AND in_corpus = 0) AS false_deny, count(*) FILTER (in_corpus = 1) AS ni, count(*) FILTER (in_corpus = 0) AS no FROM p, {GRID} GROUP BY ALL)
SELECT threshold, min_hits, true_deny, false_deny, round(true_deny / CAST(ni AS DOUBLE), 6) AS true_rate, round(false_deny / CAST(no AS DOUBLE), 6) AS false_rate,
  row_number() OVER (ORDER BY false_deny = 0 DESC, true_deny DESC, min_hits DESC, threshold DESC) = 1 AS picked FROM g""")
def denials(spark: SparkSession, d: str) -> DataFrame:
    p = decided(spark, d).select("decision", "score", F.col("n").alias("n_hits"), (F.col("user_id") % 2 == 0).cast("int").alias("in_corpus"))
    return evaluation.deny_sweep(p, [0.6, 0.75, 0.9], [1, 3])


@query("operating_points", """
WITH x AS (SELECT value / 100 AS score, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS right_, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS direct FROM events),
g AS (SELECT threshold, round(avg(CASE WHEN score >= threshold THEN right_ ELSE direct END), 6) AS recall, round(avg(CASE WHEN score >= threshold AND right_ = 0 THEN 1 ELSE 0 END), 6) AS false_rate FROM x, (SELECT CAST(unnest([0.5, 1.0, 2.0, 4.0]) AS DOUBLE) AS threshold) GROUP BY 1)
SELECT *, coalesce((recall, threshold) = (SELECT max((recall, threshold)) FROM g WHERE false_rate <= 0.05), false) AS picked FROM g""")
def points(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "events").select((F.col("value") / 100).alias("score"), (F.col("event_type") != "error").cast("int").alias("right"), (F.col("event_id") % 3 == 0).cast("int").alias("direct"))
    return evaluation.operating_points(x, [0.5, 1.0, 2.0, 4.0], 0.05)


@query("quantiles", """
WITH v AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT q, 'floor_n' AS rule, x AS value FROM v, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q) WHERE i = least(n - 1, floor(q * n)) UNION ALL SELECT q, 'floor_n1', x FROM v, (SELECT CAST(unnest([0.5, 0.95, 0.99]) AS DOUBLE) AS q) WHERE i = floor(q * (n - 1))""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "events").select(F.col("value").alias("x"))
    one = lambda r: evaluation.quantiles(v, [0.5, 0.95, 0.99], r).select("q", F.lit(r).alias("rule"), "value")
    return one("floor_n").union(one("floor_n1"))


@query("classification_report", """
WITH j AS (SELECT event_type AS a, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS p FROM events),
c AS (SELECT k AS class, count(*) FILTER (a = k AND p = k) AS tp, count(*) FILTER (a = k) AS n_a, count(*) FILTER (p = k) AS n_p FROM j, (SELECT DISTINCT event_type AS k FROM events) GROUP BY 1),
r AS (SELECT class, CASE WHEN n_p = 0 THEN 0 ELSE tp / CAST(n_p AS DOUBLE) END AS p, CASE WHEN n_a = 0 THEN 0 ELSE tp / CAST(n_a AS DOUBLE) END AS r FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""")
def classes(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 4 == 0, "view").otherwise(F.col("event_type"))
    return evaluation.classification_report(read(spark, d, "events").select(F.col("event_type").alias("actual"), said.alias("predicted")))


@query("ood_signals", f"""
WITH {DENSE}, s AS (SELECT query_id, 1 - distance * distance / 2 AS sim FROM dense WHERE query_id <> vec_id), g AS (SELECT query_id, list_sort(list(sim), 'DESC') AS l, sum(exp((sim - 1) / 0.1)) AS z FROM s GROUP BY 1)
SELECT query_id, round(1 + 0.1 * ln(z), 6) AS energy, round(l[1], 6) AS top, round(l[1] - l[2], 6) AS gap, round(l[1] - list_avg(l[2:]), 6) AS over_rest, round(l[1] - l[-1], 6) AS range,
  round(list_sum(list_transform(l, lambda x: exp((x - 1) / 0.1) / z * ln(exp((x - 1) / 0.1) / z))), 6) AS sharpness FROM g""")
def ood(spark: SparkSession, d: str) -> DataFrame:
    return memory.ood_signals(dense(spark, d).filter("query_id <> vec_id").select("query_id", (1 - F.col("distance") * F.col("distance") / 2).alias("sim")))


TOKENS = lambda s: f"list_distinct(list_filter(regexp_split_to_array(lower({s}), '[^a-z0-9_]+'), lambda t: length(t) > 2))"
GATE = f"""k AS (SELECT doc_id, text, {TOKENS('text')} AS t FROM documents),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE) AS j FROM k a JOIN k b ON a.doc_id <> b.doc_id AND len(a.t) > 0 AND least(len(a.t), len(b.t)) >= 0.9 * greatest(len(a.t), len(b.t)) WHERE round(len(list_intersect(a.t, b.t)) / CAST(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS DOUBLE), 6) >= 0.9)"""


@query("write_gate", f"""
WITH {GATE}, f AS (SELECT a, min(b) AS against FROM near WHERE b % 5 <> 0 GROUP BY 1),
x AS (SELECT d.doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 5 END AS importance, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS concepts, coalesce(text, '') AS body, CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS uri, against FROM documents d LEFT JOIN f ON f.a = d.doc_id),
v AS (SELECT *, CASE WHEN importance <= 2 THEN 'importance' WHEN concepts < 1 THEN 'concepts' WHEN length(body) < 16 THEN 'body' WHEN coalesce(uri, '') = '' THEN 'schema_no_source' WHEN against IS NOT NULL THEN 'contradiction' ELSE 'promote' END AS verdict FROM x)
SELECT id, verdict, CASE WHEN verdict = 'contradiction' THEN against END AS against FROM v""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a candidate against all others that are strong."""
    x, i = read(spark, d, "documents"), F.col("doc_id")
    c = x.select(i.alias("id"), F.when(i % 13 == 0, "").otherwise(F.col("source")).alias("uri"), F.col("text").alias("body"), F.when(i % 10 == 0, 2).otherwise(5).alias("importance"), F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("concepts"))
    return memory.write_gate(c, x.select(i.alias("id"), "text", F.when(i % 5 == 0, 0.5).otherwise(0.9).alias("strength"), i.alias("seq")))


@query("contradictions", f"""
WITH {GATE}, n AS (SELECT doc_id, doc_id % 3 AS c FROM documents)
SELECT CASE WHEN (a * 7) % 101 <= (b * 7) % 101 THEN b ELSE a END AS kept, CASE WHEN (a * 7) % 101 <= (b * 7) % 101 THEN a ELSE b END AS demoted FROM near WHERE a < b AND a % 3 <> b % 3""")
def contradicting(spark: SparkSession, d: str) -> DataFrame:
    """Each document has the concept 'all' and one of three of its own."""
    i = F.col("doc_id")
    return memory.contradictions(read(spark, d, "documents").select(i.alias("id"), "text", F.array(F.lit("all"), (i % 3).cast("string")).alias("concepts"), ((i * 7) % 101).alias("at")))


PLAN = f"""f AS (SELECT event_id AS id, event_type AS tier, CASE WHEN event_id % 23 > 0 THEN event_id % 17 <> 0 END AS is_latest, CASE WHEN event_id % 19 = 0 THEN ts + INTERVAL 10 DAY END AS forget_after, ts - INTERVAL 1 DAY * (event_id % 400) AS since, event_id % 4 AS accesses FROM events),
g AS (SELECT *, greatest(0, (epoch_us({NOW}) - epoch_us(since)) / 86.4e9) AS age FROM f),
plan AS (SELECT id, CASE WHEN coalesce(forget_after <= {NOW}, false) THEN 'delete' WHEN age >= 30 AND least(1, 0.5 + least(0.2, 0.02 * accesses)) * exp(-0.01 * age) < 0.15 THEN 'demote' ELSE 'keep' END AS action FROM g WHERE tier <> 'view' AND coalesce(is_latest, true))"""


def memories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - 86_400_000_000 * (i % 400))
    tier = F.when(F.col("event_type") == "view", "observation").otherwise(F.col("event_type"))
    return read(spark, d, "events").select(i.alias("id"), tier.alias("tier"), F.when(i % 23 > 0, i % 17 != 0).alias("is_latest"), F.when(i % 19 == 0, F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + 864_000_000_000)).alias("forget_after"), at.alias("at"), (i % 4).alias("accesses"))


@query("forget_plan", f"WITH {PLAN} SELECT id, action, CASE action WHEN 'delete' THEN 'ttl_expired' WHEN 'demote' THEN 'retention_frozen' END AS reason FROM plan")
def plan(spark: SparkSession, d: str) -> DataFrame:
    """Some rows do not say whether they are the latest: these are live."""
    return memory.forget_plan(memories(spark, d), now()).drop("against")


@query("forget_stats", f"WITH {PLAN} SELECT (SELECT count(*) FROM f) AS inspected, count(*) AS tiered, count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (action = 'demote') AS demotes, CAST(0 AS BIGINT) AS contradictions FROM plan")
def stats(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return memory.forget_stats(m, memory.forget_plan(m, now()))


@query("apply_forget_plan", f"WITH {PLAN} SELECT f.id, CASE WHEN action = 'demote' THEN false ELSE is_latest END AS is_latest FROM f LEFT JOIN plan USING (id) WHERE action IS DISTINCT FROM 'delete'")
def applied(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    return memory.apply_forget_plan(m, memory.forget_plan(m, now())).select("id", "is_latest")


@query("session_retention", r"""
SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 7 <> 0 AND NOT (regexp_matches(text, '\[BLOCKED:') OR regexp_matches(text, 'https?://api\.') OR regexp_matches(text, '(?i)\bcommit\s+[0-9a-f]{7,40}\b') OR regexp_matches(text, '\b[0-9a-f]{7,40}\b')))""")
def retained(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = read(spark, d, "documents").withColumn("source_uri", F.when(i % 2 == 0, "session://x").otherwise("https://x")).withColumn("fetched_at", F.when(i % 7 == 0, now()).otherwise(F.to_timestamp(F.lit("2023-01-01 00:00:00"))))
    return memory.session_retention(n, has_key_signal(F.lit(""), F.col("text")), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).select("doc_id")


@query("greedy_clusters")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("label").alias("workspace"), F.col("vec_id").alias("id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    return memory.greedy_clusters(e, 0.3, 3, 5)


@query("subject_clusters")
def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as queries of three workspaces at cosine 0.4 (test_clusters.py holds the rounds against the sequential loop)."""
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("workspace"), F.col("vec_id").alias("id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    return subject_clusters(e, 0.4)


#: Vectors are nodes of the documents of their number; some are consolidated, some are memories.
GATHERED = """n AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 > 0 THEN lang END AS workspace, CASE WHEN doc_id % 7 = 0 THEN 'consolidated_memory' WHEN doc_id % 3 = 0 THEN 'note' END AS kind, CASE WHEN doc_id % 5 = 0 THEN '2024-01-01' WHEN doc_id % 5 = 1 THEN '' END AS consolidated_at, CASE WHEN doc_id % 4 = 0 THEN '2024-01-02' END AS t1, CASE WHEN doc_id % 2 = 0 THEN '2024-01-03' END AS t2 FROM documents)"""


def gathered(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, d, "documents").select(
        i.alias("id"), F.when(i % 9 > 0, F.col("lang")).alias("workspace"), F.when(i % 7 == 0, "consolidated_memory").when(i % 3 == 0, "note").alias("kind"), F.when(i % 5 == 0, "2024-01-01").when(i % 5 == 1, "").alias("consolidated_at"),
        F.when(i % 4 == 0, "2024-01-02").alias("timestamp"), F.when(i % 2 == 0, "2024-01-03").alias("fetched_at"),
    )


@query("consolidation_candidates", f"WITH {GATHERED} SELECT workspace, id, coalesce(t1, t2, '1970-01-01T00:00:00Z') AS at FROM n JOIN embeddings ON vec_id = id WHERE coalesce(consolidated_at, '') = '' AND coalesce(kind, '') <> 'consolidated_memory'")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return memory.consolidation_candidates(gathered(spark, d), read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).drop("vector")


@query("consolidation_status", f"""WITH {GATHERED}, m AS (SELECT *, coalesce(kind, '') = 'consolidated_memory' AS mem, coalesce(consolidated_at, '') <> '' AS done FROM n)
SELECT coalesce(workspace, '(no workspace)') AS workspace, count(*) FILTER (NOT mem AND NOT done) AS raw, count(*) FILTER (NOT mem AND done) AS consolidated_raw, count(*) FILTER (mem) AS consolidated_memories FROM m GROUP BY 1""")
def status(spark: SparkSession, d: str) -> DataFrame:
    return memory.consolidation_status(gathered(spark, d))


@query("consolidation_prune", f"""WITH {GATHERED}, gone AS (SELECT id FROM n WHERE coalesce(consolidated_at, '') <> '' AND coalesce(kind, '') <> 'consolidated_memory')
SELECT 'node' AS part, id, CAST(NULL AS BIGINT) AS other FROM n WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'vector', vec_id, NULL FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edge', doc_id, doc_id + 3 FROM documents WHERE doc_id NOT IN (SELECT id FROM gone) AND doc_id + 3 NOT IN (SELECT id FROM gone)""")
def pruned(spark: SparkSession, d: str) -> DataFrame:
    n = gathered(spark, d)
    nodes, edges, vectors = memory.consolidation_prune(n, n.select(F.col("id").alias("source"), (F.col("id") + 3).alias("target")), read(spark, d, "embeddings").select(F.col("vec_id").alias("id")))
    none = F.lit(None).cast("long").alias("other")
    return nodes.select(F.lit("node").alias("part"), "id", none).unionByName(vectors.select(F.lit("vector").alias("part"), "id", none)).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), F.col("target").alias("other")))
