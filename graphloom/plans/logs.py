"""Queries on logs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import folds, logs, telemetry
from graphloom.plans.events import SCORES, reviews


#: Request after request of each peer, as the fold does it.
BUCKET = """
WITH RECURSIVE r AS (SELECT user_id AS peer, event_id AS id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT peer, id, n, t, CAST(1 AS DOUBLE) AS tokens, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT peer, id, n, t, have - CASE WHEN have >= 1 THEN 1 ELSE 0 END, have >= 1
  FROM (SELECT r.*, CASE WHEN r.t - f.t > 200000 THEN 2 ELSE least(2, f.tokens + (r.t - f.t) * (1 / CAST(40000 AS DOUBLE))) END AS have FROM f JOIN r ON r.peer = f.peer AND r.n = f.n + 1))
SELECT peer, id, allowed FROM f"""


@query("token_bucket", BUCKET)
def bucket(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("peer"), logs.seconds(F.col("ts")).alias("t"), F.col("event_id").alias("id"))
    return folds.token_bucket(e, 1 / 40_000, 2, 200_000)


@query("ttl_replay", """
WITH RECURSIVE r AS (SELECT event_type || user_id % 5 AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type || user_id % 5 ORDER BY ts) AS n FROM events),
f AS (SELECT key, n, t AS since, 0 AS hit FROM r WHERE n = 1 UNION ALL SELECT r.key, r.n, CASE WHEN r.t - f.since <= 60000 THEN f.since ELSE r.t END, CASE WHEN r.t - f.since <= 60000 THEN 1 ELSE 0 END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(count(*) - sum(hit) AS BIGINT) AS misses, round(sum(hit) / CAST(count(*) AS DOUBLE), 6) AS hit_rate FROM f""")
def replay(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("event_type", (F.col("user_id") % 5).cast("string"))
    return logs.ttl_replay(read(spark, d, "events").select(key.alias("key"), logs.seconds(F.col("ts")).alias("t")), 60_000)


@query("propagation_half_life", """
WITH l AS (SELECT user_id % 40 AS doc, event_id % 9 AS peer, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type = 'view' THEN 'web' ELSE 'federation' END AS source FROM events),
s AS (SELECT doc, min(t) AS t0, arg_min(peer, (t, peer)) AS first FROM l WHERE source = 'web' GROUP BY 1),
f AS (SELECT l.doc, l.peer, t0, min(t) AS t FROM l JOIN s USING (doc) WHERE source = 'federation' AND t >= t0 AND peer <> first GROUP BY ALL),
a AS (SELECT doc, t0, t FROM f UNION ALL SELECT doc, t0, t0 FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY t) AS k FROM a), r AS (SELECT doc, min(t - t0) AS took FROM n WHERE k >= 5 GROUP BY 1)
SELECT count(took) AS reached, count(*) FILTER (took IS NULL) AS never, coalesce(median(took), CAST('Infinity' AS DOUBLE)) AS half_life FROM s LEFT JOIN r USING (doc)""")
def half_life(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select((F.col("user_id") % 40).alias("doc"), (F.col("event_id") % 9).alias("peer"), logs.seconds(F.col("ts")).alias("t"), F.when(F.col("event_type") == "view", "web").otherwise("federation").alias("source"))
    return logs.propagation_half_life(e, 9)


@query("metric_snapshot", """
WITH b AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events),
l AS (SELECT name, max(n) AS n, list_sort(list(value)) AS v, avg(value) AS mean FROM b WHERE back <= 100 GROUP BY 1)
SELECT name, n AS count, round(mean, 6) AS mean, v[1] AS min, v[-1] AS max, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS INTEGER) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.95)) AS INTEGER) + 1] AS p95 FROM l""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return logs.metric_snapshot(read(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value"), 100)


@query("carry_session_meta", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS meta FROM events""")
def carried(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), "event_type")
    return logs.carry(e, F.when(F.col("event_type") == "signup", F.col("line"))).select(F.col("line").alias("event_id"), "meta")


@query("log_tail", "SELECT event_id, back FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 50")
def tail(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_tail(read(spark, d, "events")).select("event_id", "back")


@query("resolve_source_counts", "SELECT count(*) FILTER (event_type = 'view') AS local, count(*) FILTER (event_type = 'click') AS federation, count(*) FILTER (event_type NOT IN ('view', 'click')) AS web, count(*) AS total FROM events")
def sources(spark: SparkSession, d: str) -> DataFrame:
    return logs.source_counts(read(spark, d, "events").select(F.when(F.col("event_type") == "view", "local").when(F.col("event_type") == "click", "federation").otherwise("web").alias("source")))


@query("bypass_summary", """
WITH p AS (SELECT count(*) FILTER (event_id % 4 <> 0 AND event_id % 7 <> 0) AS terminal_verdicts, count(*) AS all_verdicts FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND event_type <> 'purchase'),
b AS (SELECT event_type AS tool, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS denied FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND event_id % 5 < 2),
g AS (SELECT tool, count(*) AS attempts, count(*) FILTER (denied) AS denied FROM b GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (denied) FROM b)
SELECT *, attempts - denied AS passed, round(attempts / CAST(terminal_verdicts AS DOUBLE), 6) AS rate FROM g, p""")
def bypass(spark: SparkSession, d: str) -> DataFrame:
    """Both logs hold open and missing marks."""
    e, i = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    prefetch = e.filter("event_type <> 'purchase'").select("ts", F.when(i % 7 != 0, i % 4 != 0).alias("terminal"))
    log = e.filter(i % 5 < 2).select("ts", F.col("event_type").alias("tool"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("denied"))
    return logs.bypass_summary(prefetch, log, F.lit("2024-01-08").cast("timestamp"))


@query("federated_outcomes", """
WITH a AS (SELECT event_id // 10 AS query_id, user_id AS peer, event_type <> 'error' AS ok, event_id % 3 AS n_rows, event_type = 'error' AND event_id % 2 = 0 AS timed_out, CAST(floor(value) AS BIGINT) AS bytes FROM events)
SELECT query_id, count(DISTINCT peer) AS queried, count(*) FILTER (ok AND n_rows > 0) AS responded, count(*) FILTER (timed_out) AS timed_out, count(*) FILTER (NOT ok AND NOT timed_out) AS errored, CAST(sum(bytes) AS BIGINT) AS bytes FROM a GROUP BY 1""")
def federated(spark: SparkSession, d: str) -> DataFrame:
    i, bad = F.col("event_id"), F.col("event_type") == "error"
    return logs.outcomes(read(spark, d, "events").select(F.floor(i / 10).alias("query_id"), F.col("user_id").alias("peer"), (~bad).alias("ok"), (i % 3).alias("n_rows"), (bad & (i % 2 == 0)).alias("timed_out"), F.floor("value").cast("long").alias("bytes")))


@query("consensus_origins", """
WITH m AS (SELECT event_id // 8 AS query_id, CASE WHEN event_id % 3 = 0 THEN 'p' || user_id % 4 ELSE 'local' END AS o FROM events UNION ALL SELECT event_id // 8, 'q' || event_id % 2 FROM events WHERE event_id % 5 = 0)
SELECT query_id, count(DISTINCT o) AS origins, bool_or(o <> 'local') AS remote FROM m GROUP BY 1""")
def origins(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    also = F.when(i % 5 == 0, F.array(F.concat(F.lit("q"), (i % 2).cast("string"))))
    return logs.consensus(read(spark, d, "events").select(F.floor(i / 8).alias("query_id"), F.when(i % 3 == 0, F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("source_peer"), also.alias("also_from_peers")))


@query("question_list", """
WITH q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS asked_by, CASE c_custkey % 4 WHEN 0 THEN 'answered' WHEN 1 THEN 'closed' WHEN 2 THEN 'odd' ELSE 'open' END AS status, c_acctbal AS t FROM customer),
s AS (SELECT question_id, CASE WHEN status = 'odd' THEN 'open' ELSE status END AS status, t FROM q WHERE asked_by IS NOT NULL), n AS (SELECT o_custkey AS question_id, count(*) AS n FROM orders GROUP BY 1)
SELECT s.question_id, s.status, coalesce(n, 0) AS n_answers, row_number() OVER (PARTITION BY s.status ORDER BY t DESC, s.question_id) AS place FROM s LEFT JOIN n USING (question_id)""")
def questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    q = read(spark, d, "customer").select(k.alias("question_id"), F.when(k % 9 != 0, F.col("c_nationkey")).alias("asked_by"), F.when(k % 4 == 0, "answered").when(k % 4 == 1, "closed").when(k % 4 == 2, "odd").otherwise("open").alias("status"), F.col("c_acctbal").alias("at"))
    return logs.question_list(q, read(spark, d, "orders").select(F.col("o_custkey").alias("question_id"))).select("question_id", "status", "n_answers", "place")


@query("entity_upsert", r"""
WITH c AS (SELECT event_id, 'Tool ' || event_type || CASE WHEN event_id % 2 = 0 THEN '  X' ELSE ' x' END AS label, 'alias ' || user_id % 3 AS alias, ts, event_id % 4 AS m, event_id % 50 <> 0 AS auto FROM events),
i AS (SELECT *, 'entity:tool:' || substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(label)), '\s+', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS id FROM c),
a AS (SELECT id, regexp_replace(lower(trim(label)), '\s+', ' ', 'g') AS x FROM i UNION SELECT id, alias FROM i), l AS (SELECT id, string_agg(x, '|' ORDER BY x) AS aliases FROM a GROUP BY 1)
SELECT i.id, arg_max(label, (ts, label)) AS label, min(ts) AS first_seen, max(ts) AS last_seen, CAST(sum(m) AS BIGINT) AS mention_count, bool_and(auto) AS auto, any_value(aliases) AS aliases FROM i JOIN l USING (id) GROUP BY 1""")
def entities(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    label = F.concat(F.lit("Tool "), F.col("event_type"), F.when(i % 2 == 0, "  X").otherwise(" x"))
    c = read(spark, d, "events").select(F.lit("tool").alias("kind"), label.alias("label"), F.array(F.concat(F.lit("alias "), (F.col("user_id") % 3).cast("string"))).alias("aliases"), F.col("ts").alias("seen"), (i % 4).alias("mentions"), (i % 50 != 0).alias("auto"))
    return logs.entity_upsert(c).withColumn("aliases", F.array_join("aliases", "|"))


@query("rank_peers", f"""
WITH {SCORES}, v AS (SELECT subject, peer, round(posterior * confidence * pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_review)) / 86.4e9) / 45) / (1 + (peer % 4) / 3.0), 6) AS value FROM scores)
SELECT *, row_number() OVER (PARTITION BY subject ORDER BY value DESC NULLS LAST, peer) AS place FROM v""")
def ranked(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.rank_peers(telemetry.peer_scores(reviews(spark, d)), F.to_timestamp(F.lit("2024-02-01 00:00:00")), F.col("peer") % 4)


@query("reviewer_evidence", """
SELECT event_type AS subject, user_id AS peer, event_id % 7 AS reviewer, round(sum(CAST(CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 1.0 END AS DOUBLE)), 6) AS weight_sum, round(sum(CAST(CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 1.0 END AS DOUBLE) * value / 100), 6) AS score_sum, max(ts) AS last_review FROM events GROUP BY ALL""")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    r = e.select(F.col("event_type").alias("subject"), F.col("user_id").alias("peer"), (F.col("event_id") % 7).alias("reviewer"), (F.col("value") / 100).alias("score"), F.when(F.col("event_id") % 3 == 0, 0.4).otherwise(1.0).alias("weight"), F.col("ts").alias("created_at"))
    return telemetry.reviewer_evidence(r)


@query("did_hash", "SELECT event_id, substr(sha256(user_id || ':' || strftime(ts, '%Y-%m-%d')), 1, 16) AS did_hash FROM events")
def did(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", logs.day_did_hash(F.col("user_id"), F.col("ts")).alias("did_hash"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("kind"), F.col("turn").alias("at"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("b"), F.col("turn").cast("string"))).alias("branch"), "text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("f"), (F.col("turn") % 4).cast("string"))).alias("path"))


@query("session_digest", r"""
WITH e AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS said FROM conversations), g AS (SELECT conv_id AS session, count(*) AS n_entries, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, min(turn) AS started, max(turn) AS ended,
  arg_max(said, turn) FILTER (role = 'user' AND said <> '') AS goal, 'b' || max(turn) FILTER (turn % 2 = 0) AS branch FROM e GROUP BY 1),
f AS (SELECT conv_id, 'f' || turn % 4 AS path, max(turn) AS t FROM conversations WHERE turn % 3 = 0 GROUP BY ALL), l AS (SELECT conv_id, string_agg(path, '|' ORDER BY t DESC, path) AS files FROM f GROUP BY 1)
SELECT g.*, coalesce(files, '') AS files FROM g LEFT JOIN l ON l.conv_id = g.session""")
def digest(spark: SparkSession, d: str) -> DataFrame:
    x = logs.session_digest(entries(spark, d))
    return x.drop("decisions", "open_ends", "errors").withColumn("files", F.coalesce(F.array_join("files", "|"), F.lit("")))


@query("digest_text")
def digest_text(spark: SparkSession, d: str) -> DataFrame:
    return logs.digest_text(logs.session_digest(entries(spark, d)))


@query("session_topics", r"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(substr(text, 1, 80)), '\s+')) AS word FROM conversations) WHERE length(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 10""")
def topics(spark: SparkSession, d: str) -> DataFrame:
    return logs.session_topics(read(spark, d, "conversations").select(F.substring("text", 1, 80).alias("label")))
