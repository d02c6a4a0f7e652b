"""Queries that run as streams over the tables until these end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import streaming
from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import telemetry
from graphloom.plans.events import SCORES, reviews
from graphloom.plans.logs import BUCKET
from graphloom.streaming import state


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_counts_stream", """
SELECT date_trunc('hour', ts) + INTERVAL 10 MINUTE * (CAST(date_part('minute', ts) AS INTEGER) // 10 - k) AS start, event_type, count(*) AS n FROM events, range(0, 6) r(k) GROUP BY ALL""")
def counts(spark: SparkSession, d: str) -> DataFrame:
    """Sliding hours, every ten minutes."""
    return streaming.drained(events(spark, d).select("ts", "event_type"), lambda e: streaming.event_counts(e, "1 hour", "10 minutes"), "update", ["start", "event_type"])


@query("reputation_stream", f"WITH {SCORES} SELECT * FROM scores")
def reputation(spark: SparkSession, d: str) -> DataFrame:
    return streaming.drained(reviews(spark, d), telemetry.peer_scores, "update", ["subject", "peer"])


@query("first_responses", """
SELECT DISTINCT event_id // 6 AS request_id, user_id AS peer_id FROM events WHERE (event_id * 37) % 500 <= 250""")
def first(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    a = events(spark, d).select(F.floor(i / 6).alias("request_id"), F.col("user_id").alias("peer_id"), F.col("ts").alias("issued_at"), F.timestamp_micros(F.unix_micros("ts") + 1000 * ((i * 37) % 500)).alias("ts"))
    return streaming.drained(a, lambda s: streaming.first_responses(s, "60 days"), "append").select("request_id", "peer_id")


@query("debounced_batches", """
WITH g AS (SELECT user_id % 5 AS root, 'p' || event_id % 12 AS path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT root, min(ts) AS start, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM s GROUP BY root, k""")
def debounced(spark: SparkSession, d: str) -> DataFrame:
    c = events(spark, d).select((F.col("user_id") % 5).alias("root"), F.concat(F.lit("p"), (F.col("event_id") % 12).cast("string")).alias("path"), "ts")
    last = c.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("root"), F.lit("end").alias("path"), (F.col("ts") + F.expr("interval 3 days")).alias("ts"))
    # a session leaves, and its state with it, once the watermark has passed it: a last row of no root moves it on
    out = streaming.drained(c.unionByName(last), lambda s: streaming.debounced(s, "2 hours", "1 day"), "append").filter("root >= 0")
    return out.select("root", "start", F.array_join("paths", ",").alias("paths"))


@query("chunk_stream")
def chunked(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_uri"), F.col("source").alias("title"), "text")
    return streaming.drained(x, streaming.chunk_stream, "append")


@query("token_bucket_stream", BUCKET)
def buckets(spark: SparkSession, d: str) -> DataFrame:
    r = events(spark, d).select(F.col("user_id").alias("peer"), F.col("event_id").alias("id"), "ts")
    return streaming.drained(r, lambda s: state.token_bucket_stream(s, 1 / 40_000, 2, 200_000, "60 days"), "append")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as queries of eight workspaces, one a second."""
    v = read(spark, d, "embeddings")
    return v.select((F.col("vec_id") % 8).alias("workspace"), F.col("vec_id").alias("query_id"), F.timestamp_seconds(F.col("vec_id") + 86_400).alias("ts"), F.col("embedding").cast("array<double>").alias("vector"))


@query("recent_reuse_stream", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS source, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.vec_id < a.vec_id AND a.vec_id - b.vec_id <= 400 AND a.vec_id % 8 = b.vec_id % 8),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source) AS n FROM s WHERE sim >= 0.35)
SELECT vec_id % 8 AS workspace, vec_id AS query_id, source, sim FROM v LEFT JOIN b ON b.query_id = v.vec_id AND n = 1""")
def recent(spark: SparkSession, d: str) -> DataFrame:
    """Every query stays an entry, so that SQL can say which one answers; test_state.py replays the cache of missed queries."""
    return streaming.drained(asked(spark, d), lambda s: state.recent_reuse_stream(s, 400.0, 0.35, True, "60 days"), "append")
