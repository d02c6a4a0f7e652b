"""Queries on the event log: reputation, memory, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import telemetry

NOW = "2024-02-01 00:00:00"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("subject"), F.col("user_id").alias("peer"), (F.col("value") / 100).alias("score"), F.when(F.col("event_id") % 3 == 0, 0.4).otherwise(1.0).alias("weight"), F.col("ts").alias("created_at"))


SCORES = """
r AS (SELECT event_type AS subject, user_id AS peer, least(1, greatest(0, value / 100)) AS s, CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 1.0 END AS w, ts, max(ts) OVER (PARTITION BY event_type, user_id) AS last FROM events),
x AS (SELECT *, pow(0.5, (epoch_us(last) - epoch_us(ts)) / 86.4e9 / 45) AS d FROM r),
g AS (SELECT subject, peer, count(*) AS n_reviews, sum(w * d) AS sw, sum(w * s * d) AS sws, sum(w * s * s * d) AS swss, min(ts) AS first_review, max(ts) AS last_review FROM x GROUP BY 1, 2),
scores AS (SELECT subject, peer, n_reviews, round(sw, 6) AS weight_sum, round(swss, 6) AS square_sum, round((1.5 + sws) / (3 + sw), 6) AS posterior, round(sw / (sw + 3), 6) AS confidence, round((1.5 + sws) / (3 + sw) * (sw / (sw + 3)), 6) AS stored_rank, first_review, last_review FROM g)
"""


@query("peer_scores", f"WITH {SCORES} SELECT * FROM scores")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.peer_scores(reviews(spark, d))


@query("beta_counters", """
WITH g AS (SELECT user_id AS id, 1 + count(*) FILTER (event_type <> 'error') AS alpha, 1 + count(*) FILTER (event_type = 'error') AS beta FROM events GROUP BY 1), p AS (SELECT *, alpha / CAST(alpha + beta AS DOUBLE) AS p FROM g)
SELECT id, alpha, beta, round(p, 6) AS mean, round(-(p * ln(p) + (1 - p) * ln(1 - p)), 6) AS entropy FROM p""")
def beta(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.beta_counters(read(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("success")))


@query("retention_score", f"""
WITH g AS (SELECT user_id AS id, count(*) AS n, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 86.4e9 AS age, sum(1 / greatest(1, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86.4e9)) FILTER (event_type = 'purchase') AS acc FROM events GROUP BY 1),
s AS (SELECT id, n, round(greatest(0, least(1, least(1, 0.5 + least(0.2, 0.02 * n)) * exp(-0.01 * age) + 0.003 * coalesce(acc, 0))), 6) AS score FROM g)
SELECT id, n, score, CASE WHEN score >= 0.7 THEN 'hot' WHEN score >= 0.4 THEN 'warm' WHEN score >= 0.15 THEN 'cold' ELSE 'frozen' END AS band FROM s""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    days = lambda c: (telemetry.micros(F.lit(NOW)) - telemetry.micros(c)) / 86.4e9
    g = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(F.when(F.col("event_type") == "purchase", 1 / F.greatest(F.lit(1.0), days(F.col("ts"))))).alias("acc"))
    s = g.withColumn("score", F.round(telemetry.retention(days(F.col("last")), F.col("n"), F.coalesce("acc", F.lit(0.0)) / 100), 6))
    return s.select("id", "n", "score", telemetry.retention_band(F.col("score")).alias("band"))


SERIES = """
n AS (SELECT user_id % 10 AS grp, event_id AS t, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS rn FROM events),
series AS (SELECT grp, rn // 50 AS bucket, round(avg(hit), 6) AS rate, max(t) AS t FROM n GROUP BY 1, 2 HAVING count(*) = 50)
"""


@query("fallback_rate_series", f"WITH {SERIES} SELECT * FROM series")
def series(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("t"), (F.col("event_type") == "error").cast("int").alias("hit"))
    return telemetry.rate_series(e, 50)


@query("compounding_slope", f"WITH {SERIES} SELECT grp, CASE WHEN count(DISTINCT t) < 2 THEN 0.0 ELSE round(regr_slope(rate, t), 9) END AS slope, count(*) AS points FROM series GROUP BY 1")
def slopes(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.slope(series(spark, d))


@query("did_observations", "SELECT user_id AS did, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY 1")
def observations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("user_id").alias("did")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("n"))


@query("event_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("contribution_totals", "SELECT user_id AS peer, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'click') AS fetches, count(DISTINCT CAST(json_extract(props, '$.k') AS INTEGER)) AS helped, max(ts) AS last FROM events GROUP BY 1")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("peer")).agg(F.count_if(F.col("event_type") == "view").alias("searches"), F.count_if(F.col("event_type") == "click").alias("fetches"), F.count_distinct(k).alias("helped"), F.max("ts").alias("last"))
