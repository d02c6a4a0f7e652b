"""Reputation, memory and event aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def peer_scores(reviews: DataFrame, half_life: float = 45.0) -> DataFrame:
    """reviews(subject, peer, score, weight, created_at) -> decayed sums, posterior and confidence.

    Closed form of the step rule: each review counts with 0.5 ** (days to the group's last review / half-life).
    Weights are taken against a fixed day first and scaled by the group's last review after summing, so all
    is one aggregation that is combined before the shuffle.
    """
    days = lambda c: micros(c) / 86.4e9 - 19_000  # noqa: E731  days from early 2022
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    x = reviews.withColumn("d", F.pow(F.lit(2.0), days(F.col("created_at")) / half_life)).withColumn("w", clamp("weight")).withColumn("s", clamp("score"))
    sums = [F.sum(v * F.col("d")).alias(n) for n, v in (("sw", F.col("w")), ("sws", F.col("w") * F.col("s")), ("swss", F.col("w") * F.col("s") * F.col("s")))]
    g = x.groupBy("subject", "peer").agg(F.count("*").alias("n_reviews"), *sums, F.min("created_at").alias("first_review"), F.max("created_at").alias("last_review"))
    scale = F.pow(F.lit(2.0), -days(F.col("last_review")) / half_life)
    for n in ("sw", "sws", "swss"):
        g = g.withColumn(n, F.col(n) * scale)
    post = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.5 + F.col("sws")) / (3 + F.col("sw"))))
    conf = F.col("sw") / (F.col("sw") + 3)
    return g.select("subject", "peer", "n_reviews", F.round("sw", 6).alias("weight_sum"), F.round("swss", 6).alias("square_sum"), F.round(post, 6).alias("posterior"), F.round(conf, 6).alias("confidence"), F.round(post * conf, 6).alias("stored_rank"), "first_review", "last_review")


def rank_peers(scores: DataFrame, now: Column, load: Column, half_life: float = 45.0) -> DataFrame:
    """scores(subject, peer, posterior, confidence, last_review) -> rank value and place of each peer of a subject."""
    age = F.greatest(F.lit(0.0), (micros(now) - micros(F.col("last_review"))) / 86.4e9)
    value = F.round(F.col("posterior") * F.col("confidence") * F.pow(F.lit(0.5), age / half_life) / (1 + load / 3), 6)
    x = scores.select("subject", "peer", value.alias("value"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc_nulls_last("value"), "peer")))


def reviewer_evidence(reviews: DataFrame) -> DataFrame:
    """reviews(subject, peer, reviewer, score, weight, created_at) -> sums without decay of each reviewer."""
    return reviews.groupBy("subject", "peer", "reviewer").agg(F.round(F.sum("weight"), 6).alias("weight_sum"), F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score_sum"), F.max("created_at").alias("last_review"))


def expected_utility(sim: Column, mean: Column, entropy: Column, risk: Column) -> Column:
    return sim * mean - risk * (1 - mean) * 0.5 + 0.1 * entropy


def beta_counters(events: DataFrame) -> DataFrame:
    """events(id, success boolean) -> alpha, beta, mean, entropy in nats."""
    g = events.groupBy("id").agg((1 + F.count_if("success")).alias("alpha"), (1 + F.count_if(~F.col("success"))).alias("beta"))
    p = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return g.select("id", "alpha", "beta", F.round(p, 6).alias("mean"), F.round(-(p * F.log(p) + (1 - p) * F.log(1 - p)), 6).alias("entropy"))


def retention(age_days: Column, accesses: Column, access_sum: Column, base: float = 0.5) -> Column:
    """Salience times decay plus what recent accesses add, within 0 and 1."""
    salience = F.least(F.lit(1.0), F.lit(base) + F.least(F.lit(0.2), 0.02 * accesses))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), salience * F.exp(-0.01 * age_days) + 0.3 * access_sum))


def retention_band(score: Column) -> Column:
    return F.when(score >= 0.7, "hot").when(score >= 0.4, "warm").when(score >= 0.15, "cold").otherwise("frozen")


def rate_series(events: DataFrame, size: int) -> DataFrame:
    """events(t, hit 0/1, grp) -> per group non-overlapping buckets of `size` consecutive events: rate and last t; the last partial bucket goes."""
    n = events.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("t")) - 1)
    g = n.groupBy("grp", F.floor(F.col("rn") / size).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"), F.max("t").alias("t"))
    return g.filter(F.col("n") == size).drop("n")


def slope(series: DataFrame) -> DataFrame:
    """Least squares of rate on t per group, 0 where there is no spread."""
    return series.groupBy("grp").agg(F.round(F.coalesce(F.regr_slope("rate", "t"), F.lit(0.0)), 9).alias("slope"), F.count("*").alias("points"))
