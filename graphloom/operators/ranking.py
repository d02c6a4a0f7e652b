"""Fusing, re-ranking and merging of ranked hits, per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import sound
from graphloom.operators.vectors import best, l2, search


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def multi_rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """lists(query_id, list, id, rank from 0, distance) -> query_id, id, score, distance 1 / (1 + score), position.

    A query with one list alone keeps its distances.
    """
    sound(lists.sparkSession)
    n = lists.groupBy("query_id").agg(F.count_distinct("list").alias("n_lists"))
    g = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"), F.min("distance").alias("nearest")).join(n, "query_id")
    g = g.withColumn("score", F.round("score", 9))
    distance = F.when(F.col("n_lists") > 1, F.round(1 / (1 + F.col("score")), 9)).otherwise(F.col("nearest"))
    return _placed(g.select("query_id", "id", "score", distance.alias("distance")), F.desc("score"), F.asc("id"))


def weighted_rrf(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, k: int = 60) -> DataFrame:
    """Two lists (query_id, id, rank from 0) -> fused score alpha / (k + dense rank + 1) + (1 - alpha) / (k + sparse rank + 1)."""
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "id", F.col("rank").alias("sparse_rank")), ["query_id", "id"], "full")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    s = both.select("query_id", "id", F.round(part(alpha, "dense_rank") + part(1 - alpha, "sparse_rank"), 9).alias("score"))
    return _placed(s, F.desc("score"), F.asc("id"))


def session_priority(hits: DataFrame, nodes: DataFrame, half_life: float = 7.0) -> DataFrame:
    """hits(query_id, id, distance), nodes(id, label, age_days) -> priority from age, common label words and distance.

    An unknown age counts as 365 days. Words are longer than three letters and counted over all labels.
    """
    tokens = lambda: F.filter(F.split(F.lower(F.coalesce("label", F.lit(""))), r"\s+"), lambda w: F.length(w) > 3)
    words = nodes.select("id", F.explode(tokens()).alias("w"))
    freq = words.groupBy("w").agg(F.count("*").alias("f"))
    most = freq.agg(F.greatest(F.lit(1), F.coalesce(F.max("f"), F.lit(1))).alias("most"))
    own = words.join(hits.select("id").distinct(), "id", "left_semi").join(freq, "w").groupBy("id").agg(F.avg("f").alias("mean_f"))
    x = hits.join(nodes.select("id", "age_days"), "id", "left").join(own, "id", "left").crossJoin(F.broadcast(most))  # one row
    far = F.greatest(F.lit(0.001), F.max("distance").over(Window.partitionBy("query_id")))
    value = 0.4 * F.pow(F.lit(2.0), -F.coalesce("age_days", F.lit(365.0)) / half_life) + 0.3 * F.coalesce(F.col("mean_f"), F.lit(0.0)) / F.col("most") + 0.3 * (1 - F.col("distance") / far)
    return _placed(x.select("query_id", "id", F.round(value, 9).alias("priority")), F.desc("priority"), F.asc("id"))


def ppr_rerank(hits: DataFrame, edges: DataFrame, alpha: float = 0.85, beta: float = 0.5, relations: tuple[str, ...] = ("mentions", "next_chunk")) -> DataFrame:
    """hits(query_id, id, distance), edges(source, target, relation) -> query_id, id, distance, position.

    The one-hop edges of a query's hits make a small directed graph (an edge between two hits counts twice,
    once from each end); its personalised PageRank, from 1 - distance, is mixed with 1 - distance. A query
    without edges keeps its distances. Each query's graph is worked on alone; a hub's edges go to the queries it is a hit of.
    """
    e = edges.filter(F.col("relation").isin(*relations)).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    h = hits.select("query_id", F.col("id").cast("string").alias("id"), "distance")
    near = h.select("query_id", F.col("id").alias("source")).join(e, "source").select("query_id", "source", "target").unionAll(h.select("query_id", F.col("id").alias("target")).join(e, "target").select("query_id", "source", "target"))
    kind = hits.schema["query_id"].dataType.simpleString()

    def rank(key: tuple, mine: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rel = np.clip(1 - mine["distance"].to_numpy(float), 0, None)
        out = mine[["query_id", "id", "distance"]].copy()
        if len(around) and len(mine):
            names = pd.Index(pd.unique(pd.concat([mine["id"], around["source"], around["target"]])))
            a, b = names.get_indexer(around["source"]), names.get_indexer(around["target"])
            n = len(names)
            start = np.zeros(n)
            start[names.get_indexer(mine["id"])] = rel if rel.sum() > 0 else 1.0
            start /= start.sum()
            fan = np.bincount(a, minlength=n)
            r = start
            for _ in range(50):
                new = alpha * (np.bincount(b, r[a] / fan[a], n) + r[fan == 0].sum() * start) + (1 - alpha) * start
                moved, r = np.abs(new - r).sum(), new
                if moved < 1e-6:
                    break
            own = r[names.get_indexer(mine["id"])]
            if own.max() > 0:
                out["distance"] = np.round(1 - (beta * rel + (1 - beta) * own / own.max()), 6)
        return out

    near = near.select(F.col("query_id").alias("of"), F.col("source").alias("source"), F.col("target").alias("target"))
    both = h.groupBy("query_id").cogroup(near.groupBy("of")).applyInPandas(rank, f"query_id {kind}, id string, distance double")
    return _placed(both, F.asc("distance"), F.asc("id"))


def cross_rerank(hits: DataFrame, head: int = 20) -> DataFrame:
    """hits(query_id, id, rank, distance, has_text, score) -> the head ordered by a model's score, then head rows without text, then the tail.

    A score in 0 to 1 is a probability, any other finite one a logit; distance is 1 - probability, 1 for a score that is not finite.
    """
    s = F.col("score").cast("double")
    p = F.when((s >= 0) & (s <= 1), s).otherwise(1 / (1 + F.exp(-s)))
    odd = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    x = hits.withColumn("place", place).withColumn("group", F.when(F.col("place") > head, 2).when(~F.col("has_text"), 1).otherwise(0))
    x = x.withColumn("distance", F.when(F.col("group") == 0, F.round(F.when(odd, 1.0).otherwise(1 - p), 6)).otherwise(F.col("distance")))
    return _placed(x, F.asc("group"), F.when(F.col("group") == 0, F.col("distance")), F.asc("place")).select("query_id", "id", "distance", "position")


def listwise_rerank(hits: DataFrame, order: DataFrame, head: int = 30) -> DataFrame:
    """hits(query_id, id, rank, has_text), order(query_id, id, at) -> the head in the order given.

    An id's first mention counts, unknown ids say nothing, ids not mentioned follow, then those without text, then the tail.
    """
    first = order.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    x = hits.withColumn("place", place).join(first, ["query_id", "id"], "left")
    group = F.when(F.col("place") > head, 3).when(~F.col("has_text"), 2).when(F.col("at").isNull(), 1).otherwise(0)
    return _placed(x.withColumn("group", group), F.asc("group"), F.when(F.col("group") == 0, F.col("at")), F.asc("place")).select("query_id", "id", "position")


def federated_merge(hits: DataFrame, k: int, peer_cap: int | None = None) -> DataFrame:
    """hits(query_id, id, peer null for local, arrival, distance) -> one row a node: the local one or the first peer's, other peers beside it, the k nearest.

    peer_cap cuts each peer's answer to its nearest rows first (broadcast answers: ceil(k / 3)).
    """
    x = hits
    if peer_cap is not None:
        own = Window.partitionBy("query_id", "peer").orderBy("distance", "id")
        x = x.withColumn("n", F.row_number().over(own)).filter(F.col("peer").isNull() | (F.col("n") <= peer_cap)).drop("n")
    first = F.struct(F.col("peer").isNotNull().alias("remote"), "arrival", "peer")
    g = x.groupBy("query_id", "id").agg(F.min_by(F.struct("peer", "distance"), first).alias("row"), F.array_sort(F.collect_set("peer")).alias("peers"))
    others = F.when(F.col("row.peer").isNull(), F.col("peers")).otherwise(F.array_remove("peers", F.col("row.peer")))
    out = _placed(g.select("query_id", "id", F.col("row.peer").alias("source_peer"), others.alias("also_from_peers"), F.col("row.distance").alias("distance")), F.asc("distance"), F.asc("id"))
    return out.filter(F.col("position") <= k)


def recall_merge(rows: DataFrame, most: int = 20) -> DataFrame:
    """rows(query_id, peer, ok, arrival, id, fetched_at) -> of peers that answered, the first row of each node, newest first."""
    g = rows.filter("ok").groupBy("query_id", "id").agg(F.min_by(F.struct("peer", "fetched_at"), F.struct("arrival", "peer")).alias("row"))
    return _placed(g.select("query_id", "id", "row.peer", "row.fetched_at"), F.desc_nulls_last("fetched_at"), F.asc("id")).filter(F.col("position") <= most)


def provenance_flips(hits: DataFrame, demotions: list[float]) -> DataFrame:
    """hits(query_id, id, cosine, trusted, poison) -> share of queries whose best hit is poison, for each demotion of untrusted hits."""
    x = hits.select("*", F.explode(F.array(*[F.lit(d) for d in demotions])).alias("demotion"))
    score = F.round(F.col("cosine") - F.when(F.col("trusted"), 0.0).otherwise(F.col("demotion")), 9)
    top = x.groupBy("demotion", "query_id").agg(F.max_by("poison", F.struct(score, -F.col("id"))).alias("poison"))
    return top.groupBy("demotion").agg(F.round(F.avg(F.col("poison").cast("int")), 6).alias("flip_rate"), F.count("*").alias("n_queries"))


def rocchio(queries: DataFrame, hits: DataFrame, vectors: DataFrame, m: int = 5, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """queries(query_id, vector), hits(query_id, vec_id, rank from 1), vectors(vec_id, vector) -> query_id, vector: moved to the mean of its best hits, unit length."""
    near = hits.filter(F.col("rank") <= m).join(vectors.select("vec_id", "vector"), "vec_id")
    q = queries.select("query_id", F.posexplode("vector").alias("i", "q"))
    mean = near.select("query_id", F.posexplode("vector").alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    y = q.join(mean, ["query_id", "i"], "left").withColumn("y", alpha * F.col("q") + beta * F.coalesce("x", F.lit(0.0)))
    g = y.groupBy("query_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("v"))
    return g.select("query_id", F.transform("v", lambda c: c / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("vector"))


def newest_shared(nodes: DataFrame, most: int = 5000) -> DataFrame:
    """Nodes that are not private, newest first, without a date last, then by id."""
    return nodes.filter(~F.coalesce(F.col("private"), F.lit(False))).orderBy(F.desc_nulls_last("fetched_at"), F.asc("id")).limit(most)


def semantic_reuse(queries: DataFrame, ttl: float, threshold: float) -> DataFrame:
    """queries(query_id, t, vector) -> query_id, source, sim of the most similar earlier query of the last ttl, null below the threshold.

    Time buckets of one ttl: a query meets its own bucket and the one before, so no pair further apart is formed.
    """
    q = queries.select("query_id", "t", "vector", F.floor(F.col("t") / ttl).alias("bucket"))
    old = q.select(F.col("query_id").alias("source"), F.col("t").alias("then"), F.col("vector").alias("other"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    sim = F.round(F.aggregate(F.zip_with("vector", "other", lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x), 6)
    near = q.join(old, "bucket").filter((F.col("then") < F.col("t")) & (F.col("t") - F.col("then") <= ttl)).withColumn("sim", sim).filter(F.col("sim") >= threshold)
    best = near.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("source")).alias("s"))).alias("b")).select("query_id", (-F.col("b.s")).alias("source"), "b.sim")
    return queries.select("query_id").join(best, "query_id", "left")


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors(vec_id, vector) -> pairs a < b within an L2 distance, by blocks of all against all."""
    found = search(vectors.select(F.col("vec_id").alias("query_id"), "vector"), vectors, l2, within=threshold)
    return found.filter("query_id < vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "distance")


def rrf_sweep(dense: DataFrame, sparse: DataFrame, qrels: DataFrame, ks: list[int], alphas: list[float], top: int = 10, topics: DataFrame | None = None) -> DataFrame:
    """Mean NDCG at top of the weighted fusion for each k and alpha; the grid is exploded inside the fused rows.

    qrels(query_id, id), or qrels(query_id, topic) with topics(topic, id): then an id is relevant that shares a topic with the query
    and is not the query itself. Only hits are judged, and of each topic top + 1 ids tell how many of the first
    `top` can be relevant, so the pairs of queries and relevant ids are never formed.
    """
    both = dense.select("query_id", "id", F.col("rank").alias("d")).join(sparse.select("query_id", "id", F.col("rank").alias("s")), ["query_id", "id"], "full")
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("alpha")) for k in ks for a in alphas])).alias("g")
    x = both.select("*", grid).select("query_id", "id", "d", "s", "g.k", "g.alpha")
    x = x.withColumn("score", F.round(F.coalesce(F.col("alpha") / (F.col("k") + F.col("d") + 1), F.lit(0.0)) + F.coalesce((1 - F.col("alpha")) / (F.col("k") + F.col("s") + 1), F.lit(0.0)), 9))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "k", "alpha").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top)
    if topics is None:
        rel = qrels.select("query_id", "id").distinct().withColumn("rel", F.lit(1))
        n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    else:
        asked, every = qrels.select("query_id", "topic").distinct(), topics.select("topic", "id").distinct()
        other = F.col("query_id") != F.col("id")
        rel = both.select("query_id", "id").distinct().join(every, "id").join(asked, ["query_id", "topic"]).filter(other).select("query_id", "id").distinct().withColumn("rel", F.lit(1))
        few = every.withColumn("k_", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).filter(F.col("k_") <= top + 1).select("topic", "id")
        n = asked.join(few, "topic").filter(other).groupBy("query_id").agg(F.count_distinct("id").alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(top), F.col("n_rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = x.join(rel, ["query_id", "id"], "left").groupBy("query_id", "k", "alpha").agg(F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    per = per.join(n, "query_id", "left").withColumn("ndcg", F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0))
    return per.groupBy("k", "alpha").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


def nearest_resolved(queries: DataFrame, resolved: DataFrame, threshold: float) -> DataFrame:
    """queries(query_id, vector), resolved(vec_id, vector), unit vectors, ids in order of time -> query_id, resolved, sim, reused: the most similar earlier one.

    As-of: a query sees only what was resolved before it, inside the search, which keeps one candidate for each block.
    """
    found = best(search(queries, resolved, l2, 1, earlier=True), 1)
    sim = F.round(1 - F.col("distance") * F.col("distance") / 2, 6)
    return found.select("query_id", F.col("vec_id").alias("resolved"), sim.alias("sim"), (sim >= threshold).alias("reused"))


def reuse_report(queries: DataFrame, hits: DataFrame, qrels: DataFrame, threshold: float, k: int) -> DataFrame:
    """What a stream of queries gains from earlier ones: n, base_recall, reuse_recall, rescued, hurt, used.

    queries(query_id, vector) in order of time, hits(query_id, id, score), qrels(query_id, id). A query takes over the relevant documents of
    the nearest earlier query from the threshold on, scored by that similarity (a document keeps its best score); recall is the share of queries with
    a relevant document among the first k by score, then id.
    """
    prior = nearest_resolved(queries, queries.select(F.col("query_id").alias("vec_id"), "vector"), threshold).filter("reused")
    own = hits.select("query_id", "id", "score", F.lit(True).alias("direct"))
    taken = prior.join(qrels.select(F.col("query_id").alias("resolved"), "id").distinct(), "resolved").select("query_id", "id", F.col("sim").alias("score"), F.lit(False).alias("direct"))
    first = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k).select("query_id", "id")
    right = lambda df, name: first(df).join(qrels.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn(name, F.lit(True))
    sound(queries.sparkSession)
    every = own.unionByName(taken).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    x = queries.select("query_id").join(right(own, "base"), "query_id", "left").join(right(every, "reuse"), "query_id", "left").join(prior.select("query_id", "reused"), "query_id", "left").fillna(False)
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return x.agg(F.count("*").alias("n"), share("base").alias("base_recall"), share("reuse").alias("reuse_recall"), F.count_if(F.col("reuse") & ~F.col("base")).alias("rescued"), F.count_if(~F.col("reuse") & F.col("base")).alias("hurt"), F.count_if("reused").alias("used"))
