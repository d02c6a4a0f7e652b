"""Queries on fusing, re-ranking and merging hits of the vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import graph, ranking, vectors
from graphloom.plans.retrieval import DENSE, VECTORS, dense

#: Three lists of each query: by distance, a hash order of all but the first three, the last five ids.
LISTS = f"""
{DENSE},
first AS (SELECT query_id, vec_id AS id, 'near' AS list, rank - 1 AS rank, distance FROM dense),
second AS (SELECT query_id, vec_id AS id, 'hash' AS list, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id * 7919) % 1009, vec_id) - 1 AS rank, distance + 0.25 AS distance FROM dense WHERE rank > 3),
third AS (SELECT * FROM (SELECT query_id, vec_id AS id, 'last' AS list, row_number() OVER (PARTITION BY query_id ORDER BY vec_id DESC) - 1 AS rank, distance FROM dense WHERE query_id % 40 = 0) WHERE rank < 5)
"""


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = dense(spark, d).withColumnRenamed("vec_id", "id")
    row = lambda df, name, *order: df.select("query_id", "id", F.lit(name).alias("list"), (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).alias("rank"), "distance")
    first = hits.select("query_id", "id", F.lit("near").alias("list"), (F.col("rank") - 1).alias("rank"), "distance")
    second = row(hits.filter("rank > 3").withColumn("distance", F.col("distance") + 0.25), "hash", (F.col("id") * 7919) % 1009, "id")
    third = row(hits.filter("query_id % 40 = 0"), "last", F.desc("id")).filter("rank < 5")
    return first, second, third


@query("multi_rrf", f"""
WITH {LISTS}, l AS (SELECT * FROM first WHERE query_id % 100 <> 0 OR true UNION ALL SELECT * FROM second WHERE query_id % 60 <> 0 UNION ALL SELECT * FROM third WHERE query_id % 60 <> 0),
n AS (SELECT query_id, count(DISTINCT list) AS n FROM l GROUP BY 1), g AS (SELECT query_id, id, round(sum(1.0 / (60 + rank + 1)), 9) AS score, min(distance) AS nearest FROM l GROUP BY ALL),
x AS (SELECT g.query_id, id, score, CASE WHEN n > 1 THEN round(1 / (1 + score), 9) ELSE nearest END AS distance FROM g JOIN n USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM x""")
def multi(spark: SparkSession, d: str) -> DataFrame:
    """Queries divisible by 60 have the first list alone."""
    a, b, c = lists(spark, d)
    return ranking.multi_rrf(a.union(b.filter("query_id % 60 <> 0")).union(c.filter("query_id % 60 <> 0")))


@query("weighted_rrf", f"""
WITH {LISTS}, x AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, round(coalesce(0.3 / (61 + a.rank), 0) + coalesce(0.7 / (61 + b.rank), 0), 9) AS score FROM first a FULL JOIN second b ON a.query_id = b.query_id AND a.id = b.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM x""")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = lists(spark, d)
    return ranking.weighted_rrf(a, b, 0.3)


@query("rrf_sweep", f"""
WITH {LISTS}, rel AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
x AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, k, alpha, round(coalesce(alpha / (k + a.rank + 1), 0) + coalesce((1 - alpha) / (k + b.rank + 1), 0), 9) AS score FROM first a FULL JOIN second b ON a.query_id = b.query_id AND a.id = b.id, (SELECT unnest([10, 60]) AS k), (SELECT CAST(unnest([0.2, 0.5, 0.8]) AS DOUBLE) AS alpha)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, k, alpha ORDER BY score DESC, id) AS rank FROM x),
dc AS (SELECT r.query_id, k, alpha, sum(CASE WHEN rel.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r LEFT JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id WHERE rank <= 10 GROUP BY ALL)
SELECT k, alpha, round(avg(CASE WHEN n_rel > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_rel) ELSE 0 END), 6) AS ndcg FROM dc LEFT JOIN n USING (query_id) GROUP BY ALL""")
def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the query's label are relevant."""
    a, b, _ = lists(spark, d)
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"))
    return ranking.rrf_sweep(a, b, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), [10, 60], [0.2, 0.5, 0.8], topics=e)


@query("hamming_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.b, v.b), lambda z: abs(z[1] - z[2]))) AS DOUBLE) AS distance FROM v q JOIN v ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10""")
def hamming(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.best(vectors.search(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v, vectors.hamming, 10), 10)


@query("packed_hamming", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, e, list_avg(e) AS m, list_sum(list_transform(e, lambda x: pow(x - list_avg(e), 2))) / len(e) AS var FROM v),
b AS (SELECT vec_id, list_transform(e[1:48], lambda x: CASE WHEN x > m THEN 1 ELSE 0 END) AS b FROM s)
SELECT x.vec_id, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance FROM b x JOIN b y ON y.vec_id = x.vec_id + 1""")
def packed(spark: SparkSession, d: str) -> DataFrame:
    """Each vector cut to 48 dimensions, packed to bits, against the next one."""
    p = read(spark, d, "embeddings").select("vec_id", vectors.packed_bits(vectors.truncated(F.col("embedding").cast("array<double>"), 48), 48).alias("w"))
    return p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("other")), "vec_id").select("vec_id", vectors.hamming_words(F.col("w"), F.col("other")).alias("distance"))


@query("int8_quantize", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v)
SELECT vec_id, CAST(list_sum(list_transform(e, lambda x: round(x * 127 / top))) AS BIGINT) AS total, CAST(list_sum(list_transform(e, lambda x: abs(round(x * 127 / top)))) AS BIGINT) AS size FROM t""")
def quantised(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "embeddings").select("vec_id", vectors.int8(F.col("embedding").cast("array<double>")).alias("q"))
    add = lambda f: F.aggregate("q", F.lit(0).cast("long"), f)
    return q.select("vec_id", add(lambda s, x: s + x).alias("total"), add(lambda s, x: s + F.abs(x)).alias("size"))


@query("centroids", """
WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL)
SELECT label, max(n) AS n, round(sqrt(sum(x * x)), 6) AS spread FROM m GROUP BY 1""")
def centres(spark: SparkSession, d: str) -> DataFrame:
    """How long the mean vector of each label is before it is brought to unit length: its members' agreement."""
    v = read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector"))
    c = vectors.centroids(v)
    mean = v.join(c, "label").select("label", vectors.dot(F.col("vector"), F.col("centroid")).alias("c"))
    return mean.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("spread"))


@query("whiten", """
WITH x AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT i, round(avg(x), 6) AS mean, round(1 / sqrt(var_pop(x) + 1e-6), 4) AS weight FROM x GROUP BY 1""")
def whiten(spark: SparkSession, d: str) -> DataFrame:
    w = vectors.whitening(read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("vector")))
    return w.select("i", F.round("mean", 6).alias("mean"), F.round("weight", 4).alias("weight"))


@query("knn_graph", f"""
WITH {VECTORS.replace('a.vec_id % 20 = 0', 'a.vec_id <> b.vec_id')} SELECT query_id AS source, vec_id AS target, weight FROM (SELECT query_id, vec_id, round(greatest(0, sim), 6) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY round(-sim, 6), vec_id) AS rank FROM p) WHERE rank <= 5""")
def knn(spark: SparkSession, d: str) -> DataFrame:
    """The five best dot products of every vector, itself left out."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = vectors.search(v.select(F.col("vec_id").alias("query_id"), "vector"), v, vectors.negative_dot, 6).filter("query_id <> vec_id")
    return vectors.best(found, 5).select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), F.greatest(F.lit(0.0), -F.col("distance")).alias("weight"))


@query("near_pairs", f"WITH {VECTORS.replace('a.vec_id % 20 = 0', 'a.vec_id < b.vec_id')} SELECT query_id AS a, vec_id AS b, distance FROM p WHERE distance <= 1.1")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return ranking.near_pairs(read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), 1.1)


@query("rocchio", f"""
WITH {DENSE}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT query_id, i, avg(x) AS x FROM dense JOIN x USING (vec_id) WHERE rank <= 5 GROUP BY ALL),
y AS (SELECT m.query_id, m.i, 0.7 * q.x + 0.3 * m.x AS y FROM m JOIN x q ON q.vec_id = m.query_id AND q.i = m.i), z AS (SELECT query_id, list(y ORDER BY i) AS e, sqrt(sum(y * y)) AS norm FROM y GROUP BY 1),
t AS (SELECT z.query_id, v.vec_id, round(list_distance(list_transform(z.e, lambda c: c / norm), v.e), 6) AS distance FROM z, v)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM t) WHERE rank <= 10""")
def expanded(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.best(vectors.search(ranking.rocchio(q, dense(spark, d), v), v, vectors.l2, 10), 10)


@query("cross_rerank", f"""
WITH {DENSE}, h AS (SELECT query_id, vec_id AS id, rank, distance, vec_id % 7 <> 0 AS has_text, CASE WHEN vec_id % 3 = 0 THEN (vec_id % 100) / 100.0 ELSE (vec_id % 11) - 5.0 END AS score FROM dense),
g AS (SELECT *, CASE WHEN rank > 6 THEN 2 WHEN NOT has_text THEN 1 ELSE 0 END AS grp FROM h),
x AS (SELECT *, CASE WHEN grp = 0 THEN round(1 - CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 1 / (1 + exp(-score)) END, 6) ELSE distance END AS nd FROM g)
SELECT query_id, id, nd AS distance, row_number() OVER (PARTITION BY query_id ORDER BY grp, CASE WHEN grp = 0 THEN nd END, rank) AS position FROM x""")
def cross(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    h = dense(spark, d).withColumnRenamed("vec_id", "id").withColumn("has_text", i % 7 != 0).withColumn("score", F.when(i % 3 == 0, (i % 100) / 100).otherwise(((i % 11) - 5).cast("double")))
    return ranking.cross_rerank(h, 6)


@query("listwise_rerank", f"""
WITH {DENSE}, h AS (SELECT query_id, vec_id AS id, rank, vec_id % 7 <> 0 AS has_text FROM dense), o AS (SELECT query_id, id, min(k) AS k FROM (SELECT query_id, vec_id AS id, (vec_id * 31) % 17 AS k FROM dense WHERE vec_id % 2 = 0 UNION ALL SELECT query_id, vec_id, (vec_id * 13) % 19 FROM dense WHERE vec_id % 4 = 0) GROUP BY ALL),
x AS (SELECT h.*, o.k, CASE WHEN rank > 8 THEN 3 WHEN NOT has_text THEN 2 WHEN o.k IS NULL THEN 1 ELSE 0 END AS grp FROM h LEFT JOIN o ON o.query_id = h.query_id AND o.id = h.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY grp, CASE WHEN grp = 0 THEN k END, rank) AS position FROM x""")
def listwise(spark: SparkSession, d: str) -> DataFrame:
    h = dense(spark, d).withColumnRenamed("vec_id", "id").withColumn("has_text", F.col("id") % 7 != 0)
    said = lambda m, a, b: h.filter(F.col("id") % m == 0).select("query_id", "id", ((F.col("id") * a) % b).alias("at"))
    return ranking.listwise_rerank(h, said(2, 31, 17).union(said(4, 13, 19)), 8)


@query("session_priority", f"""
WITH {DENSE}, n AS (SELECT doc_id AS id, substr(text, 1, 60) AS label, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(doc_id % 30 AS DOUBLE) END AS age FROM documents),
w AS (SELECT id, w FROM (SELECT id, unnest(regexp_split_to_array(lower(coalesce(label, '')), '\\s+')) AS w FROM n) WHERE length(w) > 3), f AS (SELECT w, count(*) AS f FROM w GROUP BY 1), o AS (SELECT id, avg(f) AS mf FROM w JOIN f USING (w) GROUP BY 1),
x AS (SELECT query_id, vec_id AS id, round(0.4 * pow(2, -coalesce(age, 365) / 7) + 0.3 * coalesce(mf, 0) / (SELECT max(f) FROM f) + 0.3 * (1 - distance / greatest(0.001, max(distance) OVER (PARTITION BY query_id))), 9) AS priority FROM dense d LEFT JOIN n ON n.id = d.vec_id LEFT JOIN o ON o.id = d.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, id) AS position FROM x""")
def priority(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("label"), F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 30).cast("double")).alias("age_days"))
    return ranking.session_priority(dense(spark, d).select("query_id", F.col("vec_id").alias("id"), "distance"), n)


@query("federated_merge", f"""
WITH {DENSE}, h AS (SELECT query_id, vec_id AS id, NULL AS peer, 0 AS arrival, distance FROM dense WHERE rank % 3 = 0 UNION ALL SELECT query_id, vec_id, 'p' || CAST((vec_id + k) % 4 AS VARCHAR), CAST((vec_id * 7 + k) % 5 AS INTEGER), distance + k / 10.0 FROM dense, range(0, 3) r(k)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, peer ORDER BY distance, id) AS n FROM h), k AS (SELECT * FROM c WHERE peer IS NULL OR n <= 4),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY peer IS NOT NULL, arrival, peer) AS r, string_agg(peer, ',') OVER (PARTITION BY query_id, id ORDER BY peer ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x FROM k),
g AS (SELECT query_id, id, arg_min(struct_pack(peer := peer, distance := distance), (peer IS NOT NULL, arrival, coalesce(peer, ''))) AS row, list_sort(list(DISTINCT peer) FILTER (peer IS NOT NULL)) AS peers FROM k GROUP BY ALL),
o AS (SELECT query_id, id, row.peer AS source_peer, array_to_string(list_filter(coalesce(peers, []), lambda p: p IS DISTINCT FROM row.peer), ',') AS also, row.distance AS distance FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS position FROM o) WHERE position <= 8""")
def merged(spark: SparkSession, d: str) -> DataFrame:
    h = dense(spark, d).withColumnRenamed("vec_id", "id")
    local = h.filter("rank % 3 = 0").select("query_id", "id", F.lit(None).cast("string").alias("peer"), F.lit(0).alias("arrival"), "distance")
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    remote = h.select("query_id", "id", "distance", k).select("query_id", "id", F.concat(F.lit("p"), ((F.col("id") + F.col("k")) % 4).cast("string")).alias("peer"), ((F.col("id") * 7 + F.col("k")) % 5).cast("int").alias("arrival"), (F.col("distance") + F.col("k") / 10).alias("distance"))
    out = ranking.federated_merge(local.union(remote), 8, 4)
    return out.withColumn("also", F.array_join("also_from_peers", ",")).drop("also_from_peers")


@query("federated_recall_merge", f"""
WITH {DENSE}, r AS (SELECT query_id, vec_id AS id, 'p' || CAST((vec_id + k) % 4 AS VARCHAR) AS peer, (vec_id + k) % 4 <> 2 AS ok, (vec_id * 7 + k) % 5 AS arrival, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST((vec_id * (k + 3)) % 97 AS INTEGER) AS fetched_at FROM dense, range(0, 3) t(k)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY arrival, peer) AS n FROM r WHERE ok)
SELECT * FROM (SELECT query_id, id, peer, fetched_at, row_number() OVER (PARTITION BY query_id ORDER BY fetched_at DESC, id) AS position FROM g WHERE n = 1) WHERE position <= 5""")
def recall_merged(spark: SparkSession, d: str) -> DataFrame:
    h = dense(spark, d).select("query_id", F.col("vec_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    peer = (F.col("id") + F.col("k")) % 4
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 3600 * ((F.col("id") * (F.col("k") + 3)) % 97))
    rows = h.select("query_id", F.concat(F.lit("p"), peer.cast("string")).alias("peer"), (peer != 2).alias("ok"), ((F.col("id") * 7 + F.col("k")) % 5).alias("arrival"), "id", at.alias("fetched_at"))
    return ranking.recall_merge(rows, 5)


@query("provenance_flips", f"""
WITH {DENSE}, x AS (SELECT query_id, vec_id, demotion, vec_id % 3 = 0 AS poison, round(1 - distance * distance / 2 - CASE WHEN vec_id % 3 = 1 THEN 0 ELSE demotion END, 9) AS score FROM dense, (SELECT CAST(unnest([0.0, 0.1, 0.5]) AS DOUBLE) AS demotion) WHERE vec_id <> query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY demotion, query_id ORDER BY score DESC, vec_id) AS n FROM x)
SELECT demotion, round(avg(CASE WHEN poison THEN 1 ELSE 0 END), 6) AS flip_rate, count(*) AS n_queries FROM t WHERE n = 1 GROUP BY 1""")
def flips(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    h = dense(spark, d).filter("vec_id <> query_id").select("query_id", i.alias("id"), (1 - F.col("distance") * F.col("distance") / 2).alias("cosine"), (i % 3 == 1).alias("trusted"), (i % 3 == 0).alias("poison"))
    return ranking.provenance_flips(h, [0.0, 0.1, 0.5])


@query("newest_shared", """
SELECT event_id AS id, ts AS fetched_at FROM events WHERE event_type <> 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 5000""")
def shared(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("fetched_at"), (F.col("event_type") == "error").alias("private"))
    return ranking.newest_shared(e).select("id", "fetched_at")


@query("semantic_reuse", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS source, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.vec_id < a.vec_id AND a.vec_id - b.vec_id <= 60),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source) AS n FROM s WHERE sim >= 0.35)
SELECT vec_id AS query_id, source, sim FROM v LEFT JOIN b ON b.query_id = v.vec_id AND n = 1""")
def reuse(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as queries, one a second; answers live for 60 seconds."""
    q = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("vector"))
    return ranking.semantic_reuse(q, 60.0, 0.35)


@query("deep_search", f"""
WITH {DENSE}, e AS (SELECT vec_id AS source, (vec_id * 7 + 3) % 500 AS target FROM embeddings), b AS (SELECT source, target FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target),
z AS (SELECT query_id, vec_id AS id, distance FROM dense WHERE rank <= 3),
o AS (SELECT query_id, target AS id, round(min(distance) + 0.1, 9) AS distance FROM z JOIN b ON b.source = z.id WHERE (query_id, target) NOT IN (SELECT (query_id, id) FROM z) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM o) WHERE n <= 10),
s AS (SELECT query_id, id, distance, 0 AS hop FROM z UNION ALL SELECT query_id, id, distance, 1 FROM o),
t AS (SELECT query_id, target AS id, round(min(distance) + 0.1, 9) AS distance FROM f JOIN b ON b.source = f.id WHERE (query_id, target) NOT IN (SELECT (query_id, id) FROM s) GROUP BY ALL),
a AS (SELECT * FROM s UNION ALL SELECT query_id, id, distance, 2 FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, hop, id) AS position FROM a) WHERE position <= 10""")
def deep(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("source"), ((F.col("vec_id") * 7 + 3) % 500).alias("target"))
    return graph.deep_search(dense(spark, d).filter("rank <= 3").withColumnRenamed("vec_id", "id"), e)


@query("ppr_rerank")
def ppr(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("source"), ((F.col("vec_id") * 7 + 3) % 500).alias("target"), F.lit("mentions").alias("relation"))
    return ranking.ppr_rerank(dense(spark, d).select("query_id", F.col("vec_id").alias("id"), "distance"), e)


@query("nearest_resolved_query", f"""
WITH {VECTORS.replace('a.vec_id % 20 = 0', 'a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 AND b.vec_id < a.vec_id')},
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p), w AS (SELECT query_id, vec_id, round(1 - distance * distance / 2, 6) AS sim FROM n WHERE rank = 1)
SELECT query_id, vec_id AS resolved, sim, sim >= 0.3 AS reused FROM w""")
def resolved(spark: SparkSession, d: str) -> DataFrame:
    """The nearest earlier vector that is no query itself, as an answered query; its answers count from cosine 0.3 on."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return ranking.nearest_resolved(q, v.filter("vec_id % 20 <> 0"), 0.3)


@query("reuse_report", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 5 = 0), dc AS (SELECT * FROM v WHERE vec_id % 5 > 0),
p AS (SELECT q.vec_id AS query_id, dc.vec_id AS id, round(1 - round(list_distance(q.e, dc.e), 6) * round(list_distance(q.e, dc.e), 6) / 2, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, dc.e), 6), dc.vec_id) AS r FROM q, dc),
own AS (SELECT query_id, id, score FROM p WHERE r <= 10),
rel AS (SELECT q.vec_id AS query_id, q.vec_id + s AS id FROM q, (SELECT unnest([1, 7]) AS s) WHERE q.vec_id + s IN (SELECT vec_id FROM dc)),
n AS (SELECT a.vec_id AS query_id, b.vec_id AS source, round(list_distance(a.e, b.e), 6) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 6), b.vec_id) AS r FROM q a JOIN q b ON b.vec_id < a.vec_id),
pr AS (SELECT query_id, source, round(1 - d * d / 2, 6) AS sim FROM n WHERE r = 1 AND round(1 - d * d / 2, 6) >= 0.3),
al AS (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM own UNION ALL SELECT pr.query_id, rel.id, sim FROM pr JOIN rel ON rel.query_id = pr.source) GROUP BY 1, 2),
b AS (SELECT DISTINCT query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM own) JOIN rel USING (query_id, id) WHERE k <= 3),
u AS (SELECT DISTINCT query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM al) JOIN rel USING (query_id, id) WHERE k <= 3),
x AS (SELECT vec_id IN (SELECT query_id FROM b) AS base, vec_id IN (SELECT query_id FROM u) AS reuse, vec_id IN (SELECT query_id FROM pr) AS used FROM q)
SELECT count(*) AS n, round(avg(CAST(base AS INTEGER)), 6) AS base_recall, round(avg(CAST(reuse AS INTEGER)), 6) AS reuse_recall, count(*) FILTER (reuse AND NOT base) AS rescued, count(*) FILTER (base AND NOT reuse) AS hurt, count(*) FILTER (used) AS used FROM x""")
def reused(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth vector is a query, the others are documents; a query's relevant ones are the first and the seventh after it."""
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q, docs = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v.filter("vec_id % 5 > 0")
    hits = vectors.best(vectors.search(q, docs, vectors.l2, 10), 10).select("query_id", F.col("vec_id").alias("id"), F.round(1 - F.col("distance") * F.col("distance") / 2, 6).alias("score"))
    rel = q.select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 7)).alias("id")).join(docs.select(F.col("vec_id").alias("id")), "id", "left_semi")
    return ranking.reuse_report(q, hits, rel, 0.3, 3)
