"""Queries on text, vectors and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import Scratch, read, stored
from graphloom.functions import text as T
from graphloom.operators import evaluation, retrieval

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"
BM25 = f"""
d AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
dd AS (SELECT doc_id, toks, len(toks) AS dl FROM d),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dd),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(toks) AS term FROM dd) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark)),
sc AS (
  SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) CROSS JOIN st GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)
"""


def bench(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("bm25_topk", f"WITH {BM25} SELECT * FROM hits")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(bench(spark, d), read(spark, d, "documents"))


#: A document that holds half of a passage's different five-word runs, and one at least, is relevant to it; the ranking plays no part.
SHINGLES = lambda s: f"list_distinct(list_transform(range(1, greatest(len({s}) - 3, 1)), lambda i: array_to_string({s}[i:i+4], ' ')))"
QRELS = f"""
bw AS (SELECT item_id, unnest({SHINGLES("string_split(text, ' ')")}) AS s FROM benchmark), bn AS (SELECT item_id, count(*) AS m FROM bw GROUP BY 1),
dw AS (SELECT doc_id, unnest({SHINGLES("string_split(text, ' ')")}) AS s FROM documents),
rel AS (SELECT item_id AS query_id, doc_id FROM bw JOIN dw USING (s) JOIN bn USING (item_id) GROUP BY item_id, doc_id, m HAVING 2 * count(*) >= m)
"""


def runs(text: F.Column) -> F.Column:
    """64-bit hashes of a text's different runs of five words, each word hashed once; two runs share one once in 10 to the 19."""
    some = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])))
    words = F.transform(F.split(text, " ", -1), lambda w: F.xxhash64(w))
    return F.array_distinct(F.coalesce(T.once(words, some), F.array().cast("array<long>")))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Runs that no passage holds are dropped before the shuffle where the passages' runs are few enough to be sent to the tasks."""
    b = bench(spark, d).select("query_id", F.explode(runs(F.col("text"))).alias("s"))
    m = b.groupBy("query_id").agg(F.count("*").alias("m"))
    docs = read(spark, d, "documents").select("doc_id", F.explode(runs(F.col("text"))).alias("s"))
    return docs.join(b, "s").groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).join(m, "query_id").filter("2 * n >= m").select("query_id", "doc_id")


METRICS = """
tot AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
hh AS (SELECT h.*, count(*) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM hits h JOIN rel USING (query_id, doc_id)),
per AS (SELECT query_id, count(*) AS n_hit, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first, sum(found / CAST(rank AS DOUBLE)) AS ap FROM hh GROUP BY 1),
metrics AS (SELECT b.item_id AS query_id, round(CASE WHEN n_rel > 0 THEN coalesce(n_hit, 0) / CAST(n_rel AS DOUBLE) ELSE 0 END, 6) AS recall, CASE WHEN n_hit > 0 THEN 1 ELSE 0 END AS recall_any,
  round(CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n_rel) ELSE 0 END, 6) AS ndcg,
  round(coalesce(1.0 / first, 0), 6) AS mrr, round(CASE WHEN n_rel > 0 THEN coalesce(ap, 0) / least(10, n_rel) ELSE 0 END, 6) AS average_precision
FROM benchmark b LEFT JOIN tot ON tot.query_id = b.item_id LEFT JOIN per ON per.query_id = b.item_id)
"""


@query("retrieval_metrics", f"WITH {BM25}, {QRELS}, {METRICS} SELECT * FROM metrics")
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_metrics(bench(spark, d), bm25(spark, d), qrels(spark, d))


@query("eval_report", f"WITH {BM25}, {QRELS}, {METRICS} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(recall_any), 6) AS recall_any, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(average_precision), 6) AS average_precision FROM metrics")
def report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics_report(metrics(spark, d))


AGAIN = re.sub(r"\b(tot|hh|per|metrics|rel)\b(?! \()", r"\g<1>2", METRICS)  # the same statements over the larger judgments


@query("rejudged_ndcg", f"""
WITH {BM25}, {QRELS}, {METRICS}, judged AS (SELECT query_id, doc_id, doc_id % 4 = 0 AS positive FROM hits WHERE doc_id % 3 > 0 AND (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM rel)),
rel2 AS (SELECT query_id, doc_id FROM rel UNION SELECT query_id, doc_id FROM judged WHERE positive), {AGAIN}
SELECT a.ndcg, b.ndcg AS ndcg_rejudged, round(b.ndcg - a.ndcg, 6) AS gain, j.n AS new_positives, j.rate AS false_negative_rate FROM (SELECT round(avg(ndcg), 6) AS ndcg FROM metrics) a, (SELECT round(avg(ndcg), 6) AS ndcg FROM metrics2) b, (SELECT count(*) FILTER (positive) AS n, round(count(*) FILTER (positive) / CAST(count(*) AS DOUBLE), 6) AS rate FROM judged) j""")
def rejudged(spark: SparkSession, d: str) -> DataFrame:
    """A judge that has read two of three hits and takes every fourth document."""
    with Scratch(spark) as keep:
        hits = keep(bm25(spark, d))
        judged = hits.filter("doc_id % 3 > 0").select("query_id", "doc_id", (F.col("doc_id") % 4 == 0).alias("positive"))
        return stored(evaluation.rejudged_ndcg(bench(spark, d), hits, keep(qrels(spark, d)), judged))


@query("fts_query", f"SELECT item_id, CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' OR ') END AS match FROM (SELECT item_id, {TOKENS} AS toks FROM benchmark)")
def fts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", T.fts_query(F.col("text")).alias("match"))


@query("token_jaccard", """
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 2)) AS k FROM documents),
n AS (SELECT a.doc_id, a.k AS x, b.k AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) END, 6) AS jaccard FROM n""")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.transform(T.jaccard_tokens(F.col("text")), lambda t: F.xxhash64(t))  # 8 bytes a token are shuffled, not the words
    t = read(spark, d, "documents").select("doc_id", hashed.alias("k"))
    n = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("other"))
    return t.join(n, "doc_id").select("doc_id", F.round(T.token_jaccard(F.col("k"), F.col("other")), 6).alias("jaccard"))


@query("strip_html", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS text FROM pages""")
def html(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("content_sha256", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.content_sha256(F.col("text")).alias("digest"))


VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.e, b.e), 6) AS distance, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id % 20 = 0)"
DENSE = f"{VECTORS}, dense AS (SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10)"


@query("dense_topk", f"WITH {DENSE} SELECT * FROM dense")
def dense(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return retrieval.dense_topk(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v)


@query("rrf_fuse", f"""
WITH {DENSE},
x AS (SELECT query_id, vec_id AS id, rank - 1 AS dense_rank, distance FROM dense),
y AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id * 7919) % 1009, vec_id) - 1 AS sparse_rank FROM dense WHERE rank > 3),
z AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, dense_rank, sparse_rank, coalesce(distance, 0) AS distance, round(coalesce(1.0 / (61 + dense_rank), 0) + coalesce(1.0 / (61 + sparse_rank), 0), 9) AS score FROM x FULL JOIN y ON x.query_id = y.query_id AND x.id = y.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS position FROM z""")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    hits = dense(spark, d)
    first = hits.select("query_id", F.col("vec_id").alias("id"), (F.col("rank") - 1).alias("rank"), "distance")
    w = Window.partitionBy("query_id").orderBy((F.col("id") * 7919) % 1009, "id")
    second = first.filter("rank >= 3").withColumn("rank", F.row_number().over(w) - 1)
    return retrieval.rrf_fuse(first, second)


@query("recency_rerank", f"""
WITH {DENSE},
h AS (SELECT query_id, vec_id AS id, rank, distance, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id % 40 AS DOUBLE) END AS age_days FROM dense),
s AS (SELECT *, round(1 / (1 + distance), 9) AS relevance, round(CASE WHEN age_days IS NULL THEN 1 ELSE pow(0.5, age_days / 14) END, 9) AS decay, round(1 / (1 + distance) * CASE WHEN age_days IS NULL THEN 1 ELSE pow(0.5, age_days / 14) END, 9) AS combined FROM h)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS position FROM s""")
def recency(spark: SparkSession, d: str) -> DataFrame:
    hits = dense(spark, d).withColumnRenamed("vec_id", "id")
    return retrieval.recency_rerank(hits.withColumn("age_days", F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 40).cast("double"))))


@query("energy_gate", f"""
WITH {DENSE}, s AS (SELECT query_id, 1 - distance * distance / 2 AS sim FROM dense WHERE query_id <> vec_id AND query_id % 40 = 0),
g AS (SELECT query_id, count(*) AS n, max(sim) AS m, list_sort(list(sim), 'DESC') AS best FROM s GROUP BY 1),
e AS (SELECT query_id, n, round(-(m + 0.1 * ln(list_sum(list_transform(best, lambda x: exp((x - m) / 0.1))))), 6) AS free_energy, round(CASE WHEN n >= 2 THEN best[1] - best[2] ELSE 0 END, 6) AS separation FROM g)
SELECT q.vec_id AS query_id, coalesce(n, 0) AS n, coalesce(free_energy, CAST('Infinity' AS DOUBLE)) AS free_energy, coalesce(separation, 0) AS separation, CASE WHEN n >= 2 THEN round(ln(2 * (n - 1) * n * 12) / 12, 6) END AS floor,
  coalesce(n >= 2 AND -free_energy >= -0.016 AND separation >= 0.01, false) AS admit FROM embeddings q LEFT JOIN e ON e.query_id = q.vec_id WHERE q.vec_id % 20 = 0""")
def energy(spark: SparkSession, d: str) -> DataFrame:
    """Half of the queries have no hit here."""
    hits = dense(spark, d)
    s = hits.filter("query_id <> vec_id and query_id % 40 = 0").select("query_id", (1 - F.col("distance") * F.col("distance") / 2).alias("sim"))
    return retrieval.energy_gate(read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), s)


SCORED = "s AS (SELECT d.n_chars AS score, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("toxic").alias("label"))


@query("auc", f"""
WITH {SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY 1),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM b""")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(scored(spark, d))


@query("youden_sweep", f"""
WITH {SCORED}, e AS (SELECT CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM s),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + (hi - lo) / 40 * i AS th, p, n FROM e, range(0, 41) r(i)),
c AS (SELECT g.i, g.th, p, n, count(*) FILTER (label = 1 AND score >= th) AS t, count(*) FILTER (label = 0 AND score >= th) AS f FROM g, s GROUP BY ALL)
SELECT i, round(th, 6) AS threshold, round(t / CAST(p AS DOUBLE), 6) AS tpr, round(f / CAST(n AS DOUBLE), 6) AS fpr, round(t / CAST(p AS DOUBLE) - f / CAST(n AS DOUBLE), 6) AS youden, i = first_value(i) OVER (ORDER BY round(t / CAST(p AS DOUBLE) - f / CAST(n AS DOUBLE), 6) DESC, i) AS best FROM c""")
def youden(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.youden_sweep(scored(spark, d))


@query("cohen_kappa", """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels),
k AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / CAST((tp + fp + fn + tn) * (tp + fp + fn + tn) AS DOUBLE) AS pe FROM c)
SELECT n, round((po - pe) / (1 - pe), 6) AS kappa, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall FROM k""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.cohen_kappa(read(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


@query("learn_weights", """
WITH s AS (SELECT quality AS satisfied, CAST(n_chars AS DOUBLE) / 1000 AS length, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / n_chars AS spaces, CAST(toxic AS DOUBLE) AS toxic FROM documents JOIN labels USING (doc_id)),
l AS (SELECT satisfied, 'length' AS part, length AS value FROM s UNION ALL SELECT satisfied, 'spaces', spaces FROM s UNION ALL SELECT satisfied, 'toxic', toxic FROM s),
g AS (SELECT part, avg(value) FILTER (satisfied = 1) AS m1, avg(value) FILTER (satisfied = 0) AS m0, var_pop(value) FILTER (satisfied = 1) AS v1, var_pop(value) FILTER (satisfied = 0) AS v0 FROM l WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT part, coalesce(pow(m1 - m0, 2) / (v1 + v0 + 1e-6), 0) AS ratio FROM g),
w AS (SELECT part, ratio, ratio / sum(ratio) OVER () + 0.02 AS raw FROM r)
SELECT part, round(ratio, 6) AS ratio, round(raw / sum(raw) OVER (), 6) AS weight, CAST(NULL AS VARCHAR) AS reason FROM w""")
def weights(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    spaces = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))) / F.col("n_chars")
    return evaluation.learn_weights(s.select(F.col("quality").alias("satisfied"), (F.col("n_chars") / 1000).alias("length"), spaces.alias("spaces"), "toxic"), ["length", "spaces", "toxic"])
