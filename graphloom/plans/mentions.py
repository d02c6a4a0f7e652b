"""Queries on mentions and on the credit that peers get for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import mentions

STOP = ", ".join(f"'{w}'" for w in sorted(mentions.PLAIN_WORDS))
#: The registry: every thirtieth word of the benchmark is an alias. Texts end with an address of a page, and of a repository.
MENTIONS = f"""
e AS (SELECT 'part-' || item_id AS id, item_id AS seq, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9._-]+'), lambda w, i: i % 30 = 1) AS aliases FROM benchmark),
al AS (SELECT lower(a) AS norm, arg_min(id, seq) AS known FROM (SELECT id, seq, unnest(aliases) AS a FROM e) GROUP BY 1),
x AS (SELECT d.doc_id AS id, d.text || ' see ' || p.url || ' and https://github.com/Org' || d.doc_id % 9 || '/repo.' || d.doc_id % 4 || ' ok' AS text FROM documents d JOIN pages p ON p.page_id = d.doc_id),
wt AS (SELECT id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9._-]*|[^a-zA-Z]+')) AS t, unnest(range(1, len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9._-]*|[^a-zA-Z]+')) + 1)) AS n FROM x),
wo AS (SELECT id, t, sum(length(t)) OVER (PARTITION BY id ORDER BY n) - length(t) AS start FROM wt),
nt AS (SELECT id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+')) AS t, unnest(range(1, len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+')) + 1)) AS n FROM x),
no AS (SELECT id, t, sum(length(t)) OVER (PARTITION BY id ORDER BY n) - length(t) AS start FROM nt),
ho AS (SELECT id, text, unnest(regexp_extract_all(text, '(?i)https?://[a-z0-9.-]+\\.[a-z]{{2,}}')) AS m FROM x),
re AS (SELECT id, text, unnest(regexp_extract_all(text, 'github\\.com/[a-zA-Z0-9][a-zA-Z0-9_-]*/[a-zA-Z0-9][a-zA-Z0-9._-]*')) AS m FROM x),
c AS (
  SELECT id, 0 AS rank, 'word' AS kind, lower(t) AS surface, start FROM wo WHERE regexp_matches(t, '^[a-zA-Z].')
  UNION ALL SELECT id, 1, 'repo', substr(m, 12), strpos(text, m) + 10 FROM re
  UNION ALL SELECT id, 2, 'url', lower(regexp_extract(m, '://(.*)$', 1)), strpos(text, m) - 1 + strpos(m, '://') + 2 FROM ho
  UNION ALL SELECT id, 3, 'symbol', t, start FROM no WHERE regexp_matches(t, '^[A-Z][a-zA-Z0-9]{{3,39}}$') AND t <> upper(t) AND t NOT IN ({STOP})),
r AS (SELECT c.*, coalesce(e.id, al.known) AS known FROM c LEFT JOIN e ON e.id = c.surface LEFT JOIN al ON al.norm = lower(c.surface)),
k AS (SELECT *, coalesce(known, 'entity:' || kind || ':' || substr(trim(regexp_replace(lower(surface), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64)) AS entity_id FROM r WHERE (rank = 0 AND known IS NOT NULL) OR rank IN (1, 2) OR (rank = 3 AND known IS NULL)),
one AS (SELECT *, row_number() OVER (PARTITION BY id, entity_id ORDER BY start, rank) AS n FROM k)
"""


def registry(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9._-]+"), F.lit(0))
    return b.select(F.concat(F.lit("part-"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("seq"), F.filter(words, lambda w, i: i % 30 == 0).alias("aliases"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    x = read(spark, d, "documents").join(read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    return x.select(i.alias("id"), F.concat("text", F.lit(" see "), "url", F.lit(" and https://github.com/Org"), (i % 9).cast("string"), F.lit("/repo."), (i % 4).cast("string"), F.lit(" ok")).alias("text"))


@query("extract_mentions", f"WITH {MENTIONS} SELECT id, entity_id, kind, surface, CAST(start AS BIGINT) AS start, CAST(start + length(surface) AS BIGINT) AS \"end\" FROM one WHERE n = 1")
def extracted(spark: SparkSession, d: str) -> DataFrame:
    return mentions.extract_mentions(texts(spark, d), registry(spark, d))


@query("hit_mentions", """
SELECT DISTINCT event_id // 12 AS query_id, 'u' || user_id % 60 AS entity_id FROM events JOIN users ON uid = user_id % 60 WHERE event_type <> 'error'""".replace("users", "(SELECT DISTINCT user_id % 60 AS uid FROM events WHERE user_id % 3 > 0)"))
def mentioned(spark: SparkSession, d: str) -> DataFrame:
    e, i, u = read(spark, d, "events"), F.col("event_id"), F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string"))
    edges = e.select(i.alias("source"), u.alias("target"), F.when(F.col("event_type") == "error", "next").otherwise("mentions").alias("relation"))
    return mentions.hit_mentions(e.select(F.floor(i / 12).alias("query_id"), i.alias("id")), edges, e.filter("user_id % 3 > 0").select(u.alias("id")).distinct())


#: Events are matches, ten an ask; each node mentions one entity or two.
CREDITS = """
m AS (SELECT event_id // 10 AS ask_id, event_id % 10 AS position, event_id AS node, CASE WHEN event_id % 3 = 0 THEN 'local' WHEN event_id % 11 <> 0 THEN 'p' || user_id % 7 END AS source_peer, CASE WHEN event_id % 4 = 0 THEN ['p' || event_id % 5, 'local', 'p' || event_id % 9] END AS also FROM events),
g AS (SELECT event_id AS node, 's' || event_id % 6 AS subject FROM events WHERE event_type <> 'error' UNION SELECT event_id, 's' || event_id % 4 FROM events WHERE event_type <> 'error'),
pe AS (SELECT ask_id, node, source_peer AS peer FROM m UNION ALL SELECT ask_id, node, unnest(also) FROM m),
att AS (SELECT DISTINCT ask_id, peer, subject FROM pe JOIN g USING (node) WHERE peer <> 'local'),
src AS (SELECT DISTINCT ask_id, source_peer AS peer FROM m WHERE source_peer <> 'local'),
a AS (SELECT event_id // 10 AS ask_id, max(ts) AS asked_at, 'did:' || CASE WHEN (event_id // 10) % 8 = 0 THEN '' ELSE 'key:' END || event_id // 10 AS reviewer, (event_id // 10) * 37 % 100 / CAST(100 AS DOUBLE) AS satisfaction FROM events GROUP BY ALL)
"""


def credit_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, i = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    also = F.when(i % 4 == 0, F.array(p(i % 5), F.lit("local"), p(i % 9)))
    matches = e.select(F.floor(i / 10).alias("ask_id"), (i % 10).alias("position"), i.alias("node_id"), F.when(i % 3 == 0, "local").when(i % 11 != 0, p(F.col("user_id") % 7)).alias("source_peer"), also.alias("also_from_peers"))
    some = e.filter("event_type <> 'error'")
    edges = [some.select(i.alias("source"), F.concat(F.lit("s"), (i % n).cast("string")).alias("target"), F.lit("mentions").alias("relation")) for n in (6, 4)]
    a = e.groupBy(F.floor(i / 10).alias("ask_id")).agg(F.max("ts").alias("at"))
    reviewer = F.concat(F.lit("did:"), F.when(F.col("ask_id") % 8 == 0, "").otherwise("key:"), F.col("ask_id").cast("string"))
    return a.select("ask_id", "at", reviewer.alias("reviewer"), ((F.col("ask_id") * 37 % 100) / 100).alias("satisfaction")), matches, edges[0].unionByName(edges[1])


@query("attributed_subjects", f"WITH {CREDITS} SELECT * FROM att")
def attributed(spark: SparkSession, d: str) -> DataFrame:
    _, matches, edges = credit_tables(spark, d)
    return mentions.attributed_subjects(matches, edges).drop("place")


@query("review_credits", f"""
WITH {CREDITS} SELECT subject, peer, ask_id, asked_at AS created_at, CASE WHEN s.peer IS NULL THEN 0.4 ELSE 1.0 END::DOUBLE AS weight, satisfaction AS score
FROM att JOIN a USING (ask_id) LEFT JOIN (SELECT ask_id, peer, true AS yes FROM src) s USING (ask_id, peer) WHERE satisfaction >= 0.4 AND regexp_matches(reviewer, '^did:[a-z0-9]+:.+')""".replace("s.peer IS NULL", "s.yes IS NULL"))
def credits(spark: SparkSession, d: str) -> DataFrame:
    return mentions.review_credits(*credit_tables(spark, d), cap=False)


@query("review_credits_capped")
def capped(spark: SparkSession, d: str) -> DataFrame:
    """Each cap depends on all earlier asks, so there is no SQL; test_mentions.py has the plain loop."""
    return mentions.review_credits(*credit_tables(spark, d))
