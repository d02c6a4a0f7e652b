"""Queries on reports over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import reports
from graphloom.operators.logs import seconds


@query("index_health", r"""
WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN left(trim(regexp_replace(left(text, 30), '\s+', ' ', 'g')), 12) || ' [chunk 1/3]' ELSE 'no such title' END AS label, CASE WHEN doc_id % 4 > 0 THEN 'zz:' || doc_id ELSE source END AS uri FROM documents WHERE doc_id % 3 > 0),
v AS (SELECT e.vec_id, e.vec_id AS id, CASE WHEN e.vec_id % 7 > 0 THEN text || ' ' || source END AS raw, CAST(embedding AS DOUBLE[]) AS e FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
j AS (SELECT v.*, n.label, n.uri, n.id IS NOT NULL AS known, lower(left(trim(regexp_replace(coalesce(n.label, ''), '(?i)\s*\[chunk\s+\d+/\d+\]\s*$', '')), 48)) AS title FROM v LEFT JOIN n USING (id)),
g AS (SELECT count(*) AS rows, count(*) FILTER (known) AS rows_with_node, count(*) FILTER (length(raw) > 0) AS rows_with_text, count(*) FILTER (length(raw) > 0 AND title <> '' AND contains(lower(raw), title)) AS titled, count(*) FILTER (length(raw) > 0 AND uri <> '' AND contains(raw, uri)) AS addressed, count(DISTINCT CASE WHEN known THEN id END) AS nodes_with_vector FROM j),
q AS (SELECT vec_id, e FROM v WHERE length(raw) > 0 AND vec_id % 10 = 1),
r AS (SELECT q.vec_id, count(*) AS rank FROM q JOIN v ON round(list_distance(q.e, v.e), 6) < 0 OR (round(list_distance(q.e, v.e), 6) = 0 AND v.vec_id <= q.vec_id) GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS nodes, rows, rows_with_node, rows_with_text, nodes_with_vector, round(rows_with_text / CAST(rows AS DOUBLE), 6) AS text_coverage, round(nodes_with_vector / CAST((SELECT count(*) FROM n) AS DOUBLE), 6) AS vector_coverage, round(titled / CAST(rows_with_text AS DOUBLE), 6) AS title_rate, round(addressed / CAST(rows_with_text AS DOUBLE), 6) AS uri_rate,
  (SELECT count(*) FROM q) AS asked, round((SELECT avg(CAST(rank <= 1 AS INTEGER)) FROM r), 6) AS self_at_1, round((SELECT avg(CAST(rank <= 5 AS INTEGER)) FROM r), 6) AS self_at_5, round((SELECT avg(CAST(rank <= 10 AS INTEGER)) FROM r), 6) AS self_at_10 FROM g""")
def health(spark: SparkSession, d: str) -> DataFrame:
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    label = F.when(i % 5 > 0, F.concat(F.substring(F.trim(F.regexp_replace(F.substring("text", 1, 30), r"\s+", " ")), 1, 12), F.lit(" [chunk 1/3]"))).otherwise("no such title")
    n = docs.filter(i % 3 > 0).select(i.alias("id"), label.alias("label"), F.when(i % 4 > 0, F.concat(F.lit("zz:"), i.cast("string"))).otherwise(F.col("source")).alias("source_uri"))
    v = read(spark, d, "embeddings").join(docs, F.col("vec_id") == i).select("vec_id", F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 > 0, F.concat("text", F.lit(" "), "source")).alias("raw_text"), F.col("embedding").alias("vector"))
    return reports.index_health(n, v, F.col("vec_id") % 10 == 1)


@query("workspace_snapshot", """
WITH n AS (SELECT event_id AS id, CASE WHEN event_id % 6 > 0 THEN 'w' || user_id % 7 END AS workspace, CASE WHEN event_id % 10 = 0 THEN 'session://' || event_id ELSE 'x' END AS uri, CASE WHEN event_id % 9 = 0 THEN 'peer:' || user_id WHEN event_id % 3 > 0 THEN 'f' || event_id END AS file, CASE WHEN event_id % 13 > 0 THEN ts END AS at_ FROM events),
t AS (SELECT count(*) AS nodes, count(DISTINCT coalesce(workspace, '(unassigned)')) AS workspaces, count(*) FILTER (file LIKE 'peer:%' AND at_ >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY) AS arrivals FROM n),
w AS (SELECT coalesce(workspace, '(unassigned)') AS name, count(*) AS n FROM n GROUP BY 1)
SELECT 'total' AS part, 0 AS place, 'nodes' AS name, nodes AS n FROM t UNION ALL SELECT 'total', 1, 'workspaces', workspaces FROM t UNION ALL SELECT 'total', 2, 'arrivals', arrivals FROM t
UNION ALL SELECT 'workspace', CAST(r AS INTEGER), name, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, name) - 1 AS r FROM w) WHERE r < 5
UNION ALL SELECT 'node', CAST(r AS INTEGER), CAST(id AS VARCHAR), NULL FROM (SELECT *, row_number() OVER (ORDER BY at_ DESC NULLS LAST, id) - 1 AS r FROM n) WHERE r < 15
UNION ALL SELECT 'session', CAST(r AS INTEGER), coalesce(file, CAST(id AS VARCHAR)), NULL FROM (SELECT *, row_number() OVER (ORDER BY at_ DESC NULLS LAST, id) - 1 AS r FROM n WHERE uri LIKE 'session://%') WHERE r < 5""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    e, i = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    file = F.when(i % 9 == 0, named("peer:", F.col("user_id"))).when(i % 3 > 0, named("f", i))
    n = e.select(i.alias("id"), F.lit("l").alias("label"), F.when(i % 6 > 0, named("w", F.col("user_id") % 7)).alias("workspace"), F.when(i % 10 == 0, named("session://", i)).otherwise("x").alias("source_uri"), file.alias("source_file"), F.when(i % 13 > 0, F.col("ts")).alias("fetched_at"))
    return reports.workspace_snapshot(n, F.lit("2024-01-25").cast("timestamp"))


@query("answer_list", "SELECT event_id // 9 AS question_id, event_id AS answer_id, row_number() OVER (PARTITION BY event_id // 9 ORDER BY CASE WHEN event_id % 4 > 0 THEN event_id % 5 / CAST(5 AS DOUBLE) ELSE -1 END DESC, CASE WHEN event_id % 7 > 0 THEN ts END DESC NULLS LAST, event_id) AS place FROM events")
def answers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    a = read(spark, d, "events").select(F.floor(i / 9).alias("question_id"), i.alias("answer_id"), F.when(i % 4 > 0, (i % 5) / 5).alias("confidence"), F.when(i % 7 > 0, F.col("ts")).alias("fetched_at"))
    return reports.answer_list(a).select("question_id", "answer_id", "place")


CODE = "c AS (SELECT p_partkey AS id, 'cb' || p_partkey % 3 AS codebase_id, CASE p_partkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'load_' ELSE 'loads' END || p_partkey AS name, 'src/' || p_partkey % 20 || '.ts' AS file_path, p_partkey % 50 AS start_line, CASE WHEN p_partkey % 6 = 0 THEN 'python' ELSE 'typescript' END AS language FROM part)"


def code(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind = F.when(k % 4 == 0, "file").when(k % 4 == 1, "class").otherwise("function")
    name = F.concat(F.when(k % 5 == 0, "load_").otherwise("loads"), s)
    return read(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("cb"), (k % 3).cast("string")).alias("codebase_id"), kind.alias("kind"), name.alias("name"), F.concat(F.lit("src/"), (k % 20).cast("string"), F.lit(".ts")).alias("file_path"), (k % 50).alias("start_line"), F.when(k % 6 == 0, "python").otherwise("typescript").alias("language"),
    )


@query("code_search", rf"WITH {CODE} SELECT id, name FROM c WHERE codebase_id = 'cb1' AND kind = 'function' AND name LIKE '%load\_%' ESCAPE '\' ORDER BY file_path, start_line, id LIMIT 20")
def searched(spark: SparkSession, d: str) -> DataFrame:
    return reports.code_search(code(spark, d), "cb1", "function", r"%load\_%", 20).select("id", "name")


@query("code_upsert", f"""WITH {CODE}, n AS (SELECT id + 50 AS id, 'cbx' AS codebase_id, 'method' AS kind, upper(name) AS name, file_path, start_line + 1 AS start_line, 'rust' AS language FROM c)
SELECT coalesce(n.id, c.id) AS id, coalesce(c.codebase_id, n.codebase_id) AS codebase_id, coalesce(c.kind, n.kind) AS kind, coalesce(n.name, c.name) AS name, coalesce(n.file_path, c.file_path) AS file_path, coalesce(n.start_line, c.start_line) AS start_line, coalesce(c.language, n.language) AS language FROM c FULL JOIN n ON n.id = c.id""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d)
    n = c.select((F.col("id") + 50).alias("id"), F.lit("cbx").alias("codebase_id"), F.lit("method").alias("kind"), F.upper("name").alias("name"), "file_path", (F.col("start_line") + 1).alias("start_line"), F.lit("rust").alias("language"))
    return reports.code_upsert(c, n)


@query("codebase_summary", f"""WITH {CODE}, k AS (SELECT codebase_id, string_agg(kind || ':' || n, ', ' ORDER BY kind) AS by_kind FROM (SELECT codebase_id, kind, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1),
l AS (SELECT codebase_id, string_agg(language || ':' || n, ', ' ORDER BY language) AS by_language FROM (SELECT codebase_id, language, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1),
q AS (SELECT 'cb' || event_id % 3 AS codebase_id, CASE event_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'unresolved' ELSE 'heuristic' END AS confidence FROM events),
r AS (SELECT codebase_id, string_agg(confidence || ':' || n, ', ' ORDER BY confidence) AS by_confidence FROM (SELECT codebase_id, confidence, count(*) AS n FROM q GROUP BY ALL) GROUP BY 1),
f AS (SELECT 'cb' || doc_id % 3 AS codebase_id, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS root_sha FROM documents GROUP BY 1), t AS (SELECT codebase_id, count(*) AS n_nodes FROM c GROUP BY 1)
SELECT * FROM t LEFT JOIN k USING (codebase_id) LEFT JOIN l USING (codebase_id) LEFT JOIN r USING (codebase_id) LEFT JOIN f USING (codebase_id)""")
def summarised(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    of = lambda c: F.concat(F.lit("cb"), (c % 3).cast("string")).alias("codebase_id")
    calls = read(spark, d, "events").select(of(i), F.when(i % 5 == 0, "exact").when(i % 5 == 1, "unresolved").otherwise("heuristic").alias("confidence"))
    files = read(spark, d, "documents").select(of(F.col("doc_id")), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.sha2("text", 256).alias("digest"))
    return reports.codebase_summary(code(spark, d), calls, files)


@query("coalesce_jobs", """
WITH RECURSIVE j AS (SELECT event_id AS id, event_type AS kind, user_id % 3 AS payload, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 40 > 0 THEN epoch_us(ts) / 1e6 + 40000 + event_id % 7 * 9000 END AS started FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, payload ORDER BY t, id) AS n FROM j),
f AS (SELECT kind, payload, n, id, id AS into_, started FROM r WHERE n = 1
  UNION ALL SELECT r.kind, r.payload, r.n, r.id, CASE WHEN r.kind = 'error' OR f.started <= r.t THEN r.id ELSE f.into_ END, CASE WHEN r.kind = 'error' OR f.started <= r.t THEN r.started ELSE f.started END FROM f JOIN r ON r.kind = f.kind AND r.payload = f.payload AND r.n = f.n + 1)
SELECT id, into_ AS "into" FROM f""")
def jobs(spark: SparkSession, d: str) -> DataFrame:
    e, i, t = read(spark, d, "events"), F.col("event_id"), seconds(F.col("ts"))
    j = e.select(i.alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("payload"), t.alias("at"), F.when(i % 40 > 0, t + 40_000 + i % 7 * 9_000).alias("started_at"))
    kinds = [r["kind"] for r in j.select("kind").distinct().collect() if r["kind"] != "error"]  # a few kinds
    return reports.coalesce_jobs(j, kinds)


@query("block_secrets", """
SELECT doc_id, kind, CASE WHEN hit THEN '[BLOCKED: github-token]' ELSE summary END AS summary, hit AS blocked FROM (SELECT *, kind <> 'user' AND doc_id % 5 < 2 AS hit FROM
  (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS kind, left(lang || ' ' || source, 40) || CASE WHEN doc_id % 5 = 0 THEN ' ghp_' || repeat('a', 36) ELSE '' END AS summary FROM documents))""")
def blocked(spark: SparkSession, d: str) -> DataFrame:
    """Of every five entries one holds a token in its summary and one in its label; user entries are not looked at."""
    i, token = F.col("doc_id"), "ghp_" + "a" * 36
    said = F.concat(F.substring(F.concat_ws(" ", "lang", "source"), 1, 40), F.when(i % 5 == 0, f" {token}").otherwise(""))
    e = read(spark, d, "documents").select("doc_id", i.alias("id"), F.when(i % 3 == 0, "user").otherwise("assistant").alias("kind"), F.when(i % 5 == 1, token).otherwise("label").alias("label"), said.alias("summary"))
    return reports.block_secrets(e, scan_user=False).select("doc_id", "kind", "summary", "blocked")


@query("receipts_to_samples", """
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'good_skip' WHEN 1 THEN 'bad_skip' WHEN 2 THEN 'good_search' ELSE 'unlabelled' END AS outcome, event_id % 3 > 0 AS a, event_id % 5 > 2 AS b FROM events)
SELECT event_id, outcome <> 'bad_skip' AS satisfied, concat_ws(',', CASE WHEN a THEN 'fresh=' || event_id % 10 END, CASE WHEN b THEN 'trust=' || event_id % 7 END) AS parts FROM r WHERE outcome <> 'unlabelled' AND (a OR b)""")
def samples(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    part = lambda n, v, s: F.struct(F.lit(n).alias("name"), v.cast("int").alias("value"), s.alias("observed"))
    r = read(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("good_skip", "bad_skip", "good_search", "unlabelled"))), (i % 4 + 1).cast("int")).alias("outcome"), F.array(part("fresh", i % 10, i % 3 > 0), part("trust", i % 7, i % 5 > 2)).alias("components"))
    flat = F.array_join(F.transform(F.map_entries("parts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return reports.receipts_to_samples(r).select("event_id", "satisfied", flat.alias("parts"))


@query("composite_score", """
WITH w AS (SELECT i AS dimension, [0.25, 0.15, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05][i + 1] AS weight FROM range(0, 9) t(i))
SELECT user_id AS run, round(sum(CASE WHEN event_id % 8 > 0 THEN greatest(0, least(1, value / 100 - 0.2)) ELSE 0 END * coalesce(weight, 0)), 6) AS composite FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS dimension FROM events) LEFT JOIN w USING (dimension) WHERE dimension < 10 GROUP BY 1""")
def composite(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first ten events are the dimensions of a run; some did not run, one has no weight."""
    from pyspark.sql import Window

    e = read(spark, d, "events").withColumn("dimension", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).filter("dimension < 10")
    w = spark.range(9).select(F.col("id").cast("int").alias("dimension"), F.element_at(F.array(*map(F.lit, (0.25, 0.15, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05))), (F.col("id") + 1).cast("int")).alias("weight"))
    return reports.composite_score(e.select(F.col("user_id").alias("run"), "dimension", F.when(F.col("event_id") % 8 > 0, F.col("value") / 100 - 0.2).alias("value")), w)
