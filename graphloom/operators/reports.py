"""Reports and look-ups over the store: health, snapshot, code, answers, queued jobs, blocked entries, training samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import SECRETS
from graphloom.operators.folds import folded
from graphloom.operators.vectors import best, l2, search


def index_health(nodes: DataFrame, vectors: DataFrame, asked: Column | None = None) -> DataFrame:
    """nodes(id, label, source_uri), vectors(vec_id, id, raw_text, vector) -> one row: how well vectors, texts and nodes go together.

    Titles count by their first 48 characters, without a chunk mark. With asked (a condition on vec_id) also the share
    of those vectors that a search for themselves finds among the first 1, 5 and 10, themselves first among equals.
    """
    n = nodes.select("id", "label", "source_uri").dropDuplicates(["id"]).withColumn("known", F.lit(True))
    v = vectors.select("vec_id", "id", "raw_text").join(n, "id", "left")
    raw = F.coalesce(F.length("raw_text"), F.lit(0)) > 0
    title = F.lower(F.substring(F.trim(F.regexp_replace(F.coalesce("label", F.lit("")), r"(?i)\s*\[chunk\s+\d+/\d+\]\s*$", "")), 1, 48))
    uri = F.coalesce("source_uri", F.lit(""))
    g = v.agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce("known", F.lit(False))).alias("rows_with_node"), F.count_if(raw).alias("rows_with_text"), F.count_if(raw & (title != "") & F.contains(F.lower("raw_text"), title)).alias("titled"),
        F.count_if(raw & (uri != "") & F.contains("raw_text", uri)).alias("addressed"), F.count_distinct(F.when(F.col("known"), F.col("id"))).alias("nodes_with_vector"),
    )
    g = g.withColumn("one", F.lit(1)).join(F.broadcast(n.agg(F.count("*").alias("nodes")).withColumn("one", F.lit(1))), "one")  # one row each
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    out = g.select(
        "one", "nodes", "rows", "rows_with_node", "rows_with_text", "nodes_with_vector", share("rows_with_text", "rows").alias("text_coverage"), share("nodes_with_vector", "nodes").alias("vector_coverage"),
        share("titled", "rows_with_text").alias("title_rate"), share("addressed", "rows_with_text").alias("uri_rate"),
    )
    if asked is not None:
        q = vectors.filter(raw & asked).select(F.col("vec_id").alias("query_id"), "vector")
        mine = best(search(q, vectors.select("vec_id", "vector"), l2, 10), 10).filter("query_id = vec_id")
        found = q.select("query_id").join(mine.select("query_id", "rank"), "query_id", "left")
        at = lambda k: F.round(F.coalesce(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), F.lit(0.0)), 6).alias(f"self_at_{k}")
        out = out.join(F.broadcast(found.agg(F.count("*").alias("asked"), at(1), at(5), at(10)).withColumn("one", F.lit(1))), "one")  # one row
    return out.drop("one")


def workspace_snapshot(nodes: DataFrame, now: Column, recent: int = 15, workspaces: int = 5, sessions: int = 5, prefix: str = "session://", days: int = 7) -> DataFrame:
    """nodes(id, label, workspace, source_uri, source_file, fetched_at) -> part, place, name, n: totals, largest workspaces, newest nodes and sessions, arrivals from peers.

    Ties go by name; undated rows come last.
    """
    ws = F.coalesce("workspace", F.lit("(unassigned)"))
    row = lambda df, part, place, name, n: df.select(F.lit(part).alias("part"), place.cast("int").alias("place"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    peer = F.rlike(F.coalesce("source_file", F.lit("")), F.lit("^(?:peer|p2p):")) & (F.col("fetched_at") >= now - F.make_interval(days=F.lit(days)))
    totals = nodes.agg(F.count("*").alias("nodes"), F.count_distinct(ws).alias("workspaces"), F.count_if(F.coalesce(peer, F.lit(False))).alias("arrivals"))
    three = totals.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(("nodes", "workspaces", "arrivals"))])))
    largest = nodes.groupBy(ws.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(workspaces)
    newest = nodes.orderBy(F.desc_nulls_last("fetched_at"), "id").limit(recent)
    held = F.startswith(F.coalesce("source_uri", F.lit("")), F.lit(prefix)) | F.startswith(F.col("id").cast("string"), F.lit(prefix))
    last = nodes.filter(held).orderBy(F.desc_nulls_last("fetched_at"), "id").limit(sessions)
    rank = lambda *order: F.row_number().over(Window.orderBy(*order)) - 1  # noqa: E731  over a few rows
    parts = [row(three, "total", F.col("place"), F.col("name"), F.col("n")), row(largest, "workspace", rank(F.desc("n"), F.asc("name")), F.col("name"), F.col("n")), row(newest, "node", rank(F.desc_nulls_last("fetched_at"), F.asc("id")), F.col("id"), F.lit(None))]
    parts.append(row(last, "session", rank(F.desc_nulls_last("fetched_at"), F.asc("id")), F.coalesce("source_file", F.col("id").cast("string")), F.lit(None)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer_list(answers: DataFrame) -> DataFrame:
    """answers(question_id, answer_id, confidence, fetched_at) -> with place in its question: highest confidence (none counts as -1), then newest, then id."""
    w = Window.partitionBy("question_id").orderBy(F.desc(F.coalesce("confidence", F.lit(-1.0))), F.desc_nulls_last("fetched_at"), "answer_id")
    return answers.withColumn("place", F.row_number().over(w))


def code_search(nodes: DataFrame, codebase: str | None = None, kind: str | None = None, pattern: str | None = None, limit: int = 50) -> DataFrame:
    """Code nodes by codebase, kind and LIKE pattern of the name (`\\` escapes), by file and line; 1 to 500 of them."""
    x = nodes
    for c, v in (("codebase_id", codebase), ("kind", kind)):
        x = x if v is None else x.filter(F.col(c) == v)
    x = x if pattern is None else x.filter(F.like("name", F.lit(pattern), F.lit("\\")))
    return x.orderBy("file_path", "start_line", "id").limit(max(1, min(limit, 500)))


def code_upsert(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("codebase_id", "kind", "language")) -> DataFrame:
    """Code rows by id: a new row replaces what an index run may change; `kept` columns stay as first written. One new row an id."""
    o, n = old.alias("o"), new.alias("n")
    x = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    return x.select(*[F.when(F.col("n.id").isNull() if c not in kept else F.col("o.id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns])


def delete_codebase(nodes: DataFrame, edges: DataFrame, codebase: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a codebase."""
    rest = lambda df: df.filter(~F.col("codebase_id").eqNullSafe(F.lit(codebase)))
    return rest(nodes), rest(edges)


def codebase_summary(nodes: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """nodes(codebase_id, kind, language), calls(codebase_id, confidence), files(codebase_id, path, digest) -> per codebase counts as maps, and the root digest over file digests by path."""
    count = lambda df, c: df.groupBy("codebase_id", c).agg(F.count("*").alias("n")).groupBy("codebase_id").agg(F.array_sort(F.collect_list(F.struct(c, "n"))).alias("xs")).select("codebase_id", F.array_join(F.transform("xs", lambda x: F.concat_ws(":", x[c], x["n"].cast("string"))), ", ").alias(f"by_{c}"))
    total = nodes.groupBy("codebase_id").agg(F.count("*").alias("n_nodes"))
    # one short digest for each file of a codebase
    root = files.groupBy("codebase_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda f: f["digest"]), "\n"), 256).alias("root_sha"))
    out = total
    for part in (count(nodes, "kind"), count(nodes, "language"), count(calls, "confidence"), root):
        out = out.join(part, "codebase_id", "left")
    return out


def coalesce_jobs(jobs: DataFrame, kinds: list[str]) -> DataFrame:
    """jobs(id, kind, payload, at, started_at), seconds -> id, into: the job that a submission falls together with, itself where it is queued anew.

    A submission of one of the kinds joins the earlier one with the same payload that is still queued (it starts later, or never).
    """

    def step(state: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        into = []
        for ident, at, started, able in zip(*[b.column(c).to_pylist() for c in ("id", "at", "started_at", "able")], strict=True):
            if not able or "id" not in state or (state["until"] is not None and state["until"] <= at):
                state["id"], state["until"] = ident, started
            into.append(state["id"])
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(into, b.column("id").type)], ["id", "into"])

    kind = jobs.schema["id"].dataType.simpleString()
    rows = jobs.select("kind", F.sha2("payload", 256).alias("digest"), "id", F.col("at").cast("double").alias("at"), F.col("started_at").cast("double").alias("started_at"), F.col("kind").isin(kinds).alias("able"))
    return folded(rows, ["kind", "digest"], ["at", "id"], dict, step, f"id {kind}, into {kind}")


def block_secrets(entries: DataFrame, scan_user: bool = True, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """entries(kind, id, label, summary) -> with summary replaced by `[BLOCKED: name]` and blocked set where a secret format matches.

    The summary's first format in order decides, else the first one of id or label; user entries are looked at where scan_user is set.
    """
    named = [*SECRETS, *(extra or [])]
    first = lambda c: F.coalesce(*[F.when(F.rlike(c, F.lit(p)), F.lit(n)) for n, p in named])
    every = "|".join(f"(?:{p})" for _, p in named)
    outside = F.concat_ws("\n", F.col("id").cast("string"), "label")
    whole = F.concat_ws("\n", F.col("summary"), outside)
    hit = F.when(F.rlike(whole, F.lit(every)), F.coalesce(first(F.col("summary")), first(outside)))
    hit = hit if scan_user else F.when(F.col("kind") != "user", hit)
    x = entries.withColumn("hit_", hit)
    return x.withColumn("summary", F.when(F.col("hit_").isNotNull(), F.concat(F.lit("[BLOCKED: "), "hit_", F.lit("]"))).otherwise(F.col("summary"))).withColumn("blocked", F.col("hit_").isNotNull()).drop("hit_")


def receipts_to_samples(receipts: DataFrame) -> DataFrame:
    """receipts(outcome, components array<struct<name, value, observed>>) -> satisfied, parts: training rows.

    Good skips and good searches were satisfied, bad skips not; receipts without a label or without an observed part say nothing.
    """
    satisfied = F.when(F.col("outcome").isin("good_skip", "good_search"), True).when(F.col("outcome") == "bad_skip", False)
    seen = F.filter("components", lambda c: F.coalesce(c["observed"], F.lit(False)))
    parts = F.map_from_entries(F.transform(seen, lambda c: F.struct(c["name"], c["value"])))
    return receipts.filter(satisfied.isNotNull() & (F.size(seen) > 0)).withColumns({"satisfied": satisfied, "parts": parts}).drop("outcome", "components")


def composite_score(dims: DataFrame, weights: DataFrame) -> DataFrame:
    """dims(run, dimension, value), weights(dimension, weight) -> run, composite: weighted sum of the values within 0 and 1; what did not run adds nothing."""
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value")))).otherwise(0.0)
    return dims.join(weights, "dimension", "left").groupBy("run").agg(F.round(F.sum(v * F.coalesce("weight", F.lit(0.0))), 6).alias("composite"))
