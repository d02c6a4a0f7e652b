"""Event logs: buckets, caches, half-lives, snapshots, sessions, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.folds import ttl_hits
from graphloom.operators.telemetry import micros


def ttl_replay(requests: DataFrame, ttl: float) -> DataFrame:
    """requests(key, t seconds) -> hits, misses, hit_rate of a cache whose entries live ttl seconds from their miss."""
    a = ttl_hits(requests.filter("key is not null"), ttl).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
    return a.select("hits", (F.col("n") - F.col("hits")).alias("misses"), F.round(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), 6).alias("hit_rate"))


def propagation_half_life(learned: DataFrame, peers: int) -> DataFrame:
    """learned(doc, peer, t, source web or federation) -> docs that reached half of the peers after their first web learn, those that did not, median time."""
    start = learned.filter("source = 'web'").groupBy("doc").agg(F.min(F.struct("t", "peer")).alias("s")).select("doc", F.col("s.t").alias("t0"), F.col("s.peer").alias("first"))
    later = learned.filter("source = 'federation'").join(start, "doc").filter("t >= t0 and peer <> first").groupBy("doc", "peer", "t0").agg(F.min("t").alias("t"))
    every = later.select("doc", "t0", "t").unionByName(start.select("doc", "t0", F.col("t0").alias("t")))
    n = every.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("t")))
    reached = n.filter(F.col("k") >= -(-peers // 2)).groupBy("doc").agg(F.min(F.col("t") - F.col("t0")).alias("took"))
    x = start.join(reached, "doc", "left")
    return x.agg(F.count("took").alias("reached"), F.count_if(F.col("took").isNull()).alias("never"), F.coalesce(F.median("took"), F.lit(float("inf"))).alias("half_life"))


def metric_snapshot(samples: DataFrame, last: int = 1024) -> DataFrame:
    """samples(name, seq, value) -> per name count of all, and mean, min, max, p50, p95 of the last few."""
    w = Window.partitionBy("name")
    x = samples.withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).filter(F.col("back") <= last)
    n = samples.groupBy("name").agg(F.count("*").alias("count"))
    g = x.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"))
    at = lambda p: F.element_at("v", (F.least(F.size("v") - 1, F.floor(F.size("v") * p)) + 1).cast("int"))
    return n.join(g, "name").select("name", "count", F.round("mean", 6).alias("mean"), F.element_at("v", 1).alias("min"), F.element_at("v", -1).alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def carry(lines: DataFrame, value: Column, name: str = "meta") -> DataFrame:
    """lines(file, line, ...) -> with the last value at or before each line of its file."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def log_tail(events: DataFrame, n: int = 50) -> DataFrame:
    """The last n events of each day."""
    w = Window.partitionBy(F.to_date("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def source_counts(events: DataFrame) -> DataFrame:
    """events(source) -> local, federation, web, total."""
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    return events.agg(n("local"), n("federation"), n("web"), F.count("*").alias("total"))


def bypass_summary(prefetch: DataFrame, bypass: DataFrame, since: Column | None = None) -> DataFrame:
    """prefetch(ts, terminal), bypass(ts, tool, denied) -> per tool, and tool null for all: attempts, denied, passed, the verdicts and the rate.

    An attempt that is not denied has passed. The rate is attempts by terminal verdicts of the prefetch log, 0 without any;
    since leaves out what is older, in both logs.
    """
    if since is not None:
        prefetch, bypass = prefetch.filter(F.col("ts") >= since), bypass.filter(F.col("ts") >= since)
    denied = F.count_if(F.coalesce("denied", F.lit(False)))
    n = F.count("*")
    per = bypass.groupBy("tool").agg(n.alias("attempts"), denied.alias("denied"))
    every = bypass.agg(n.alias("attempts"), denied.alias("denied")).select(F.lit(None).cast("string").alias("tool"), "attempts", "denied")
    verdicts = prefetch.agg(F.count_if(F.coalesce("terminal", F.lit(False))).alias("terminal_verdicts"), n.alias("all_verdicts"))
    x = per.unionByName(every).withColumn("one", F.lit(1)).join(F.broadcast(verdicts.withColumn("one", F.lit(1))), "one").drop("one")  # one row
    return x.withColumn("passed", F.col("attempts") - F.col("denied")).withColumn("rate", F.round(F.coalesce(F.try_divide("attempts", "terminal_verdicts"), F.lit(0.0)), 6))


def outcomes(answers: DataFrame) -> DataFrame:
    """answers(query_id, peer, ok, n_rows, timed_out, bytes) -> per query how its peers did."""
    return answers.groupBy("query_id").agg(
        F.count_distinct("peer").alias("queried"), F.count_if(F.col("ok") & (F.col("n_rows") > 0)).alias("responded"), F.count_if("timed_out").alias("timed_out"),
        F.count_if(~F.col("ok") & ~F.col("timed_out")).alias("errored"), F.sum("bytes").alias("bytes"))


def consensus(matches: DataFrame) -> DataFrame:
    """matches(query_id, source_peer, also_from_peers) -> distinct origins (null is local), whether one is remote."""
    x = matches.select("query_id", F.explode(F.concat(F.array(F.coalesce("source_peer", F.lit("local"))), F.coalesce("also_from_peers", F.array().cast("array<string>")))).alias("o"))
    return x.groupBy("query_id").agg(F.count_distinct("o").alias("origins"), F.bool_or(F.col("o") != "local").alias("remote"))


def question_list(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(question_id, asked_by, status, at), answers(question_id) -> questions with a known asker and their number of answers, newest first."""
    n = answers.groupBy("question_id").agg(F.count("*").alias("n_answers"))
    known = F.when(F.col("status").isin("open", "answered", "closed"), F.col("status")).otherwise("open")
    q = questions.filter("asked_by is not null").join(n, "question_id", "left").withColumn("status", known).fillna(0, ["n_answers"])
    return q.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("at"), "question_id")))


def entity_upsert(candidates: DataFrame) -> DataFrame:
    """candidates(kind, label, aliases, seen, mentions, auto) -> one entity an id: aliases united, latest label, mentions summed, auto only if all were."""
    from graphloom.functions.text import entity_id, normalise_alias

    c = candidates.withColumn("id", entity_id(F.col("kind"), F.col("label"))).withColumn("alias", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))))
    names = c.groupBy("id").agg(F.array_sort(F.collect_set(normalise_alias(F.col("alias")))).alias("aliases"))
    g = candidates.withColumn("id", entity_id(F.col("kind"), F.col("label"))).groupBy("id").agg(F.max_by("label", F.struct("seen", "label")).alias("label"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.sum("mentions").alias("mention_count"), F.bool_and("auto").alias("auto"))
    return g.join(names, "id")


# What marks a decision, an open end or a failure in what an assistant says.
DECISION = r"(?i)\b(?:decided|chose|choosing|going with|went with|the fix is|root cause|because|instead of|rather than|switched to|will use|reuse|reusing|no new dep|the plan is|approach is|let's|i'll)\b"
OPEN = r"(?i)\b(?:todo|next step|next:|still need|remaining|left to do|blocked on|not yet|follow.?up|need to|should still|haven't|have not|outstanding|tbd)\b"
ERROR = r"(?i)\b(?:error|failed|failing|exception|stack trace|broke|broken|cannot|could not|does not work|doesn't work|regression|red test|tsc error)\b"


def session_digest(entries: DataFrame, files: int = 25) -> DataFrame:
    """entries(session, seq, kind, at, branch, text, path) -> per session counts, goal, first and last time, branch, first distinct cues, newest files."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    e = entries.withColumn("said", said)
    g = e.groupBy("session").agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("kind") == "user").alias("n_user"), F.count_if(F.col("kind") == "assistant").alias("n_assistant"), F.min("at").alias("started"), F.max("at").alias("ended"),
        F.max_by("said", F.when((F.col("kind") == "user") & (F.col("said") != ""), F.col("seq"))).alias("goal"), F.max_by("branch", F.when(F.col("branch").isNotNull(), F.col("seq"))).alias("branch"))

    def cues(name: str, pattern: str, most: int) -> DataFrame:
        hit = e.filter((F.col("kind") == "assistant") & F.rlike("said", F.lit(pattern)))
        first = hit.groupBy("session", F.lower("said").alias("low")).agg(F.min_by("said", "seq").alias("said"), F.min("seq").alias("seq"))
        top = first.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).filter(F.col("k") <= most)
        return top.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda s: s["said"]).alias(name))

    touched = entries.filter("path is not null").groupBy("session", "path").agg(F.max("seq").alias("seq"))
    newest = touched.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq"), "path"))).filter(F.col("k") <= files)
    listed = newest.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda s: s["path"]).alias("files"))
    for other in (cues("decisions", DECISION, 8), cues("open_ends", OPEN, 8), cues("errors", ERROR, 5), listed):
        g = g.join(other, "session", "left")
    return g


def digest_text(digests: DataFrame) -> DataFrame:
    """Digests -> session, label, uri, text; sessions that say nothing have none."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}:\n- "), F.array_join(c, "\n- ")))
    text = F.concat_ws("\n", F.concat(F.lit("Goal: "), F.col("goal")), part("Decisions", "decisions"), part("Open", "open_ends"), part("Errors", "errors"), part("Files", "files"))
    label = F.concat(F.lit("[digest] "), F.substring(F.coalesce("goal", F.col("session").cast("string")), 1, 80))
    return digests.select("session", label.alias("label"), F.concat(F.lit("session-digest://"), F.col("session").cast("string")).alias("uri"), text.alias("text")).filter("text <> ''")


def session_topics(sessions: DataFrame, most: int = 10) -> DataFrame:
    """sessions(label) -> the most frequent words longer than three letters."""
    w = sessions.select(F.explode(F.split(F.lower("label"), r"\s+")).alias("word")).filter(F.length("word") > 3)
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def day_did_hash(did: Column, at: Column) -> Column:
    """A name for a peer that changes every day."""
    return F.substring(F.sha2(F.concat_ws(":", did.cast("string"), F.date_format(at, "yyyy-MM-dd")), 256), 1, 16)


def seconds(ts: Column) -> Column:
    return micros(ts) / 1e6
