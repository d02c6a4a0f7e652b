"""From a question to a decision: aliases, hits with their nodes, replaced resolved queries, satisfaction, telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import age_in_days, classify_risk, once, query_terms
from graphloom.operators.joins import resolve_alias
from graphloom.operators.memory import decide_contract
from graphloom.operators.ranking import multi_rrf

#: Aliases beside the question itself, and how many times k each of them fetches.
MOST_ALIASES, OVERFETCH = 3, 4
# What a fully irrelevant or stale result keeps, distances of full and of no relevance, weight of coverage, days.
FLOOR, NEAR, FAR, COVERAGE, HALF_LIFE, PULLED_STALE = 0.3, 0.5, 1.2, 0.6, 7.0, 14.0
MOST_PENALTY = 0.4


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def alias_queries(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """queries(query_id, text), entities(id, seq, aliases) -> query_id, variant, text: the question (0) and up to three other aliases of the entity it names."""
    q = queries.select("query_id", "text", F.regexp_replace("text", r"^\s+|\s+$", "").alias("surface"))
    named = resolve_alias(q, entities).filter("id is not null")
    first = entities.filter("seq is not null").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).filter("place = 1")
    known = named.join(first.select("id", "aliases").hint("merge"), "id").select("surface", "aliases")
    x = q.join(known.hint("merge"), "surface", "left")
    plain = F.struct(F.transform("aliases", _plain).alias("all"), _plain(F.col("text")).alias("text"))
    fresh = once(plain, lambda p: F.filter("aliases", lambda a, i: (p["all"][i] != "") & (p["all"][i] != p["text"]) & (F.array_position(p["all"], p["all"][i]) == i + 1)))
    every = F.concat(F.array("text"), F.coalesce(F.slice(fresh, 1, MOST_ALIASES), F.array().cast("array<string>")))
    return x.select("query_id", F.posexplode(every).alias("variant", "text"))


def alias_search(queries: DataFrame, entities: DataFrame, search: Callable[[DataFrame, int], DataFrame], k: int, rrf: int = 60) -> DataFrame:
    """Each variant of a question searched for OVERFETCH * k hits by search(texts(query_id, text), n) -> query_id, id, rank from 0, distance; fused by rank."""
    v = alias_queries(queries, entities).withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    found = search(v.select(F.col("key").alias("query_id"), "text"), OVERFETCH * k)
    lists = found.withColumnRenamed("query_id", "key").join(v.select("key", "query_id", "variant"), "key")
    return multi_rrf(lists.select("query_id", F.col("variant").alias("list"), "id", "rank", "distance"), rrf)


def ask_hits(hits: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """hits(query_id, id, distance) with nodes(id, label, source_uri, source_file, summary, workspace, fetched_at): an unknown node's label is its id."""
    n = nodes.select("id", "label", "source_uri", "source_file", "summary", "workspace", "fetched_at")
    x = hits.select("query_id", "id", "distance").join(n, "id", "left")
    age = F.round((F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(F.col("fetched_at").cast("string")))) / 86.4e9, 2)
    return x.select("query_id", "id", "distance", F.coalesce("label", F.col("id").cast("string")).alias("label"), F.coalesce("source_uri", "source_file").alias("source_uri"), "summary", "workspace", "fetched_at", age.alias("age_days"))


def expand_resolved(hits: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits(query_id, id, distance), resolved(id, answer_docs), nodes(id) -> hits in which a resolved query is replaced by its documents that exist.

    They take over its distance; a document keeps its least one. Order: distance, then id.
    """
    r = resolved.select("id", F.coalesce("answer_docs", F.array().cast(resolved.schema["answer_docs"].dataType)).alias("docs"))
    x = hits.select("query_id", "id", "distance").join(r, "id", "left")
    plain = x.filter("docs is null").select("query_id", "id", "distance")
    answers = x.filter("docs is not null").select("query_id", F.explode("docs").alias("id"), "distance").join(nodes.select("id").distinct(), "id", "left_semi")
    best = plain.unionByName(answers.select("query_id", "id", "distance")).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))


def _cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def satisfaction(queries: DataFrame, results: DataFrame) -> DataFrame:
    """How far the results of a query can be trusted, are relevant and fresh: one row a query.

    queries(query_id, coverage: share of the query's terms, or null); results(query_id, position, distance, vec_distance,
    source_peer, also_from_peers, source_uri, fetched_at, age_days, stale_after_days, has_signature). The mean of provenance, consensus
    and, where known, signatures, less penalties, times a gate for relevance and one for the freshest age; components that are
    not observed are null. A query without results scores 0.
    """
    d = F.when(F.col("vec_distance").isNotNull() & ~F.isnan("vec_distance") & (F.abs("vec_distance") != float("inf")), F.col("vec_distance")).otherwise(F.col("distance"))
    real = (d > 0) & ~F.isnan(d) & (d != float("inf"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    also = F.coalesce("also_from_peers", F.array().cast("array<string>"))
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    limit = F.coalesce("stale_after_days", F.lit(HALF_LIFE))
    g = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min_by("distance", "position").alias("top"), F.min(F.when(real, d)).alias("best"), F.array_sort(F.collect_list(F.when(real, F.struct("position", unit(1 - d).alias("near"))))).alias("reals"),
        F.count_if(F.col("age_days") <= limit).alias("fresh_count"), F.count_if(F.col("age_days") > limit).alias("stale_count"), F.count("age_days").alias("aged"), F.min("age_days").alias("youngest"),
        F.count_if(given("source_uri") & given("fetched_at")).alias("sourced"), F.count("has_signature").alias("signable"), F.count_if("has_signature").alias("signed"), F.count_if(~F.col("has_signature")).alias("unsigned_count"),
        F.array_distinct(F.flatten(F.collect_list(F.concat(F.array(F.coalesce("source_peer", F.lit("local"))), also)))).alias("origins"), F.bool_or(F.col("source_peer").isNotNull() | F.exists(also, lambda p: p != "local")).alias("remote"),
    )
    some = F.col("n") > 0
    x = queries.select("query_id", F.col("coverage").cast("double").alias("coverage")).join(g, "query_id", "left").fillna(0, ["n", "fresh_count", "stale_count", "aged", "sourced", "signable", "signed", "unsigned_count"])
    first = F.slice("reals", 1, 3)
    x = x.withColumn("retrieval", F.when(F.size("reals") > 0, F.aggregate(first, F.lit(0.0), lambda s, r: s + r["near"]) / F.size(first)))
    x = x.withColumn("freshness", F.when(F.col("aged") > 0, F.col("fresh_count") / F.col("aged"))).withColumn("provenance", F.when(some, F.col("sourced") / F.col("n")))
    x = x.withColumn("distinct_origins", F.coalesce(F.size("origins"), F.lit(0)))
    x = x.withColumn("consensus", F.when(some & F.col("remote"), F.when(F.col("distinct_origins") >= 2, 1.0).otherwise(0.5)).when(some, 1.0)).withColumn("signature", F.when(F.col("signable") > 0, F.col("signed") / F.col("signable")))
    trust = ["provenance", "consensus", "signature"]
    add = lambda xs: sum(xs, F.lit(0.0))
    counted = add([F.col(c).isNotNull().cast("double") for c in trust])
    base = F.coalesce(F.try_divide(add([F.coalesce(c, F.lit(0.0)) for c in trust]), counted), F.lit(0.0))
    rules = [
        ("unsourced", F.col("n") - F.col("sourced") > F.col("n") / 2, 0.15), ("one_remote_origin", some & (F.col("distinct_origins") == 1) & F.coalesce("remote", F.lit(False)), 0.15),
        ("far_top", some & (F.col("top") > 1.5), 0.2), ("stale", F.col("stale_count") > F.col("fresh_count"), 0.1),
    ]
    penalty = F.least(F.lit(MOST_PENALTY), add([F.when(F.coalesce(c, F.lit(False)), p).otherwise(0.0) for _, c, p in rules]))
    nearness, cover = unit((FAR - F.col("best")) / (FAR - NEAR)), unit(F.col("coverage"))
    rel = F.when(F.col("best").isNotNull() & F.col("coverage").isNotNull(), COVERAGE * cover + (1 - COVERAGE) * nearness).otherwise(F.coalesce(nearness, cover))
    gate = lambda share: F.coalesce(FLOOR + (1 - FLOOR) * share, F.lit(1.0))
    score = unit((base - penalty) * gate(rel) * gate(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("youngest")) / HALF_LIFE)))
    good = [("close_top", some & (F.col("top") < 0.3)), ("fresh", F.col("fresh_count") > 0), ("origins", F.col("distinct_origins") >= 2), ("sourced", F.col("provenance") >= 0.8)]
    named = lambda rs: F.array_compact(F.array(*[F.when(F.coalesce(r[1], F.lit(False)), r[0]) for r in rs]))
    parts = ["retrieval", "freshness", *trust]
    return x.select(
        "query_id", _cents(score).alias("score"), "n", "fresh_count", "stale_count", "unsigned_count", (F.col("n") - F.col("sourced")).alias("missing_provenance"), "distinct_origins", named(good).alias("reasons"), named(rules).alias("penalties"),
        *[_cents(F.col(c)).alias(c) for c in parts], F.when(counted > 0, _cents(1 / counted)).alias("trust_weight"), add([F.col(c).isNotNull().cast("int") for c in parts]).cast("int").alias("observed"),
    )


def pull_telemetry(queries: DataFrame, matches: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """queries(query_id, text), matches(query_id, position, id, distance, source_peer, also_from_peers, source_uri, fetched_at, sig_valid), nodes(id, label, source_uri, source_file, fetched_at) -> one row a query.

    What a match lacks comes from its node, else from what the peer sent; then satisfaction, the decision under the
    query's risk, the number of different sources, and, where the decision asks for another look, the terms that no hit covers.
    """
    n = nodes.select("id", "label", F.coalesce("source_uri", "source_file").alias("node_uri"), F.col("source_file").alias("body"), F.col("fetched_at").alias("node_at"))
    m = matches.join(n, "id", "left").withColumn("uri", F.coalesce("node_uri", "source_uri")).withColumn("at", F.coalesce(F.col("node_at").cast("string"), F.col("fetched_at").cast("string")))
    rows = m.select(
        "query_id", "position", "distance", F.lit(None).cast("double").alias("vec_distance"), "source_peer", "also_from_peers", F.col("uri").alias("source_uri"), F.col("at").alias("fetched_at"), age_in_days(F.col("at"), now).alias("age_days"),
        F.lit(PULLED_STALE).alias("stale_after_days"), F.col("sig_valid").alias("has_signature"),
    )
    s = satisfaction(queries.select("query_id", F.lit(None).cast("double").alias("coverage")), rows)
    uris = m.groupBy("query_id").agg(F.count_distinct(F.when(F.col("uri") != "", F.col("uri"))).alias("distinct_sources"))
    decided = queries.join(s, "query_id").withColumn("decision", decide_contract(F.col("score"), classify_risk(F.col("text")), F.col("observed")))
    borderline = decided.filter(F.col("decision").isin("verify_one_source", "search")).select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    said = m.select("query_id", F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("body", F.lit(""))).alias("said"))
    covered = borderline.join(said, "query_id", "left").groupBy("query_id", "term").agg(F.bool_or(F.coalesce(F.contains(F.lower("said"), F.col("term")), F.lit(False))).alias("hit"))
    gaps = covered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("term")))).alias("missing_terms"))
    out = decided.join(uris, "query_id", "left").join(gaps, "query_id", "left")
    return out.select("query_id", F.col("n").alias("result_count"), F.coalesce("distinct_sources", F.lit(0)).cast("long").alias("distinct_sources"), "score", "decision", "missing_terms")
