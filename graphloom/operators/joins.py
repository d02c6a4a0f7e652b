"""Look-ups between mentions, entities, code, questions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import normalise_alias


def recall(edges: DataFrame, nodes: DataFrame, half_life: float = 14.0, most: int = 20) -> DataFrame:
    """edges(source, target, relation), nodes(id, age_days, fetched_at) -> per entity its newest mentions, how many there are in all; an unknown age counts as new."""
    m = edges.filter("relation = 'mentions'").select("target", F.col("source").alias("id")).distinct().join(nodes, "id")
    value = F.round(F.pow(F.lit(0.5), F.coalesce("age_days", F.lit(0.0)) / half_life), 9)
    total = m.groupBy("target").agg(F.count("*").alias("total"))
    w = Window.partitionBy("target").orderBy(F.desc("value"), F.desc_nulls_last("fetched_at"), F.asc("id"))
    return m.withColumn("value", value).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).join(total, "target").select(F.col("target").alias("entity"), "id", "value", "place", "total")


def resolve_alias(surfaces: DataFrame, entities: DataFrame) -> DataFrame:
    """surfaces(surface), entities(id, seq, aliases) -> surface, id: an id itself, else the first entity in order with that alias, else null.

    The first place in order is a number, which tasks count by hash and in pieces; ids are looked up after. Joins are
    merged: by the size of its file a registry seems small enough to be sent whole, its aliases are far larger.
    """
    s = surfaces.select("surface").distinct().withColumn("norm", normalise_alias(F.col("surface")))
    names = entities.select(F.explode("aliases").alias("alias"), "seq", "id").select(normalise_alias(F.col("alias")).alias("norm"), "seq", "id")
    first = names.groupBy("norm").agg(F.min("seq").alias("seq")).join(s.select("norm").distinct().hint("merge"), "norm")  # left_semi would go before the counting
    ids = names.join(first.hint("merge"), ["norm", "seq"]).groupBy("norm").agg(F.min("id").alias("by_alias"))
    own = entities.select(F.col("id").alias("own")).distinct()
    x = s.join(own.hint("merge"), s["surface"] == own["own"], "left").join(ids.hint("merge"), "norm", "left")
    return x.select("surface", F.coalesce("own", "by_alias").alias("id"))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(call_id, file, callee), functions(id, name, file, seq) -> call_id, target, confidence: unresolved, exact or heuristic (same file first, then in order)."""
    n = functions.groupBy("name").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("first"))
    near = functions.groupBy("name", "file").agg(F.min_by("id", "seq").alias("here"))
    x = calls.withColumnRenamed("callee", "name").join(n, "name", "left").join(near, ["name", "file"], "left")
    found = F.when(F.col("n").isNull(), F.concat(F.lit("unresolved:"), "name")).otherwise(F.coalesce("here", "first"))
    return x.select("call_id", found.alias("target"), F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "exact").otherwise("heuristic").alias("confidence"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files(path, digest) whose digest is not the one stored under their path."""
    return files.join(known.select("path", "digest").distinct(), ["path", "digest"], "left_anti")


def rank_answerable(questions: DataFrame, hits: DataFrame, answers: DataFrame, me: str, threshold: float) -> DataFrame:
    """Questions of others that are not answered yet and have a hit near enough, nearest first."""
    open_ = questions.filter(F.coalesce("asked_by", F.lit("")) != me).join(answers.select("question_id").distinct(), "question_id", "left_anti")
    near = hits.groupBy("question_id").agg(F.min("distance").alias("best")).filter(F.col("best") <= threshold)
    x = open_.join(near, "question_id").select("question_id", "best", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("best"))), 6).alias("confidence"))
    return x.orderBy("best", "question_id")


def orphan_report(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """vectors(id), nodes(id) -> scanned, resolved, orphans, share resolved."""
    x = vectors.select("id").join(nodes.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    g = x.agg(F.count("*").alias("scanned"), F.count("known").alias("resolved"))
    return g.withColumn("orphans", F.col("scanned") - F.col("resolved")).withColumn("rate", F.round(F.coalesce(F.try_divide("resolved", "scanned"), F.lit(0.0)), 6))


def corpus_check(seeds: DataFrame, kinds: list[str]) -> DataFrame:
    """seeds(label, body, kind, uri) -> problem, n: blank labels or bodies, unknown kinds, blank addresses, repeated kind and label."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    one = F.array_compact(F.array(F.when(blank("label"), "label"), F.when(blank("body"), "body"), F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "kind"), F.when(F.col("uri").isNotNull() & blank("uri"), "uri")))
    rows = seeds.select(F.explode(one).alias("problem"))
    twice = seeds.groupBy("kind", F.lower("label").alias("low")).agg(F.count("*").alias("k")).filter("k > 1").select(F.lit("duplicate").alias("problem"))
    return rows.unionByName(twice).groupBy("problem").agg(F.count("*").alias("n"))
