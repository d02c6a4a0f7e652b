"""Retrieval and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, scratched, shuffle_partitions


def retrieval_metrics(queries: DataFrame, hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, recall_any, ndcg, mrr, average precision at k; queries without hits count 0.

    Judgments and hits are read once: each pair of a query and a relevant document carries the ranks it was found at."""
    rel = qrels.select("query_id", "doc_id").distinct()
    found = hits.filter(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.collect_list("rank").alias("at"))
    pairs = rel.join(found, ["query_id", "doc_id"], "left").select("query_id", F.posexplode_outer("at").alias("i", "rank"))
    per = pairs.groupBy("query_id").agg(F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("n_rel"), F.array_sort(F.collect_list("rank")).alias("ranks"))  # at most k ranks
    total = lambda f: F.aggregate("ranks", F.lit(0.0), lambda a, r: a + f(r))
    of = {"n_hit": F.size("ranks"), "dcg": total(lambda r: 1 / F.log2(r + 1)), "first": F.get("ranks", F.lit(0)), "ap": total(lambda r: F.size(F.filter("ranks", lambda x: x <= r)) / r)}
    x = queries.select("query_id").join(per.withColumns(of).drop("ranks"), "query_id", "left").fillna(0, ["n_rel", "n_hit", "dcg", "ap"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("n_rel"), F.lit(1))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.col("n_rel") > 0
    return x.select(
        "query_id", F.round(F.when(some, F.col("n_hit") / F.col("n_rel")).otherwise(0.0), 6).alias("recall"), (F.col("n_hit") > 0).cast("int").alias("recall_any"),
        F.round(F.when(some, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(some, F.col("ap") / F.least(F.lit(k), F.col("n_rel"))).otherwise(0.0), 6).alias("average_precision"),
    )


@scratched
def auc(scored: DataFrame, *, keep: Scratch) -> DataFrame:
    """scored(score, label 0/1) -> n_pos, n_neg, auc (null with one class) from counts per distinct score; no pair is formed.

    Scores are range partitioned; sums of the ranges, one row for each, give what lies below each range.
    """
    n = shuffle_partitions(scored.sparkSession)
    g = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    g = keep(g.repartitionByRange(n, "score").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = g.groupBy("part").agg(F.sum("neg").alias("in_part")).withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))  # one row a partition
    inside = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(start), "part")
    a = g.agg(F.sum(F.col("pos") * (F.col("before") + F.col("below") + 0.5 * F.col("neg"))).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select("n_pos", "n_neg", F.round(F.try_divide("wins", F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def youden_sweep(scored: DataFrame, points: int = 41) -> DataFrame:
    """A grid between the least and the greatest score: tpr, fpr (0 without such rows), their difference, the first best.

    Each row is counted once, at the last grid point it reaches; the sweep sums over grid points."""
    edge = scored.agg(F.min("score").cast("double").alias("lo"), F.max("score").cast("double").alias("hi"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).withColumn("one", F.lit(1))
    s = scored.withColumn("one", F.lit(1)).join(F.broadcast(edge), "one")  # one row
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(-1), lambda a, i: F.when(F.col("score") >= F.col("lo") + step * i, i).otherwise(a))
    binned = s.withColumn("bin", at).groupBy("bin").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    grid = edge.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi", "p", "n")
    w = Window.orderBy(F.desc("i"))
    x = grid.join(binned, grid["i"] == binned["bin"], "left").withColumn("t", F.sum(F.coalesce("tp", F.lit(0))).over(w)).withColumn("f", F.sum(F.coalesce("fp", F.lit(0))).over(w))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.select("i", F.round(F.col("lo") + step * F.col("i"), 6).alias("threshold"), F.round(share("t", "p"), 6).alias("tpr"), F.round(share("f", "n"), 6).alias("fpr"), F.round(share("t", "p") - share("f", "n"), 6).alias("youden"))
    first = F.max_by("i", F.struct("youden", -F.col("i"))).over(Window.partitionBy())
    return x.withColumn("best", F.col("i") == first)


def cohen_kappa(judged: DataFrame) -> DataFrame:
    """judged(a 0/1, b 0/1) -> agreement beyond chance, precision and recall of b for a; null where a denominator is 0."""
    c = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    t = judged.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = F.try_divide(F.col("tp") + F.col("tn"), n)
    pe = F.try_divide((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn")), n * n)
    return t.select(n.alias("n"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def learn_weights(samples: DataFrame, parts: list[str]) -> DataFrame:
    """samples(satisfied 0/1, one column per part) -> weight of each part from its Fisher ratio, and why weights are equal, if they are.

    Equal weights: fewer than 8 samples, fewer than 3 of a class, or no part that tells the classes apart.
    """
    long = samples.select("satisfied", F.stack(F.lit(len(parts)), *[x for p in parts for x in (F.lit(p), F.col(p).cast("double"))]).alias("part", "value"))
    both = [f(F.when(F.col("satisfied") == k, F.col("value"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))]
    g = long.groupBy("part").agg(*both, F.count_if(F.col("satisfied") == 0).alias("n0"), F.count_if(F.col("satisfied") == 1).alias("n1"))
    g = g.withColumn("ratio", F.coalesce(F.pow(F.col("m1") - F.col("m0"), 2) / (F.col("v1") + F.col("v0") + 1e-6), F.lit(0.0)))
    every = Window.partitionBy()  # one row for each part
    g = g.withColumn("total", F.sum("ratio").over(every))
    why = F.when(F.col("n0") + F.col("n1") < 8, "few samples").when(F.least("n0", "n1") < 3, "few of a class").when(F.col("total") <= 1e-6, "no spread")
    g = g.withColumn("reason", why).withColumn("raw", F.when(F.col("reason").isNotNull(), 1.0).otherwise(F.try_divide("ratio", "total") + 0.02))
    return g.select("part", F.round("ratio", 6).alias("ratio"), F.round(F.col("raw") / F.sum("raw").over(every), 6).alias("weight"), "reason")


def metrics_report(per_query: DataFrame) -> DataFrame:
    """Per-query metrics (queries without hits included as 0) -> their means."""
    names = ["recall", "recall_any", "ndcg", "mrr", "average_precision"]
    return per_query.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def classification_report(judged: DataFrame) -> DataFrame:
    """judged(actual, predicted) of class names -> precision, recall, f1 of each class (0 on an empty denominator)."""
    counts = judged.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    side = lambda c: counts.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(c), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias(f"{c}_right"))
    x = side("actual").join(side("predicted"), "class", "full").fillna(0)
    tp = F.greatest("actual_right", "predicted_right")
    p, r = F.coalesce(F.try_divide(tp, "predicted"), F.lit(0.0)), F.coalesce(F.try_divide(tp, "actual"), F.lit(0.0))
    return x.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


@scratched
def quantiles(values: DataFrame, shares: list[float], rule: str = "floor_n", *, keep: Scratch) -> DataFrame:
    """values(x) -> q, value by an index rule: floor(q n), at most n - 1 ("floor_n"), or floor(q (n - 1)) ("floor_n1").

    Values are counted per distinct value; running counts come from range partitions, as in auc.
    """
    n_parts = shuffle_partitions(values.sparkSession)
    g = values.filter("x is not null").groupBy("x").agg(F.count("*").alias("c"))
    g = keep(g.repartitionByRange(n_parts, "x").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = g.groupBy("part").agg(F.sum("c").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k")  # one row a partition
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(start), "part").withColumn("upto", F.col("upto") + F.col("before"))
    n = g.agg(F.sum("c").alias("n"))
    at = F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n"))) if rule == "floor_n" else F.floor(F.col("q") * (F.col("n") - 1))
    want = n.filter("n > 0").withColumn("q", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("at", at)
    hit = g.join(F.broadcast(want), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))  # one row for each share
    return hit.select("q", F.col("x").alias("value"))


def deny_gate(probes: DataFrame, threshold: F.Column, min_hits: F.Column) -> F.Column:
    """probes(decision, score, n_hits): whether memory answers in place of a search."""
    return (F.col("decision") == "use_memory") & (F.col("score") >= threshold) & (F.col("n_hits") >= min_hits)


def deny_sweep(probes: DataFrame, thresholds: list[float], min_hits: list[int]) -> DataFrame:
    """probes(decision, score, n_hits, in_corpus 0/1) -> each cell's true and false denials, their rates, and the cell picked.

    Picked: no false denial first, then most true ones, then more hits, then the higher threshold. The grid
    is exploded inside each row and summed before the shuffle.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("min_hits")) for t in thresholds for m in min_hits])).alias("g")
    x = probes.select("*", grid).select("*", "g.threshold", "g.min_hits")
    deny = deny_gate(x, F.col("threshold"), F.col("min_hits"))
    inside = F.col("in_corpus") == 1
    c = x.groupBy("threshold", "min_hits").agg(F.count_if(deny & inside).alias("true_deny"), F.count_if(deny & ~inside).alias("false_deny"), F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    c = c.withColumn("true_rate", F.round(F.coalesce(F.try_divide("true_deny", "n_in"), F.lit(0.0)), 6)).withColumn("false_rate", F.round(F.coalesce(F.try_divide("false_deny", "n_out"), F.lit(0.0)), 6))
    order = F.struct((F.col("false_deny") == 0).alias("clean"), "true_deny", "min_hits", "threshold")
    top = F.max(order).over(Window.partitionBy())  # one row for each cell
    return c.withColumn("picked", order == top).drop("n_in", "n_out")


def operating_points(instances: DataFrame, thresholds: list[float], budget: float = 0.02) -> DataFrame:
    """instances(score, right 0/1, direct 0/1) -> per threshold recall (accepted and right, else direct), false accepts, the best within the budget."""
    x = instances.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    took = F.col("score") >= F.col("threshold")
    g = x.groupBy("threshold").agg(F.avg(F.when(took, F.col("right")).otherwise(F.col("direct")).cast("double")).alias("recall"), F.avg((took & (F.col("right") == 0)).cast("double")).alias("false_rate"))
    g = g.select("threshold", F.round("recall", 6).alias("recall"), F.round("false_rate", 6).alias("false_rate"))
    top = F.max(F.when(F.col("false_rate") <= budget, F.struct("recall", "threshold"))).over(Window.partitionBy())
    return g.withColumn("picked", F.coalesce(F.struct("recall", "threshold") == top, F.lit(False)))


def rejudged_ndcg(queries: DataFrame, hits: DataFrame, qrels: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """hits(query_id, doc_id, rank), qrels and judged(query_id, doc_id, positive) -> one row: NDCG at k against the given judgments and with the judge's positives among the first k added.

    new_positives: pairs that the judge adds; false_negative_rate: their share of the judged pairs that the judgments did not hold.
    """
    known = qrels.select("query_id", "doc_id").distinct()
    top = hits.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    fresh = judged.groupBy("query_id", "doc_id").agg(F.bool_or("positive").alias("positive")).join(top, ["query_id", "doc_id"], "left_semi").join(known, ["query_id", "doc_id"], "left_anti")
    more = fresh.filter("positive").select("query_id", "doc_id")
    mean = lambda rel, name: retrieval_metrics(queries, hits, rel, k).agg(F.round(F.avg("ndcg"), 6).alias(name)).withColumn("one", F.lit(1))
    n = fresh.agg(F.count_if("positive").alias("new_positives"), F.round(F.coalesce(F.try_divide(F.count_if("positive"), F.count("*")), F.lit(0.0)), 6).alias("false_negative_rate")).withColumn("one", F.lit(1))
    x = mean(known, "ndcg").join(mean(known.unionByName(more), "ndcg_rejudged"), "one").join(n, "one")  # one row each
    return x.select("ndcg", "ndcg_rejudged", F.round(F.col("ndcg_rejudged") - F.col("ndcg"), 6).alias("gain"), "new_positives", "false_negative_rate")


def read_eval_queries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line, value: JSON) -> queries(query_id, query, expected) and rejects(line, reason); blank lines are neither.

    A line needs a query and a list of ids, strings that are not blank; a query's id is its line.
    """
    v = lines.filter(F.trim("value") != "").select("line", F.try_parse_json("value").alias("v"))
    ids = F.try_variant_get("v", "$.expected_node_ids", "array<variant>")
    text = F.when(F.schema_of_variant(F.try_variant_get("v", "$.query", "variant")) == "STRING", F.try_variant_get("v", "$.query", "string"))
    named = lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != "")
    object_ = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    why = F.when(F.col("v").isNull(), "invalid JSON").when(~object_, "no object").when(F.coalesce(text, F.lit("")) == "", "no query").when(F.coalesce(F.size(ids), F.lit(0)) < 1, "no expected_node_ids").when(~F.forall(ids, named), "blank id")
    x = v.withColumns({"reason": why, "query": text, "expected": F.transform(ids, lambda i: F.try_variant_get(i, "$", "string"))})
    return x.filter("reason is null").select(F.col("line").alias("query_id"), "query", "expected"), x.filter("reason is not null").select("line", "reason")


def eval_queries(queries: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, expected array), runs(query_id, retrieved array in order, latency_ms, failed) -> one row: n, means of recall, NDCG, reciprocal rank and latency, its p50 and p95.

    Failed queries are skipped.
    """
    ok = runs.filter(~F.coalesce("failed", F.lit(False)))
    q = queries.join(ok.select("query_id"), "query_id", "left_semi")
    hits = ok.select("query_id", F.posexplode(F.slice("retrieved", 1, k)).alias("at", "doc_id")).groupBy("query_id", "doc_id").agg((F.min("at") + 1).alias("rank"))
    m = retrieval_metrics(q, hits, q.select("query_id", F.explode("expected").alias("doc_id")), k).agg(F.count("*").alias("n"), *[F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in ("recall", "ndcg", "mrr")]).withColumn("one", F.lit(1))
    took = ok.join(q.select("query_id"), "query_id", "left_semi").select(F.col("latency_ms").cast("double").alias("x"))
    at = quantiles(took, [0.5, 0.95]).groupBy(F.lit(1).alias("one")).pivot("q", [0.5, 0.95]).agg(F.first("value")).toDF("one", "p50_ms", "p95_ms")
    return m.join(took.agg(F.round(F.avg("x"), 6).alias("mean_ms")).withColumn("one", F.lit(1)), "one").join(at, "one", "left").fillna(0.0, ["mean_ms", "p50_ms", "p95_ms"]).drop("one")
