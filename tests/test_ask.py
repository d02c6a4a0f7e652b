import math

from pyspark.sql import functions as F

from graphloom.operators import ask

RESULT = "query_id long, position int, distance double, vec_distance double, source_peer string, also_from_peers array<string>, source_uri string, fetched_at string, age_days double, stale_after_days double, has_signature boolean"


def scored(spark, rows, coverage=None):
    q = spark.createDataFrame([(1, coverage), (2, None)], "query_id long, coverage double")
    out = {r.query_id: r for r in ask.satisfaction(q, spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], RESULT)).collect()}
    assert out[2].score == 0 and out[2].observed == 0 and out[2].n == 0
    return out[1]


def cents(x):
    return math.floor(x * 100 + 0.5) / 100


def test_a_near_fresh_sourced_local_hit(spark):
    r = scored(spark, [(0.2, None, None, None, "u", "t", 0.0, None, None)])
    assert (r.score, r.provenance, r.consensus, r.signature, r.observed, r.trust_weight) == (1.0, 1.0, 1.0, None, 4, 0.5)
    assert r.reasons == ["close_top", "fresh", "sourced"] and r.penalties == []


def test_gates_and_penalties(spark):
    far = scored(spark, [(1.6, None, None, None, None, None, 20.0, None, None)])
    # trust (0 + 1) / 2, less no source .15, far .2, stale .1 (capped at .4); floor of relevance; half-lives of seven days
    assert far.score == cents((0.5 - 0.4) * 0.3 * (0.3 + 0.7 * 0.5 ** (20 / 7))) and far.penalties == ["unsourced", "far_top", "stale"]
    age = scored(spark, [(0.4, None, None, None, "u", "t", 7.0, None, None)])
    assert age.score == cents(0.3 + 0.7 * 0.5) and age.fresh_count == 1
    assert scored(spark, [(0.4, None, None, None, "u", "t", 10.0, 14.0, None)]).stale_count == 0
    covered = scored(spark, [(0.85, None, None, None, "u", "t", 0.0, None, None)], 0.5)
    assert covered.score == cents(0.3 + 0.7 * (0.6 * 0.5 + 0.4 * 0.5))
    recall = scored(spark, [(0.0, None, None, None, "u", "t", None, None, None)])  # no known distance, no age: trust alone
    assert recall.score == 1.0 and recall.retrieval is None and recall.freshness is None
    assert scored(spark, [(1.0, 0.5, None, None, "u", "t", None, None, None)]).score == 1.0  # the vector's distance counts


def test_peers_and_signatures(spark):
    one = scored(spark, [(0.5, None, "p", None, "u", "t", 0.0, None, True), (0.5, None, "p", [], "u", "t", 0.0, None, False)])
    assert (one.consensus, one.signature, one.distinct_origins, one.unsigned_count) == (0.5, 0.5, 1, 1) and one.penalties == ["one_remote_origin"]
    assert one.score == cents((1 + 0.5 + 0.5) / 3 - 0.15)
    two = scored(spark, [(0.5, None, "p", ["q"], "u", "t", 0.0, None, None)])
    assert (two.consensus, two.distinct_origins, two.score) == (1.0, 2, 1.0)
    top = scored(spark, [(0.9, None, None, None, "u", "t", 0.0, None, None), (0.1, None, None, None, "u", "t", 0.0, None, None), (float("nan"), None, None, None, "", "t", 0.0, None, None)])
    assert top.retrieval == cents((0.1 + 0.9) / 2) and top.missing_provenance == 1 and "close_top" not in top.reasons


def test_resolved_queries_are_replaced(spark):
    hits = spark.createDataFrame([(1, "rq", 0.1), (1, "a", 0.3), (1, "b", 0.05), (1, "empty", 0.0), (2, "c", 0.2)], "query_id long, id string, distance double")
    resolved = spark.createDataFrame([("rq", ["a", "b", "ghost"]), ("empty", None)], "id string, answer_docs array<string>")
    got = ask.expand_resolved(hits, resolved, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 0.1, 2), (1, "b", 0.05, 1), (2, "c", 0.2, 1)]


def test_aliases_and_their_search(spark):
    e = spark.createDataFrame([("acme", 1, ["Acme Corp", "ACME", "acme  corp", " ", "the makers", "anvils", "rockets"])], "id string, seq long, aliases array<string>")
    q = spark.createDataFrame([(1, " acme corp"), (2, "acme"), (3, "nobody"), (4, None)], "query_id long, text string")
    got = {}
    for r in sorted(ask.alias_queries(q, e).collect(), key=lambda r: (r.query_id, r.variant)):
        got.setdefault(r.query_id, []).append(r.text)
    assert got == {1: [" acme corp", "ACME", "acme  corp", "the makers"], 2: ["acme", "Acme Corp", "acme  corp", "the makers"], 3: ["nobody"], 4: [None]}

    def search(texts, n):
        return texts.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rank"), F.length(F.coalesce("text", F.lit(""))).alias("shift")).select("query_id", ((F.col("rank") * 7 + F.col("shift")) % 10).alias("id"), "rank", (F.col("rank") / 10).alias("distance")).filter("rank < 8")

    fused = {(r.query_id, r.id): r.score for r in ask.alias_search(q, e, search, 2).collect()}
    want = {}
    for k, texts in got.items():
        for t in texts:
            for rank in range(8):
                i = (rank * 7 + len(t or "")) % 10
                want[k, i] = want.get((k, i), 0) + 1 / (61 + rank)
    assert fused.keys() == want.keys() and all(abs(fused[x] - want[x]) < 1e-8 for x in want)


def test_hits_and_telemetry(spark):
    nodes = spark.createDataFrame([("n", "Node", None, "file.ts", "2024-06-01T00:00:00Z")], "id string, label string, source_uri string, source_file string, fetched_at string")
    now = F.lit("2024-06-03 12:00:00").cast("timestamp")
    h = spark.createDataFrame([(1, "n", 0.1), (1, "ghost", 0.2)], "query_id long, id string, distance double")
    rows = {r.id: r for r in ask.ask_hits(h, nodes.withColumns({"summary": F.lit("s"), "workspace": F.lit(None).cast("string")}), now).collect()}
    assert (rows["n"].label, rows["n"].source_uri, rows["n"].age_days) == ("Node", "file.ts", 2.5) and (rows["ghost"].label, rows["ghost"].age_days) == ("ghost", None)
    q = spark.createDataFrame([(1, "node server"), (2, "tls certificates"), (3, "nothing found")], "query_id long, text string")
    m = [(1, 0, "n", 0.3, None, None, None, None, None), (1, 1, "remote", 0.4, "p", ["q"], "http://x", "2024-06-03T00:00:00Z", True), (2, 0, "remote", 0.6, "p", None, "http://x", "2024-05-01T00:00:00Z", True)]
    df = spark.createDataFrame(m, "query_id long, position int, id string, distance double, source_peer string, also_from_peers array<string>, source_uri string, fetched_at string, sig_valid boolean")
    out = {r.query_id: r for r in ask.pull_telemetry(q, df, nodes, now).collect()}
    assert (out[1].result_count, out[1].distinct_sources, out[1].decision, out[1].missing_terms) == (2, 2, "use_memory", None)
    assert out[2].decision in ("search", "ask_user") and out[2].score < 0.65
    assert (out[3].score, out[3].decision, out[3].result_count) == (0.0, "ask_user", 0)
