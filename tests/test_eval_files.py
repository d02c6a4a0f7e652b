import json

from graphloom.operators import evaluation


def test_query_files_and_their_means(spark):
    lines = [json.dumps({"query": "a", "expected_node_ids": ["x", "y"]}), "", "{", "[1]", json.dumps({"query": "", "expected_node_ids": ["x"]}), json.dumps({"query": 3, "expected_node_ids": ["x"]}), json.dumps({"query": "b", "expected_node_ids": []}), json.dumps({"query": "b", "expected_node_ids": ["x", ""]}), json.dumps({"query": "c", "expected_node_ids": ["z"]}), json.dumps({"query": "d", "expected_node_ids": ["q"]})]
    good, bad = evaluation.read_eval_queries(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    assert {r.line: r.reason for r in bad.collect()} == {2: "invalid JSON", 3: "no object", 4: "no query", 5: "no query", 6: "no expected_node_ids", 7: "blank id"}
    assert {r.query_id: r.expected for r in good.collect()} == {0: ["x", "y"], 8: ["z"], 9: ["q"]}
    runs = spark.createDataFrame([(0, ["x", "n", "y"], 10.0, False), (8, ["n", "m"], 30.0, None), (9, ["q"], 99.0, True)], "query_id long, retrieved array<string>, latency_ms double, failed boolean")
    r = evaluation.eval_queries(good, runs, 2).first()
    ndcg = (1 / (1 + 1 / 1.584962500721156) + 0) / 2
    assert (r.n, r.recall, r.mrr, r.mean_ms, r.p50_ms, r.p95_ms) == (2, 0.25, 0.5, 20.0, 30.0, 30.0) and abs(r.ndcg - ndcg) < 1e-5
    none = evaluation.eval_queries(good, runs.limit(0)).first()
    assert (none.n, none.recall, none.mean_ms, none.p95_ms) == (0, 0.0, 0.0, 0.0)
