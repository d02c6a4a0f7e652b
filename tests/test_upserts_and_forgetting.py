from pyspark.sql import functions as F

from graphloom.operators import graph, memory, vectors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edges_are_merged_by_pair(spark):
    old = spark.createDataFrame([("a", "b", "uses", 1.0, {"x": "1", "y": "2"}), ("c", "d", "next", None, None)], "source string, target string, relation string, weight double, extras map<string,string>")
    new = spark.createDataFrame(
        [("b", "a", None, 5.0, {"y": "3"}, 1), ("b", "a", "mentions", None, {"z": "4"}, 2), ("a", "ghost", "uses", 1.0, None, 3), ("d", "a", "uses", None, {"k": "v"}, 4)], "source string, target string, relation string, weight double, extras map<string,string>, seq int",
    )
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "id string")
    got = rows(graph.upsert_edges(old, new, nodes, "seq"))
    assert got == sorted([("b", "a", "mentions", 5.0, {"x": "1", "y": "3", "z": "4"}), ("c", "d", "next", None, None), ("d", "a", "uses", None, {"k": "v"})], key=str)


def test_repeated_new_nodes_are_folded_in_order(spark):
    old = spark.createDataFrame([(1, "old", "u1", {"a": "1"}), (2, "keep", None, None)], "id long, label string, uri string, extras map<string,string>")
    new = spark.createDataFrame([(1, "first", None, {"b": "2"}, 1), (1, None, "u2", {"b": "3", "c": "4"}, 2), (3, "x", "y", None, 1), (3, "z", None, None, 2)], "id long, label string, uri string, extras map<string,string>, seq int")
    assert rows(graph.upsert_nodes(old, new, order="seq")) == [(1, "first", "u2", {"a": "1", "b": "3", "c": "4"}), (2, "keep", None, None), (3, "z", "y", None)]
    assert rows(graph.replace_nodes(old.drop("extras"), new.drop("extras"), "seq")) == [(1, None, "u2"), (2, "keep", None), (3, "z", None)]


def test_forgetting(spark):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    t = lambda day: f"2024-{day} 00:00:00"
    x = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    n = spark.createDataFrame(
        [
            (1, "semantic", None, t("05-01"), t("04-01"), 0, "due", ["a"]), (2, "semantic", True, None, "2023-01-01 00:00:00", 0, "old", ["a"]), (3, "semantic", False, t("05-01"), t("04-01"), 0, "not live", ["a"]),
            (4, "observation", True, t("05-01"), t("04-01"), 0, "no tier", ["a"]), (5, "semantic", None, None, t("05-20"), 0, x, ["a", "b"]), (6, "semantic", True, None, t("05-25"), 0, x, ["a", "c"]), (7, "semantic", True, None, None, 0, "no date", []),
            (8, "semantic", True, None, t("02-20"), 0, "cool", ["q"]),
        ], "id long, tier string, is_latest boolean, forget_after string, at string, accesses int, text string, concepts array<string>",
    ).withColumn("forget_after", F.to_timestamp("forget_after")).withColumn("at", F.to_timestamp("at"))
    plan = memory.forget_plan(n, now)
    assert rows(plan) == [(1, "delete", "ttl_expired", None), (2, "demote", "retention_frozen", None), (5, "demote", "contradiction", 6), (6, "keep", None, None), (7, "keep", None, None), (8, "keep", None, None)]
    assert (8, "demote", "retention_frozen", None) in rows(memory.forget_plan(n, now, band="cold"))
    assert rows(memory.forget_stats(n, plan)) == [(8, 6, 1, 2, 1)]
    assert {r.id: r.is_latest for r in memory.apply_forget_plan(n, plan).collect()} == {2: False, 3: False, 4: True, 5: False, 6: True, 7: True, 8: True}
    edges = spark.createDataFrame([(1, 2), (2, 5), (6, 1)], "source long, target long")
    gone = plan.unionByName(spark.createDataFrame([(99, "demote", "x", None)], plan.schema))
    e, v, errors = memory.forget_rest(edges, n.select("id"), n, gone)
    assert rows(e) == [(2, 5)] and 1 not in {r.id for r in v.collect()} and rows(errors) == [(99, "node missing at demote time")]


def test_infinite_components_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [0.0, float("-inf")]), (4, [0.0, 1.0])], "vec_id long, vector array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "vector")
    assert {(r.query_id, r.vec_id) for r in vectors.search(q, v, vectors.l2, 3).collect()} == {(1, 1), (1, 4), (4, 1), (4, 4)}
