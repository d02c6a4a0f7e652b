from pyspark.sql import functions as F

from graphloom.operators import memory


def test_round_trip(spark):
    """Candidates, clusters, memories, marks, prune: what is done is not gathered again."""
    rows = [(i, "w", None, None, None, f"2024-01-{i + 1:02d}") for i in range(6)] + [(10, "w", "consolidated_memory", None, None, None), (11, None, None, None, "2024-02-01", None), (12, "w", None, "2024-03-01", None, None)]
    nodes = spark.createDataFrame(rows, "id long, workspace string, kind string, consolidated_at string, timestamp string, fetched_at string")
    vectors = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in (0, 1, 2, 3, 4, 5, 10, 11, 12)], "id long, vector array<double>")
    e = memory.consolidation_candidates(nodes, vectors)
    assert {(r.id, r["at"]) for r in e.collect()} == {(i, f"2024-01-{i + 1:02d}") for i in range(6)} | {(11, "2024-02-01")}
    assert memory.consolidation_candidates(nodes, vectors, "w").count() == 6
    made = memory.greedy_clusters(e, 0.8, 5, 100)
    done = memory.consolidated(made, made.select("workspace", "cluster").distinct().withColumn("summary", F.lit("all of it")))
    assert [r.sources for r in done.collect()] == [[str(i) for i in range(6)]]
    marked = memory.mark_consolidated(nodes, done, F.lit("2024-04-01"))
    assert memory.consolidation_candidates(marked, vectors).count() == 1
    assert {tuple(r) for r in memory.consolidation_status(marked).collect()} == {("w", 0, 7, 1), ("(no workspace)", 1, 0, 0)}
    n, links, v = memory.consolidation_prune(marked, spark.createDataFrame([(0, 10), (10, 11)], "source long, target long"), vectors)
    assert {r.id for r in n.collect()} == {10, 11} == {r.id for r in v.collect()} and [tuple(r) for r in links.collect()] == [(10, 11)]
