import contextlib
import io

import numpy as np
from pyspark.sql import DataFrame

from graphloom.operators import graph


def test_edges_stay_where_they_lie(spark, monkeypatch):
    """Ranks of a graph with hubs, dangling and repeated edges equal a plain loop; a round's plan deals no edges anew."""
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 900), rng.integers(0, 12, 900) ** 2, rng.integers(-1, 5, 900), strict=True)]
    seeds = [(i, float(i % 3)) for i in range(0, 80, 5)]
    m, out = np.zeros((130, 130)), np.zeros(130)
    for a, b, w in pairs:
        m[b, a] += max(w, 0)
    out = m.sum(0)
    p = np.zeros(130)
    for i, x in seeds:
        p[i] += x
    p /= p.sum()
    r = p
    for _ in range(50):
        new = 0.85 * (m @ np.divide(r, out, out=np.zeros(130), where=out > 0) + r[out == 0].sum() * p) + 0.15 * p
        moved, r = np.abs(new - r).sum(), new
        if moved < 1e-6:
            break
    plans, plain = [], graph.Scratch.round

    def seen(self, df: DataFrame, number: int) -> DataFrame:
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain()
        plans.append(text.getvalue())
        return plain(self, df, number)

    monkeypatch.setattr(graph.Scratch, "round", seen)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e, s = spark.createDataFrame(pairs, "source long, target long, weight double"), spark.createDataFrame(seeds, "id long, p double")
        got = {x.id: x["rank"] for x in graph.personalized_pagerank(e, s).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert all(abs(got.get(i, 0.0) - r[i]) < 1e-9 for i in range(130)) and len(got) > 60
    import re
    top = plans[1].split("InMemoryRelation")[0]
    assert not re.search(r"Exchange hashpartitioning\(cell#\d+, source#", plans[1]), plans[1]
    assert "InMemoryTableScan" in top
