import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import models


def docs(spark):
    return spark.createDataFrame([(i, f"topic{i % 7} word{i} shared text about things number {i}") for i in range(40)] + [(100, None), (101, "")], "id long, text string")


def test_defaults_and_own_models(spark):
    d = docs(spark)
    v = {r.id: r.v for r in d.select("id", models.embed(F.col("text")).alias("v")).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 for i, x in v.items() if i < 100) and not any(v[100]) and not any(v[101])

    def lengths(batches):
        loaded = 2.0  # once a task
        for s in batches:
            yield pd.Series([[loaded * len(t or "")] for t in s])

    assert [r.v for r in d.filter("id < 2").orderBy("id").select(models.embed(F.col("text"), lengths).alias("v")).collect()] == [[2.0 * len(f"topic{i} word{i} shared text about things number {i}")] for i in range(2)]
    s = d.filter("id = 3").select(models.cross_score(F.lit("word3 things"), F.col("text")).alias("near"), models.cross_score(F.lit("zebra"), F.col("text")).alias("far")).first()
    assert s.near > 0.3 > abs(s.far)
    one = d.limit(1).select(models.summarise(F.array(F.lit("First one. More."), F.lit(" "), F.lit("Second! x"), F.lit("third"))).alias("s")).first()
    assert one.s == "First one. Second! third"


def test_explore_from_text(spark):
    d = docs(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 39)] + [(5, 999), (7, 7)], "source long, target long")
    q = spark.createDataFrame([(1, "word20 topic6"), (2, "word3"), (3, "")], "query_id long, text string")
    hits = {}
    for r in models.hybrid_search(q, d, 2).collect():
        hits.setdefault(r.query_id, set()).add(r.id)
    assert 20 in hits[1] and 3 in hits[2]
    got = {}
    for r in models.explore(q, d, edges, 2, 2).collect():
        got.setdefault(r.query_id, {})[r.id] = r.hop
    for k, starts in hits.items():
        want = {i: min(abs(i - s) for s in starts if s < 40) for i in range(40) if any(s < 40 and abs(i - s) <= 2 for s in starts)} | {s: 0 for s in starts}
        assert got[k] == want
