from math import log2

from pyspark.sql import functions as F

from graphloom.operators import evaluation


def test_judgments_are_read_once_and_ties_count_together(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rel = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (1, 12), (1, None), (2, 10)], "query_id long, doc_id long").withColumn("grade", F.rand()).filter(F.xxhash64("grade") != 0)
    hits = spark.createDataFrame([(1, 10, 1), (1, 5, 2), (1, 11, 3), (1, 12, 3), (1, None, 4), (2, 10, 11), (3, 10, 1)], "query_id long, doc_id long, rank int")
    m = evaluation.retrieval_metrics(q, hits, rel)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    got = {r.query_id: r for r in m.collect()}
    ideal = sum(1 / log2(i + 1) for i in range(1, 5))
    assert tuple(got[1]) == (1, 0.75, 1, round((1 + 2 / log2(4)) / ideal, 6), 1.0, round((1 + 3 / 3 + 3 / 3) / 4, 6))
    assert tuple(got[2]) == (2, 0.0, 0, 0.0, 0.0, 0.0) and tuple(got[3]) == (3, 0.0, 0, 0.0, 0.0, 0.0)
