from pyspark.sql import functions as F

from graphloom.operators import retrieval


def shuffled_rows(spark):
    g = spark.sparkContext._gateway
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    s = spark._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return {s.apply(i).stageId(): s.apply(i).shuffleWriteRecords() for i in range(s.size())}


def test_postings_go_to_their_parts_in_one_shuffle(spark):
    word = lambda i, j: F.concat(F.lit("w"), ((F.col(i) * 7 + j * j) % 1999).cast("string"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[word("id", j) for j in range(30)]).alias("text"))
    queries = spark.range(2000).select(F.col("id").alias("query_id"), F.concat_ws(" ", *[word("id", j) for j in range(6)]).alias("text"))
    n = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " ")))).count()
    before = shuffled_rows(spark)
    assert retrieval.bm25_topk(queries, docs, 3).count() == 6000
    assert n <= sum(r for i, r in shuffled_rows(spark).items() if i not in before) < 2 * n  # counting needs no shuffle: ids of a range lie together


def test_null_ids_and_small_parts_rank_as_one_part(spark, monkeypatch):
    docs = [(i if i % 9 else None, " ".join(f"w{(i * 5 + j) % 13}" for j in range(2 + i % 6))) for i in range(90)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i % 13} w{i * 3 % 13} w{i * 7 % 13}") for i in range(20)], "query_id long, text string")
    both = []
    for sizes in ({}, {"ASKED": 16, "PART": 32, "LEAST_PART": 8, "CELLS": 16}):
        for name, size in sizes.items():
            monkeypatch.setattr(retrieval, name, size)
        both.append(sorted((r.query_id, r["rank"], r.doc_id is None, r.doc_id, r.score) for r in retrieval.bm25_topk(queries, docs, 5).collect()))
    assert both[0] == both[1] and len(both[0]) == 100 and any(r[2] for r in both[0])
