from collections import Counter
from math import floor, log

import pytest
from pyspark.sql import functions as F

from graphloom.operators import retrieval

QUERY, DOC = "query_id string, text string", "doc_id long, text string"


def plain_bm25(queries, docs, k):
    docs = [(i, t and t.split()) for i, t in docs]
    known = [t for _, t in docs if t is not None]
    average = sum(map(len, known)) / len(known)
    tf = Counter((i, len(t), w) for i, t in docs if t for w in t)  # rows with one id and length are one
    df = Counter(w for _, _, w in tf)
    score = Counter()
    for q, w in {(q, w) for q, t in queries if t for w in t.split()}:
        for (i, n, v), c in tf.items():
            if v == w:
                score[q, i] += log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / average))
    out = {}
    for (q, i), s in sorted(score.items(), key=lambda x: (x[0][0], -floor(x[1] * 1e6 + 0.5), x[0][1])):
        out.setdefault(q, []).append((i, floor(s * 1e6 + 0.5) / 1e6))
    return {q: x[:k] for q, x in out.items()}


@pytest.mark.parametrize("sizes", [{}, {"ASKED": 40, "PART": 64, "LEAST_PART": 8, "CELLS": 16}])
def test_parts_keep_the_best_of_all(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(retrieval, name, size)
    words = lambda i, n: " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(n))
    docs = [(i, words(i % 40, 3 + i % 9)) for i in range(160)]  # copies tie
    docs += [(7, docs[7][1]), (7, docs[7][1]), (8, "w1 w2 w2"), (200, None), (201, ""), (202, "zz")]  # ids and rows repeat
    queries = [(f"q{i}", words(i, 1 + i % 6)) for i in range(30)] + [("q3", words(5, 4)), ("q3", words(3, 4)), ("none", "unknown"), ("null", None)]
    got = {}
    for r in sorted(retrieval.bm25_topk(spark.createDataFrame(queries, QUERY), spark.createDataFrame(docs, DOC), 7).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = plain_bm25(queries, docs, 7)
    assert got.keys() == want.keys()
    for q, x in got.items():
        assert [i for i, _ in x] == [i for i, _ in want[q]] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(x, want[q], strict=True))


def shuffled_rows(spark):
    g = spark.sparkContext._gateway
    s = spark._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return {s.apply(i).stageId(): s.apply(i).shuffleWriteRecords() for i in range(s.size())}


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), (F.col("id") % 50).cast("string")).alias("text"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.lit("common").alias("text"))
    before = shuffled_rows(spark)
    assert retrieval.bm25_topk(queries, docs).count() == 3000
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    assert sum(n for i, n in shuffled_rows(spark).items() if i not in before) < 400 * 300 / 4
