import random

from graphloom.operators.ranking import rrf_sweep


def test_topics_give_what_pairs_give(spark):
    """Queries of many, few and no relevant ids, ids of several topics and repeated rows, against the pairs themselves."""
    r = random.Random(3)
    topics = [(t, i) for i in range(60) for t in {r.randrange(3)} | ({3} if i < 6 else set()) | ({5} if i in (7, 14) else set())] + [(4, 12), (4, 12), (None, 18)]
    qrels = [(q, t) for q in range(0, 60, 3) for t in ({0: [3], 1: [4], 2: [5], 3: [0, 3], 4: [None], 5: [3, 4, 5]}.get(q // 3 % 7, [1]))]
    pairs = {(q, i) for q, t in qrels for u, i in topics if t is not None and t == u and q != i}
    lists = [[(q, i, k) for q in range(0, 60, 3) for k, i in enumerate(r.sample(range(60), 20))] for _ in range(2)]
    a, b = (spark.createDataFrame(x, "query_id long, id long, rank int") for x in lists)
    plain = rrf_sweep(a, b, spark.createDataFrame(sorted(pairs), "query_id long, id long"), [10, 60], [0.2, 0.8])
    by_topic = rrf_sweep(a, b, spark.createDataFrame(qrels, "query_id long, topic int"), [10, 60], [0.2, 0.8], topics=spark.createDataFrame(topics, "topic int, id long"))
    want = {tuple(x) for x in plain.collect()}
    assert {tuple(x) for x in by_topic.collect()} == want and len(want) == 4 and all(0 < x[2] < 1 for x in want)
