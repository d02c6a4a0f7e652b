import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_round_sends_vectors_and_not_rows(spark, monkeypatch, kind):
    """Ranks equal a plain loop whatever the ids are and with edges in many pieces; a round stores a row for each bucket, none for each node."""
    rng = np.random.default_rng(5)
    n = 300
    a, b, w = rng.integers(0, n, 4000), rng.integers(0, n, 4000) // 2, rng.integers(0, 9, 4000) / 3
    pairs = [(int(x), int(y), float(z)) for x, y, z in zip(a, b, w, strict=True)]
    odd = [(None, 3, 1.0), (5, None, 1.0), (n + 1, None, 2.0), (4, 6, None)]  # an edge without an end leads nowhere and takes its share
    seeds = [(i, float(i % 4)) for i in range(0, n, 7)] + [(n + 5, 2.0), (7, 1.0)]
    m, out, p = np.zeros((n + 10, n + 10)), np.zeros(n + 10), np.zeros(n + 10)
    for x, y, z in pairs:
        m[y, x] += z
        out[x] += z
    out[5] += 1
    for i, x in seeds:
        p[i] += x
    p, ends = p / p.sum(), m.sum(0) == 0
    r = p
    for _ in range(8):
        new = 0.85 * (m @ np.divide(r, out, out=np.zeros(n + 10), where=out > 0) + r[ends].sum() * p) + 0.15 * p
        moved, r = np.abs(new - r).sum(), new
        if moved < 1e-6:
            break
    rows, plain = [], graph.Scratch.round

    def counted(self, df, number):
        got = plain(self, df, number)
        rows.append(got.count())
        return got

    monkeypatch.setattr(graph.Scratch, "round", counted)
    for name, value in (("BUCKETS", 2), ("BUCKET", 200), ("PIECE", 100)):
        monkeypatch.setattr(graph, name, value, raising=False)
    e = spark.createDataFrame(pairs + odd, "source long, target long, weight double").select(F.col("source").cast(kind), F.col("target").cast(kind), "weight")
    s = spark.createDataFrame(seeds, "id long, p double").select(F.col("id").cast(kind), "p")
    ranks = graph.personalized_pagerank(e, s, rounds=8)
    assert dict(ranks.dtypes) == {"id": "bigint" if kind == "long" else kind, "rank": "double"}
    got = {int(x.id): x["rank"] for x in ranks.collect()}
    assert set(got) == {x for t in pairs if t[2] > 0 for x in t[:2]} | {i for i, _ in seeds} | {3, n + 1}
    assert all(abs(got.get(i, 0.0) - r[i]) < 1e-9 for i in range(n + 10))
    assert rows and max(rows) <= 20
