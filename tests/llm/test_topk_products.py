import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.topk_products import OP12_SQL, Block, op12_topk_products, top_products

SF = "/root/testdata/sf0.001"


def plain(rows, k=20, asked=lambda i: i % 20 == 0, scale=64.0):
    """All products in Python integers; a query leaves out one row of its own id and vector."""
    good = [(i, tuple(int(np.floor(scale * float(c))) for c in e)) for i, e in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)]
    out = []
    for at, (i, a) in enumerate(good):
        if asked(i):
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for n, (j, b) in enumerate(good) if n != at and len(a) == len(b))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, label int, VEC_ID string")
    got = top_products(df, F.col("vec_id") % 20 == 0, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op12_topk_products(spark, SF).collect()) == sorted(con.execute(OP12_SQL).fetchall())


@pytest.mark.parametrize("seed", [0, 1])
def test_lengths_groups_copies_and_ties(spark, monkeypatch, seed):
    """Lengths over three orders, tight groups, copies of a third of the rows, small integers with many ties; several blocks and slices."""
    monkeypatch.setattr("graphloom.llm.topk_products.BLOCK", 256)
    monkeypatch.setattr("graphloom.llm.topk_products.BUCKET", 64)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, 8)) * 10 ** rng.uniform(-2, 1, (900, 1))
    x[300:600] = x[rng.integers(0, 5, 300)] + rng.normal(size=(300, 8)) * 1e-3
    x[600:900] = x[0]
    x[250:300] = rng.integers(-2, 3, (50, 8)) / 64
    assert run(spark, list(enumerate(x.tolist()))) == plain(list(enumerate(x.tolist())))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [3.0, -1.0]), (40, [0.0, 0.0]), (60, None), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (None, [9.0, 9.0]), (140, []), (160, []), (180, [1.0]), (1, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, -1.0]), (-20, [-5.0, 0.5]), (220, [1e6, -1e6]), (3, [1e6, 1e6])]
    got = run(spark, rows)
    assert got == plain(rows)
    assert [r for r in got if r[0] == 140] == [(140, 1, 160, 0)] and not [r for r in got if r[0] == 180]
    assert run(spark, rows, k=1) == plain(rows, k=1)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    big = [(0, [1e300, 1.0]), (20, [-1e300, 2.0])]
    assert run(spark, big) == [(0, 1, 20, -(2**54) + 64 * 128), (20, 1, 0, -(2**54) + 64 * 128)]


def test_all_prunings_are_used_and_lose_nothing():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    x = np.floor(64 * np.concatenate([base[rng.integers(0, 20, 3000)] + 0.02 * rng.normal(size=(3000, 16)), 0.1 * rng.normal(size=(1000, 16))])).astype(np.int64)
    q = np.floor(64 * np.concatenate([base, rng.normal(size=(20, 16))])).astype(np.int64)
    n2 = (x**2).sum(1)
    order = np.argsort(-n2, kind="stable")
    block = Block([str(k) for k in range(len(q))], q, (q**2).sum(1), np.full(len(q), np.iinfo(np.int64).min), 21)
    for at in range(0, len(x), 256):
        rows = order[at : at + 256]
        block.meet(x[rows], n2[rows], rows.astype(np.int64), np.arange(len(rows) + 1))
    assert min(block.used.values()) > 0
    score = q @ x.T
    want = {(k, int(j)) for k in range(len(q)) for j in np.lexsort((np.arange(len(x)), -score[k]))[:21]}
    assert set(zip(block.best.query.tolist(), block.best.ident.tolist(), strict=True)) == want


def test_check_tables_by_the_thousand(spark):
    """The larger test table against products in numpy."""
    p = "/root/testdata/sf0.1/embeddings.parquet"
    assert os.path.exists(p)
    rows = spark.read.parquet(p).select("vec_id", "embedding").collect()
    v = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in op12_topk_products(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        o = [j for j in np.lexsort((ids, -s)) if j != k][:20]
        assert sorted(got[ids[k]]) == [(n + 1, ids[j], s[j]) for n, j in enumerate(o)]
