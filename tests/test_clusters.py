import numpy as np
import pytest

from graphloom.operators import clusters


def sequential(rows, least, fewest, most):
    """Entry after entry, as a single loop."""
    out = set()
    for w in {r[0] or "" for r in rows}:
        xs = sorted([r for r in rows if (r[0] or "") == w and r[3] is not None], key=lambda r: (r[2], r[1]))
        v = np.array([r[3] for r in xs], float).reshape(len(xs), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n == 0, 1, n)
        free = np.ones(len(xs), bool)
        for i in range(len(xs)):
            if not free[i]:
                continue
            near = [j for j in range(i + 1, len(xs)) if free[j] and v[i] @ v[j] >= least]
            if len(near) + 1 < fewest:
                continue
            if most is not None and len(near) + 1 > most:
                near = sorted(near, key=lambda j: -(v[i] @ v[j]))[: most - 1]
            free[i] = False
            free[near] = False
            out |= {(w, xs[i][1], xs[j][1], place) for place, j in enumerate([i, *near])}
    return out


@pytest.mark.parametrize("fewest,most", [(1, None), (3, 6), (5, 100), (2, 2)])
def test_rounds_equal_the_sequential_loop(spark, fewest, most):
    rng = np.random.default_rng(fewest)
    base = rng.normal(size=(12, 6))
    rows = [("w0" if i % 3 else "hot" if i % 2 else None, i * 7 % 240, int(rng.integers(0, 60)), (base[rng.integers(0, 12)] + 0.5 * rng.normal(size=6)).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "workspace string, id long, at long, vector array<double>").repartition(3)
    got = {tuple(r) for r in clusters.greedy_clusters(df, 0.8, fewest, most).collect()}
    assert got == sequential(rows, 0.8, fewest, most) and len(got) > 40


def test_chain_and_small_blocks(spark):
    """Each entry is like the next one alone, so one decides after the other; blocks of four."""
    rows = [("w", i, i, [float(np.cos(i * 0.1)), float(np.sin(i * 0.1))]) for i in range(24)]
    df = spark.createDataFrame(rows, "workspace string, id long, at long, vector array<double>")
    assert {tuple(r) for r in clusters.subject_clusters(df, 0.99).collect()} == sequential(rows, 0.99, 1, None)
    e = clusters._key(df)
    small, large = ({(r.a.id, r.b.id) for r in clusters.similar_pairs(e, 0.9, n).collect()} for n in (4, 2048))
    assert small == large == {(i, j) for i in range(24) for j in range(i + 1, 24) if np.cos((j - i) * 0.1) >= 0.9}


def test_odd_rows(spark):
    rows = [("w", 1, 1, None), ("w", 2, 1, [float("nan"), 1.0]), ("w", 3, 1, [0.0, 0.0]), ("w", 4, 1, [1.0]), ("w", 5, 1, []), ("w", 6, 2, [1.0, 0.0]), ("w", 7, 3, [1.0, 0.0]), ("w", 7, 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "workspace string, id long, at long, vector array<double>")
    assert {tuple(r) for r in clusters.greedy_clusters(df, 0.8, 2, 9).collect()} == {("w", 6, 6, 0), ("w", 6, 7, 1)}
    assert {r.cluster for r in clusters.subject_clusters(df).collect()} == {3, 4, 6}
    assert clusters.greedy_clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("fewest,most", [(1, None), (3, None), (3, 5), (2, 2), (6, 3), (3, 1)])
def test_blocks_and_short_lists_equal_the_sequential_loop(spark, monkeypatch, fewest, most):
    """Blocks of 16 and lists that run dry, with copies; no table of all similar pairs is made."""
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "PART", 32)
    monkeypatch.setattr(clusters, "LISTED", 1)
    monkeypatch.setattr(clusters, "similar_pairs", None)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 5))
    rows = [("hot", i, i // 2, (base[rng.integers(0, 4)] + (i % 3 > 0) * 0.3 * rng.normal(size=5)).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "workspace string, id long, at long, vector array<double>").repartition(3)
    got = [tuple(r) for r in clusters.greedy_clusters(df, 0.8, fewest, most).collect()]
    assert set(got) == sequential(rows, 0.8, fewest, most) and len(got) == len(set(got))
