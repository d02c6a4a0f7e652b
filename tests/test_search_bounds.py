import numpy as np
import pytest

from graphloom.operators import vectors


@pytest.mark.parametrize("earlier", [False, True])
def test_search_works_on_bounded_pieces(spark, earlier):
    """No measure sees more than PAIRS distances at once; rows are those of all pairs, copies and float queries on double vectors included."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (3000, 4)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, vector array<double>").repartition(2)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 2)], "query_id long, vector array<float>")
    most = vectors.PAIRS

    def measure(a, b):
        assert len(a) * len(b) <= most and a.dtype == b.dtype == np.float64
        return np.abs(a[:, None] - b[None]).sum(2)

    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in vectors.best(vectors.search(q, v, measure, 7, earlier=earlier), 7).collect()}
    want = {}
    for i in range(0, 3000, 2):
        d = np.abs(x - x[i]).sum(1)
        n = i if earlier else 3000
        want |= {(i, k + 1): (int(j), float(d[j])) for k, j in enumerate(np.lexsort((np.arange(n), d[:n]))[:7])}
    assert got == want
