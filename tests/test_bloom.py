import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import bloom


def plain_indexes(value, m, k):
    h = []
    for seed in (0x811C9DC5, 0xDEADBEEF):
        x = seed
        for b in value.encode():
            x = (x ^ b) * 0x01000193 % 2**32
        h.append(x)
    return [(h[0] + i * h[1]) % 2**32 % m for i in range(k)]


def test_indexes_and_known_hashes():
    some = ["", "a", "foobar", "Ünïcode", "x" * 300, "a", "日本"]
    assert bloom.fnv_indexes(pa.array(some), 1009, 7).tolist() == [plain_indexes(s, 1009, 7) for s in some]
    assert bloom.fnv_indexes(pa.array(["", "a", "foobar"]), 1 << 26, 1)[:, 0].tolist() == [x % (1 << 26) for x in (0x811C9DC5, 0xE40C292C, 0xBF9CF968)]
    assert bloom.fnv_indexes(pa.array(["b", *some]).slice(1), 64, 3).tolist() == [plain_indexes(s, 64, 3) for s in some]
    assert bloom.fnv_indexes(pa.array([], pa.string()), 64, 3).shape == (0, 3)


def test_shapes():
    assert bloom.optimal_params(1000, 0.01) == (9592, 7) and bloom.optimal_params(0, 2) == bloom.optimal_params(1, 0.01)
    assert bloom.optimal_params(10**12)[0] == 1 << 26
    for m, k in ((7, 1), (64, 0), (64, 33), ((1 << 26) + 1, 1)):
        with pytest.raises(ValueError):
            bloom.check_shape(m, k)


def test_build_probe_union_estimate(spark):
    m, k = bloom.optimal_params(2000, 0.01)
    rows = [("a", f"in-{i}") for i in range(2000)] * 2 + [("b", f"other-{i}") for i in range(500)] + [("a", None), (None, "lone")]
    v = spark.createDataFrame(rows, "filter string, value string").repartition(5)
    f = bloom.bloom_build(v, m, k)
    asked = spark.createDataFrame([("a", f"in-{i}") for i in range(2000)] + [("a", f"out-{i}") for i in range(4000)] + [("none", "x"), (None, "lone"), (None, "in-1"), ("a", None), ("a", "in-1")], "filter string, value string")
    got = {(r["filter"], r.value): r.maybe for r in bloom.bloom_probe(f, asked, m, k).collect()}
    assert all(got["a", f"in-{i}"] for i in range(2000))  # no false negative
    assert sum(got["a", f"out-{i}"] for i in range(4000)) / 4000 < 0.035
    assert got["none", "x"] is False and got[None, "lone"] and len(got) == 6003
    bits = np.zeros(m, bool)
    bits[[i for n in range(2000) for i in plain_indexes(f"in-{n}", m, k)]] = True
    e = {r["filter"]: r for r in bloom.bloom_estimate(f).collect()}
    assert e["a"].set_bits == bits.sum() and abs(e["a"].estimate - 2000) < 500 and abs(e["b"].estimate - 500) < 125  # both hashes are near each other on counted names
    data = {r["filter"]: r.bytes for r in bloom.bloom_bytes(f).collect()}
    assert np.unpackbits(np.frombuffer(data["a"], np.uint8), bitorder="little")[:m].astype(bool).tolist() == bits.tolist() and len(data["b"]) == -(-m // 8)
    both = bloom.bloom_union(f.withColumn("filter", F.lit("all")), bloom.bloom_build(spark.createDataFrame([("all", "new")], "filter string, value string"), m, k))
    asked = spark.createDataFrame([("all", "new"), ("all", "in-7"), ("all", "other-9")], "filter string, value string")
    assert all(r.maybe for r in bloom.bloom_probe(both, asked, m, k).collect())
    with pytest.raises(ValueError, match="different shape"):
        bloom.bloom_union(f, bloom.bloom_build(v, m + 8, k))


def test_full_and_empty(spark):
    v = spark.createDataFrame([("f", str(i)) for i in range(200)], "filter string, value string")
    r = bloom.bloom_estimate(bloom.bloom_build(v, 8, 3)).first()
    assert r.set_bits == 8 and math.isinf(r.estimate)
    assert bloom.bloom_build(v.limit(0), 64, 3).count() == 0 and bloom.bloom_probe(bloom.bloom_build(v.limit(0), 64, 3), v.limit(3), 64, 3).filter("maybe").count() == 0
