import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.frames import shared_folder
from graphloom.operators.folds import Recent, reuse_replay, token_bucket, ttl_hits
from graphloom.streaming import run_once
from graphloom.streaming.state import recent_reuse_stream, token_bucket_stream


def plain_bucket(rows, rate, burst, idle):
    state, out = {}, {}
    for t, peer, i in sorted(rows):
        tokens, last = state.get(peer, (burst, t))
        if t - last > idle:
            tokens, last = burst, t
        have = min(burst, tokens + (t - last) * rate)
        out[i] = have >= 1
        state[peer] = (have - out[i], t)
    return out


def requests(n=600):
    rng, t, rows = random.Random(4), 86_400.0, []
    for i in range(n):
        t += rng.choice([0.0, 0.25, 0.5, 3.0, 40.0])
        rows.append((t, "hot" if rng.random() < 0.5 else f"p{rng.randrange(6)}", i))
    return rows


def landed(spark, df, by, parts):
    """The rows as files that come one after the other."""
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4()}"
    rows = sorted(df.collect(), key=lambda r: r[by])
    size = -(-len(rows) // parts)
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_token_bucket_batch_and_stream_equal_the_plain_loop(spark):
    rows = requests()
    want = plain_bucket(rows, 0.5, 3, 60)
    assert not all(want.values())
    df = spark.createDataFrame([(p, t, i) for t, p, i in rows], "peer string, t double, id long")
    assert {r.id: r.allowed for r in token_bucket(df.repartition(5), 0.5, 3, 60).collect()} == want
    stream = df.select("peer", "id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    for parts in (1, 5):
        got = run_once(token_bucket_stream(landed(spark, stream, "ts", parts)(), 0.5, 3, 60, "1 second"), "append").collect()
        assert {r.id: r.allowed for r in got} == want and len(got) == len(want)


def test_token_bucket_stream_goes_on_after_a_restart(spark):
    rows = requests(300)
    want = plain_bucket(rows, 0.5, 3, 60)
    df = spark.createDataFrame([(p, i, t) for t, p, i in rows], "peer string, id long, t double").select("peer", "id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    folder, every = f"{shared_folder(spark)}/restart-{uuid.uuid4()}", sorted(df.collect(), key=lambda r: r["ts"])
    got = []
    for part in (every[:100], every[100:101], every[101:]):  # a new query each time, from the same checkpoint
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = token_bucket_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), 0.5, 3, 60, "1 second")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        q.foreachBatch(lambda b, i: got.extend(b.collect())).start().awaitTermination()
    assert {r.id: r.allowed for r in got} == want and len(got) == len(want)


def plain_reuse(rows, ttl, threshold, keep):
    live, out = {}, {}
    for t, w, i, v in sorted(rows, key=lambda r: (r[0], r[2])):
        cache = [e for e in live.get(w, []) if t - e[0] <= ttl]
        sims = [(-round(float(np.dot(e[2], v)), 6), e[1]) for e in cache if e[0] < t]
        best = min(sims, default=(1.0, None))
        hit = best[1] is not None and -best[0] >= threshold
        out[i] = (best[1], -best[0]) if hit else (None, None)
        live[w] = cache + ([(t, i, v)] if keep or not hit else [])
    return out


@pytest.mark.parametrize("keep", [True, False])
def test_reuse_batch_and_stream_equal_the_plain_loop(spark, keep):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 8))
    rows = []
    for i in range(240):
        v = base[i % 4] + 0.4 * rng.normal(size=8)
        rows.append((86_400.0 + i // 2 * 7 % 500, f"w{i % 3}", i, (v / np.linalg.norm(v)).tolist()))
    want = plain_reuse(rows, 60.0, 0.8, keep)
    assert 20 < sum(v[0] is not None for v in want.values()) < 230
    df = spark.createDataFrame([(w, i, t, v) for t, w, i, v in rows], "workspace string, query_id long, t double, vector array<double>")
    assert {r.query_id: (r.source, r.sim) for r in reuse_replay(df, 60.0, 0.8, keep).collect()} == want
    stream = df.select("workspace", "query_id", F.timestamp_seconds("t").alias("ts"), "vector")
    for parts in (1, 4):
        got = run_once(recent_reuse_stream(landed(spark, stream, "ts", parts)(), 60.0, 0.8, keep, "1 second"), "append").collect()
        assert {r.query_id: (r.source, r.sim) for r in got} == want


def test_entries_end_with_their_time():
    r = Recent(60, 0.9)
    assert r.ask(0, 1, [1.0, 0.0]) == (None, None) and r.ask(60, 2, [1.0, 0.0]) == (1, 1.0)
    assert r.ask(120.5, 3, [1.0, 0.0]) == (None, None) or r.ids == [2, 3]
    lone = Recent(60, 0.9)
    lone.ask(0, 1, [1.0, 0.0])
    assert lone.ask(60.5, 2, [1.0, 0.0]) == (None, None)
    assert lone.ask(61, 3, None) == (None, None) and lone.ask(61, 4, [1.0, 0.0, 0.0]) == (None, None)


def test_ttl_hits(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 5.0), ("a", 10.0), ("a", 11.0), ("b", 3.0), ("a", 22.0)], "key string, t double")
    assert {(r.key, r.t): r.hit for r in ttl_hits(df, 10).collect()} == {("a", 0): False, ("a", 5): True, ("a", 10): True, ("a", 11): False, ("a", 22): False, ("b", 3): False}
