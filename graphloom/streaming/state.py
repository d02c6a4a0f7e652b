"""Streaming jobs with state of their own: token buckets and recent answers, by transformWithState.

The state store must be RocksDB (store()). A micro-batch's rows of a key are taken in time order; what is older than the
watermark is dropped by Spark. Each key has one event-time timer, moved on with its last row, that deletes the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from graphloom.operators.folds import Bucket, Recent

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    """The state store that states of many variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Timed(StatefulProcessor):
    """Keeps one timer a key, at its last row plus `live` seconds."""

    live = 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def move(self, last: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(t[0]) if isinstance(t, (tuple, list)) else int(t))
        self.handle.registerTimer(int((last + self.live) * 1000) + 1)

    def close(self) -> None:
        pass


class BucketState(_Timed):
    def __init__(self, rate: float, burst: float, idle: float):
        self.rate, self.burst, self.live = rate, burst, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        x = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        bucket = Bucket(self.rate, self.burst, self.live, *(self.state.get() if self.state.exists() else ()))
        allowed = bucket.take(x["t"].tolist())
        self.state.update((bucket.tokens, bucket.last))
        self.move(bucket.last)
        yield pd.DataFrame({"peer": key[0], "id": x["id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()


class RecentState(_Timed):
    def __init__(self, ttl: float, threshold: float, keep_hits: bool):
        self.live, self.threshold, self.keep_hits = ttl, threshold, keep_hits

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getListState("entries", "t double, id long, vector array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        x = pd.concat(list(rows)).sort_values(["t", "query_id"], kind="stable")
        entries = [tuple(e) for e in self.state.get()] if self.state.exists() else []
        recent = Recent(self.live, self.threshold, self.keep_hits, entries)
        hits = [recent.ask(t, int(i), v) for t, i, v in zip(x["t"], x["query_id"], x["vector"], strict=True)]
        kept = list(zip(recent.times, recent.ids, [[float(c) for c in v] for v in recent.vectors], strict=True))
        if kept:
            self.state.put(kept)
            self.move(max(recent.times))
        else:
            self.state.clear()
        yield pd.DataFrame({"workspace": key[0], "query_id": x["query_id"].to_numpy(), "source": pd.array([h[0] for h in hits], "Int64"), "sim": pd.array([h[1] for h in hits], "Float64")})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()


def _schema(stream: DataFrame, **columns: str) -> StructType:
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    return ", ".join(f"{n} {kinds.get(k, k)}" for n, k in columns.items())


def token_bucket_stream(requests: DataFrame, rate: float, burst: float, idle: float = 300.0, late: str = "0 seconds") -> DataFrame:
    """requests(peer, id, ts) as a stream -> peer, id, allowed of each request as it arrives, by the rule of token_bucket()."""
    store(requests.sparkSession)
    rows = requests.withWatermark("ts", late).selectExpr("peer", "id", "unix_micros(ts) / 1e6 as t", "ts")
    return rows.groupBy("peer").transformWithStateInPandas(BucketState(rate, burst, idle), _schema(requests, peer="peer", id="id", allowed="boolean"), "Append", "EventTime")


def recent_reuse_stream(queries: DataFrame, ttl: float = 60.0, threshold: float = 0.92, keep_hits: bool = False, late: str = "0 seconds") -> DataFrame:
    """queries(workspace, query_id, ts, vector) as a stream -> workspace, query_id, source, sim, by the rule of reuse_replay()."""
    store(queries.sparkSession)
    rows = queries.withWatermark("ts", late).selectExpr("workspace", "cast(query_id as long) as query_id", "unix_micros(ts) / 1e6 as t", "cast(vector as array<double>) as vector", "ts")
    return rows.groupBy("workspace").transformWithStateInPandas(RecentState(ttl, threshold, keep_hits), _schema(queries, workspace="workspace", query_id="long", source="long", sim="double"), "Append", "EventTime")
