"""Folds over each key's rows in time order: the rows pass through a task sorted, and only the current key's state is held.

A fold is inherently in order, so a key stays in one task, but never in its memory: rows arrive in Arrow
batches and leave as they are decided. The streaming jobs use the same folds with state kept by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.frames import shuffle_partitions


def folded(rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], object], step: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Each key's rows in order through step(state, rows of one key), state being fresh() at the key's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_pylist() for k in keys]
            names = list(zip(*columns, strict=True))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if names[s] != now:
                    now, state = names[s], fresh()
                yield step(state, b.slice(s, e - s))

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


class Bucket:
    """Tokens of one peer: they refill at `rate` up to `burst`, a request takes one; after `idle` seconds it is full again.

    A request that is older than the last one counts at the last one's time.
    """

    def __init__(self, rate: float, burst: float, idle: float, tokens: float | None = None, last: float | None = None):
        self.rate, self.burst, self.idle = rate, burst, idle
        self.tokens, self.last = float(burst) if tokens is None else tokens, last

    def take(self, times: list[float]) -> list[bool]:
        out = []
        for t in times:
            gap = None if self.last is None else max(0.0, t - self.last)
            have = float(self.burst) if gap is None or gap > self.idle else min(float(self.burst), self.tokens + gap * self.rate)
            out.append(have >= 1)
            self.tokens, self.last = have - (1.0 if have >= 1 else 0.0), t if self.last is None else max(t, self.last)
        return out


class Recent:
    """Entries of one workspace that may still answer: the most similar one within `ttl` seconds, ties to the smaller id.

    keep_hits: also a query that was answered becomes an entry (else only missed ones do, as in a live cache).
    """

    def __init__(self, ttl: float, threshold: float, keep_hits: bool = True, entries: list[tuple[float, int, list[float]]] = ()):
        self.ttl, self.threshold, self.keep_hits = ttl, threshold, keep_hits
        self.times, self.ids, self.vectors = [e[0] for e in entries], [e[1] for e in entries], [np.asarray(e[2], float) for e in entries]

    def forget(self, now: float) -> None:
        live = [i for i, t in enumerate(self.times) if now - t <= self.ttl]
        if len(live) < len(self.times):
            self.times, self.ids, self.vectors = ([x[i] for i in live] for x in (self.times, self.ids, self.vectors))

    def ask(self, t: float, ident: int, vector: list[float] | None) -> tuple[int | None, float | None]:
        """The entry that answers and its cosine; vectors are of unit length, those of another length or null match nothing."""
        self.forget(t)
        hit: tuple[int | None, float | None] = None, None
        if vector is None:
            return hit
        v = np.asarray(vector, float)
        able = [i for i, w in enumerate(self.vectors) if len(w) == len(v) and self.times[i] < t]
        if able:
            sims = np.round(np.stack([self.vectors[i] for i in able]) @ v, 6)
            best = min(range(len(able)), key=lambda k: (-sims[k], self.ids[able[k]]))
            if sims[best] >= self.threshold:
                hit = self.ids[able[best]], float(sims[best])
        if hit[0] is None or self.keep_hits:
            self.times.append(t), self.ids.append(ident), self.vectors.append(v)
        return hit


def token_bucket(requests: DataFrame, rate: float, burst: float, idle: float = 300.0) -> DataFrame:
    """requests(peer, t seconds, id) -> peer, id, allowed: tokens refill at rate up to burst, a request takes one; an idle peer starts full."""
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def step(state: Bucket, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(state.take(b.column(1).to_pylist()))], ["peer", "id", "allowed"])

    rows = requests.selectExpr("peer", "cast(t as double) as t", "id")
    return folded(rows, ["peer"], ["t", "id"], lambda: Bucket(rate, burst, idle), step, f"peer {kinds['peer']}, id {kinds['id']}, allowed boolean")


def ttl_hits(requests: DataFrame, ttl: float) -> DataFrame:
    """requests(key, t seconds) -> key, t, hit: a cache whose entries live ttl seconds from their miss."""

    def step(state: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        hits = []
        for t in b.column(1).to_pylist():
            hits.append("since" in state and t - state["since"] <= ttl)
            if not hits[-1]:
                state["since"] = t
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits)], ["key", "t", "hit"])

    rows = requests.selectExpr("key", "cast(t as double) as t")
    return folded(rows, ["key"], ["t"], dict, step, f"key {requests.schema['key'].dataType.simpleString()}, t double, hit boolean")


def reuse_replay(queries: DataFrame, ttl: float, threshold: float, keep_hits: bool = False) -> DataFrame:
    """queries(workspace, query_id, t, vector) -> workspace, query_id, source, sim: a live cache of each workspace, query after query.

    As in the cache, only queries that found no answer become entries; with keep_hits all do.
    """

    def step(state: Recent, b: pa.RecordBatch) -> pa.RecordBatch:
        ids, times, vectors = (b.column(c).to_pylist() for c in ("query_id", "t", "vector"))
        hits = [state.ask(t, i, v) for t, i, v in zip(times, ids, vectors, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.float64())], ["workspace", "query_id", "source", "sim"])

    rows = queries.selectExpr("workspace", "cast(query_id as long) as query_id", "cast(t as double) as t", "cast(vector as array<double>) as vector")
    return folded(rows, ["workspace"], ["t", "query_id"], lambda: Recent(ttl, threshold, keep_hits), step, f"workspace {queries.schema['workspace'].dataType.simpleString()}, query_id long, source long, sim double")
