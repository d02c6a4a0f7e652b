"""Embedding near-duplicates (operator 3): cross-polytope hashing with multiprobe.

Equal vectors are merged first, so copies never meet each other. Each distinct vector is rotated
by three rounds of random signs and a fast Hadamard transform; the hash of a rotation is its
largest coordinate with its sign; vectors of fewer than LEAST dimensions are padded with zeros first, so
that there are enough different rotations and the collision rates below hold for them too. A table's bucket joins `width` such hashes, with `probes` buckets
taken in order of how far their coordinates fall short of the largest. The width follows the
number of distinct vectors so that unlike vectors seldom share a bucket. Buckets are counted by
key alone; only vectors in buckets of two or more are sent on. A large bucket is cut into blocks
of at most BLOCK vectors, and pairs of blocks are separate units of work, so no bucket is one task.
Every candidate pair is verified by its cosine in double precision. A pair that shares several
buckets counts in the first one only. Links are counted, never listed: a unit of work gives each
vector its number of links and one edge to its local component.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing (0 links, component is the own id); vectors of different length never link; equal rows
are rows of their own; a null vec_id takes part, and a component whose ids are all null has a null
id; an empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.components import components
from graphloom.frames import Scratch, pick, read, shuffle_partitions, stored
from graphloom.llm.runs import blocks

BLOCK, LEAST = 512, 64
#: Tables by width. One table of 4 probes catches a pair at cosine 0.95 in 64 dimensions with probability
#: .988, .908, .734, .544 at widths 1 to 4 (measured); so many tables miss fewer than one in 10 million.
TABLES = (5, 8, 14, 24, 40, 64)


class CrossPolytope:
    """Buckets of unit vectors of one length."""

    def __init__(self, dim: int, width: int, tables: int, probes: int, seed: int = 7):
        self.size = max(LEAST, 1 << (dim - 1).bit_length())
        self.width, self.tables = width, tables
        rng = np.random.default_rng([seed, dim, width, tables])
        self.signs = rng.integers(0, 2, (tables * width, 3, self.size)) * 2.0 - 1
        # probe choices: for each hash the rank of the coordinate taken, fewest steps first
        ranks = np.stack(np.meshgrid(*[np.arange(3)] * width, indexing="ij"), -1).reshape(-1, width)
        self.choices = ranks[np.argsort(ranks.sum(1), kind="stable")][:100]
        self.probes = min(probes, len(self.choices))

    def _rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), 2).reshape(len(x), -1)
                h *= 2
            x = x / math.sqrt(self.size)
        return x

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """n unit vectors -> n x (tables * probes) bucket keys, home bucket first in each table."""
        n, dim = unit.shape
        x = np.zeros((n, self.size))
        x[:, :dim] = unit
        out = np.empty((n, self.tables, self.probes), np.int64)
        for t in range(self.tables):
            codes, short = [], []
            for w in range(self.width):
                y = self._rotate(x, self.signs[t * self.width + w])
                a = np.abs(y)
                top = np.argpartition(-a, 3, axis=1)[:, :3]
                v = np.take_along_axis(a, top, 1)
                o = np.argsort(-v, axis=1)
                top, v = np.take_along_axis(top, o, 1), np.take_along_axis(v, o, 1)
                codes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
                short.append((v[:, :1] - v) ** 2)
            cost = sum(short[w][:, self.choices[:, w]] for w in range(self.width))
            best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            key = np.zeros((n, len(self.choices)), np.uint64)
            for w in range(self.width):
                key = key * np.uint64(2 * self.size) + codes[w][:, self.choices[:, w]].astype(np.uint64)
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((t + 1) * 0xC2B2AE3D27D4EB4F % 2**64) ^ np.uint64(dim)
            out[:, t] = np.take_along_axis(key, best, 1).view(np.int64)
        return out.reshape(n, -1)


def unit_rows(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """List column -> by length: row numbers and unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
    out = {}
    for dim in np.unique(lengths):
        if dim:
            rows = np.flatnonzero(lengths == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)]
            scale = np.abs(x).max(1, keepdims=True)
            x = x / scale
            out[int(dim)] = rows, x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def plan_width(n: int, dim: int, probes: int) -> int:
    """Hashes per table so that a bucket holds about one unlike vector at most."""
    return max(1, math.ceil(math.log(max(2, n * probes)) / math.log(2 * max(LEAST, 1 << (dim - 1).bit_length()))))


def first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pair's own bucket: of the first table in which rows a and b share one, the smallest shared key."""
    none = np.iinfo(np.int64).max
    out, todo = np.full(len(a), none), np.arange(len(a))
    for t in range(keys.shape[1]):
        x, y = keys[a[todo], t], keys[b[todo], t]
        low = np.where((x[:, :, None] == y[:, None, :]).any(2), x, none).min(1)
        out[todo] = low
        todo = todo[low == none]
        if not len(todo):
            break
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, probes: int = 4) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept.

    tables: how many hash tables; by default TABLES for the width that the number of vectors asks for.
    """
    with Scratch(vectors.sparkSession) as keep:
        return stored(_near_duplicates(vectors, threshold, tables, probes, keep))


def _near_duplicates(vectors: DataFrame, threshold: float, tables: int | None, probes: int, keep: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    v = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = keep(v.select("vec_id", F.when(good, F.col("embedding")).alias("embedding"), F.when(good, F.xxhash64("embedding")).alias("node")))
    distinct = keep(v.filter("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies")))
    seen = distinct.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not seen["n"]:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width = plan_width(seen["n"], seen["dim"], probes)
    count = tables or TABLES[min(width, len(TABLES)) - 1]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CrossPolytope] = {}
        for b in batches:
            nodes = b.column(0).to_numpy()
            for at in range(0, b.num_rows, 1024):
                for dim, (rows, unit) in unit_rows(b.column(1).slice(at, 1024)).items():
                    lsh = made.setdefault(dim, CrossPolytope(dim, width, count, probes))
                    keys = lsh.buckets(unit)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[at + rows], keys.shape[1])), pa.array(keys.ravel())], ["node", "bucket"])

    n = shuffle_partitions(spark)
    keys = distinct.select("node", "embedding").mapInArrow(keyed, "node long, bucket long").distinct()
    members = keep(keys)
    busy = members.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a block meets itself and every other block of its bucket: (low, high) names the unit of work
    units = members.join(busy, "bucket").withColumn("parts", parts).withColumn("own", own)
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("node", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    work = units.join(distinct.withColumnRenamed("embedding", "vector"), "node")
    work = work.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CrossPolytope] = {}
        for t, starts in blocks(batches, ["bucket", "low", "high"]):
            ids, copies, own = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("own").to_numpy()
            bucket, low, high = t.column("bucket").to_numpy(), t.column("low").to_numpy(), t.column("high").to_numpy()
            by_dim = unit_rows(t.column("vector"))
            place = np.empty((t.num_rows, 2), np.int64)
            for dim, (rows, _) in by_dim.items():
                place[rows, 0], place[rows, 1] = dim, np.arange(len(rows))
            a_all, b_all, dims = [], [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                for dim in np.unique(place[s:e, 0]):
                    rows = s + np.flatnonzero(place[s:e, 0] == dim)
                    if len(rows) < 2:
                        continue
                    if low[s] == high[s]:
                        x = by_dim[dim][1][place[rows, 1]]
                        one, two = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
                        one, two = rows[one], rows[two]
                    else:
                        left, right = rows[own[rows] == low[s]], rows[own[rows] == high[s]]
                        one, two = np.nonzero(by_dim[dim][1][place[left, 1]] @ by_dim[dim][1][place[right, 1]].T >= threshold - 1e-9)
                        one, two = left[one], right[two]
                    a_all.append(one), b_all.append(two), dims.append(np.full(len(one), dim))
            if not a_all or not sum(map(len, a_all)):
                continue
            a, b, dims = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(dims)
            keep = np.zeros(len(a), bool)
            for dim in np.unique(dims):
                lsh = made.setdefault(int(dim), CrossPolytope(int(dim), width, count, probes))
                p = np.flatnonzero(dims == dim)
                used, back = np.unique(np.concatenate((a[p], b[p])), return_inverse=True)
                unit = by_dim[dim][1][place[used, 1]]
                k = np.concatenate([lsh.buckets(unit[at : at + 1024]) for at in range(0, len(unit), 1024)]).reshape(len(unit), lsh.tables, -1)
                one, two = back[: len(p)], back[len(p) :]
                for at in range(0, len(p), 65536):
                    q = slice(at, at + 65536)
                    exact = (unit[one[q]] * unit[two[q]]).sum(1) >= threshold
                    keep[p[q]] = exact & (first_shared(k, one[q], two[q]) == bucket[a[p[q]]])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            # local components by repeated minimum over links, then one edge for each member
            top = np.arange(t.num_rows)
            while True:
                m = np.minimum(top[a], top[b])
                nxt = top.copy()
                np.minimum.at(nxt, a, m)
                np.minimum.at(nxt, b, m)
                nxt = nxt[nxt]
                if (nxt == top).all():
                    break
                top = nxt
            links = np.bincount(a, copies[b], t.num_rows) + np.bincount(b, copies[a], t.num_rows)
            rows = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(links[rows].astype(np.int64)), pa.array(ids[top[rows]])], ["node", "links", "near"])

    found = keep(work.select("bucket", "low", "high", "own", "node", "copies", "vector").mapInArrow(verified, "node long, links long, near long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")), keep=keep)
    nodes = v.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).filter("node is not null")
    nodes = nodes.join(links, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = keep(nodes)
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    per = nodes.join(ids, "component").select(F.col("node").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = v.join(per, v["node"] == per["of"], "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings at cosine 0.95: vec_id, n_links, component_id, kept."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT k.vec_id, coalesce(n.n_links, 0) AS n_links, k.component_id, k.vec_id = k.component_id AS kept FROM k LEFT JOIN n ON n.a = k.vec_id
"""
