"""Exact top-k search by inner product (operator 12): norm-bucketed retrieval.

Components become integers, so scores are exact and ties are real. Equal vectors are one node that carries
its k + 1 smallest ids (no answer needs more of them), so copies neither repeat work nor fill a task. Nodes
are ranked by length, longest first, and every BUCKET neighbours form a bucket. Queries are cut into blocks;
a block meets the buckets slice by slice, a slice holding every S-th bucket in order of falling length.

For each bucket and query the running k-th score over both lengths is the local cosine threshold. Over 1
the bucket cannot hold an answer, and no later one of the slice can. Otherwise one of two prunings is chosen:
by coordinates, where the threshold is high enough that the angle it allows leaves few of the bucket's
vectors in range at one of the query's FOCUS largest coordinates; else by length, the bucket's prefix of vectors
that are long enough. What is left is verified by the products themselves. Thresholds begin at the k-th
score over a sample of about SEEDS nodes (a bounded table that tasks receive); this and all constants here change the
work, never the result.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows
without vec_id; components are clamped at 2^27 after scaling (so that products of vectors of up to 511
components fit a long); vectors of different length are not compared, and those of no components score 0 with each
other; rows with equal ids are rows of their own, and a query leaves out one row of its id and vector; an empty table gives an
empty one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, shuffle_partitions, stored
from graphloom.llm.ranks import ranked
from graphloom.llm.runs import blocks

BUCKET, SEEDS, FOCUS = 1024, 8192, 3
#: Components of a block of queries (16,384 queries of 64); cosine from which coordinates are tried; how many products
#: of a matrix product cost as much as one of a gathered vector.
BLOCK, TRY_FROM, GATHERED = 1 << 20, 0.7, 16
CLAMP, SLACK = float(1 << 27), 1e-9


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component x, or null where the vector takes no part."""
    x = vector.cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(good, F.transform(x, lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c, F.lit(CLAMP)), F.lit(-CLAMP))).cast("int")))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of one length -> integer rows."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), dim)


class Best:
    """The k best (score, then smaller id) so far of each of n queries, and the score that a new one must reach."""

    def __init__(self, k: int, reach: np.ndarray):
        self.k, self.reach = k, reach.copy()
        self.query, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(query):
            return
        # only the queries that got something new are sorted again
        new = np.zeros(len(self.reach), bool)
        new[query] = True
        old = new[self.query]
        q, s, i = (np.concatenate((x[old], y)) for x, y in ((self.query, query), (self.score, score), (self.ident, ident)))
        o = np.lexsort((i, -s, q))
        q, s, i = q[o], s[o], i[o]
        first = np.append(True, q[1:] != q[:-1])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        last = rank == self.k - 1
        self.reach[q[last]] = np.maximum(self.reach[q[last]], s[last])
        top = rank < self.k
        self.query, self.score, self.ident = (np.concatenate((x[~old], y[top])) for x, y in ((self.query, q), (self.score, s), (self.ident, i)))


class Block:
    """A block of query vectors of one length, met by buckets in order of falling length."""

    def __init__(self, nodes: list[str], vectors: np.ndarray, norm2: np.ndarray, reach: np.ndarray, k: int):
        self.nodes, self.vectors, self.length = nodes, vectors, np.sqrt(norm2)
        self.best, self.k = Best(k, reach), k
        self.kinds: dict[type, np.ndarray] = {}
        self.used = {"skipped": 0, "coordinate": 0, "length": 0}

    def _as(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = self.vectors.astype(kind)
        return self.kinds[kind]

    def meet(self, vectors: np.ndarray, norm2: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """A bucket by falling length; the ids of row r are ids[starts[r] : starts[r + 1]]."""
        length, reach = np.sqrt(norm2), self.best.reach
        top = self.length * length[0]
        live = np.flatnonzero(top * (1 + SLACK) >= reach)
        self.used["skipped"] += len(reach) - len(live)
        if not len(live):
            return
        # no sum of products is larger than the product of both lengths, so these kinds of numbers hold it exactly
        most = self.length[live].max() * length[0]
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64
        q, v = self._as(kind), vectors.astype(kind)
        with np.errstate(divide="ignore", invalid="ignore"):
            # how many of the bucket are long enough, and the local cosine threshold
            need = np.where(reach[live] > 0, reach[live] / self.length[live], 0) * (1 - SLACK)
            cosine = np.where(reach[live] > 0, np.minimum(1, reach[live] / top[live]), -1)
        long = np.searchsorted(-length, -need, "right")
        by_range = np.zeros(len(live), bool)
        tried = np.flatnonzero(cosine >= TRY_FROM)
        if len(tried):
            rows, lo, hi, orders = self._ranges(live[tried], cosine[tried], vectors, length)
            few = (hi - lo) * GATHERED < long[tried]
            by_range[tried[few]] = True
            self._gathered(live[tried[few]], rows[few], lo[few], hi[few], orders, q, v, ids, starts)
        self.used["coordinate"] += int(by_range.sum())
        rest = live[~by_range]
        self.used["length"] += len(rest)
        if len(rest):
            self._products(rest, q, v[: long[~by_range].max()], ids, starts)

    def _ranges(self, asked: np.ndarray, cosine: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> tuple:
        """For each query its best coordinate and the range of rows there, in the order of that coordinate.

        A unit vector within the angle of the threshold has an angle to an axis that differs from the query's by at most that.
        """
        unit = vectors / np.maximum(length, 1e-300)[:, None]
        mine = self.vectors[asked] / self.length[asked][:, None]
        near = np.argsort(-np.abs(mine), 1)[:, :FOCUS]
        allowed = np.arccos(np.clip(cosine - SLACK, -1, 1))[:, None]
        angle = np.arccos(np.clip(np.take_along_axis(mine, near, 1), -1, 1))
        least = np.cos(np.minimum(np.pi, angle + allowed)) - SLACK
        most = np.cos(np.maximum(0, angle - allowed)) + SLACK
        lo, hi, orders = np.zeros(near.shape, np.int64), np.zeros(near.shape, np.int64), {}
        for f in np.unique(near):
            orders[int(f)] = order = np.argsort(unit[:, f], kind="stable")
            at = near == f
            line = unit[order, f]
            lo[at], hi[at] = np.searchsorted(line, least[at], "left"), np.searchsorted(line, most[at], "right")
        best = np.argmin(hi - lo, 1)[:, None]
        pick_ = lambda x: np.take_along_axis(x, best, 1)[:, 0]
        return pick_(near), pick_(lo), pick_(hi), orders

    def _gathered(self, asked: np.ndarray, axis: np.ndarray, lo: np.ndarray, hi: np.ndarray, orders: dict, q: np.ndarray, v: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        for f in np.unique(axis):
            mine = np.flatnonzero(axis == f)
            for at in range(0, len(mine), 1024):
                some = mine[at : at + 1024]
                size = hi[some] - lo[some]
                who = np.repeat(asked[some], size)
                place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[some], size)
                row = orders[int(f)][place]
                score = np.einsum("ij,ij->i", q[who], v[row]).astype(np.int64)
                ok = score >= self.best.reach[who]
                self._keep(who[ok], row[ok], score[ok], ids, starts)

    def _products(self, asked: np.ndarray, q: np.ndarray, v: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        for at in range(0, len(asked), 2048):
            some = asked[at : at + 2048]
            score = q[some] @ v.T
            limit = self.best.reach[some].astype(np.float64)
            if score.shape[1] > self.k and np.count_nonzero(score >= limit[:, None]) > 8 * self.k * len(some):
                limit = np.maximum(limit, np.partition(score, -self.k, 1)[:, -self.k])
            who, row = np.nonzero(score >= limit[:, None])
            self._keep(some[who], row, score[who, row].astype(np.int64), ids, starts)

    def _keep(self, who: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        size = starts[row + 1] - starts[row]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[row], size)
        self.best.add(np.repeat(who, size), np.repeat(score, size), ids[place])

    def rows(self) -> pa.RecordBatch:
        b = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.nodes, pa.string()).take(pa.array(b.query)), pa.array(b.score), pa.array(b.ident)], ["node", "score", "vec_id"])


def _seeded(asked: DataFrame, nodes: DataFrame, count: int, k: int) -> DataFrame:
    """asked(node, v, norm2, dim) and `reach`: the k-th score over about SEEDS nodes, lower than any score where those are too few."""
    share = min(1.0, SEEDS / max(1, count))
    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "v").toArrow()  # about SEEDS rows
    dims = some["dim"].to_numpy()
    tables = {int(d): matrix(some["v"].filter(pa.array(dims == d)), int(d)).astype(np.float64) for d in np.unique(dims)}
    shared = asked.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(3).to_numpy()
            reach = np.full(b.num_rows, np.iinfo(np.int64).min)
            for d in np.unique(dim):
                v = shared.value.get(int(d))
                if v is None or len(v) < k:
                    continue
                rows = np.flatnonzero(dim == d)
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    q = matrix(b.column(1).take(pa.array(part)), int(d)).astype(np.float64)
                    score = np.partition(q @ v.T, -k, 1)[:, -k]
                    # rounding of large sums must not lift the bound
                    reach[part] = np.floor(score - np.abs(score) * 1e-12)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reach)], [*b.schema.names, "reach"])

    return asked.select("node", "v", "norm2", "dim").mapInArrow(run, "node string, v array<int>, norm2 long, dim int, reach long")


def top_products(vectors: DataFrame, asked: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: of each row that `asked` (a condition on vec_id) holds for,
    the k other rows of the highest inner product of components floor(scale * x), ties to the smaller vec_id."""
    with Scratch(vectors.sparkSession) as keep:
        return stored(_top_products(vectors, asked, k, scale, keep))


def _top_products(vectors: DataFrame, asked: Column, k: int, scale: float, keep: Scratch) -> DataFrame:
    spark = vectors.sparkSession
    v = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")).filter("vec_id is not null and v is not null")
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    rows = keep(v.select("vec_id", "v", norm2.alias("norm2"), F.size("v").alias("dim"), F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary")).alias("node")))
    few = F.row_number().over(Window.partitionBy("node").orderBy("vec_id")) <= k + 1
    nodes = rows.withColumn("few", few).filter("few").groupBy("node").agg(F.first("v").alias("v"), F.first("norm2").alias("norm2"), F.first("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = keep(nodes)
    asking = rows.filter(asked)
    queries = keep(asking.groupBy("node").agg(F.first("v").alias("v"), F.first("norm2").alias("norm2"), F.first("dim").alias("dim")))
    size = nodes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n_blocks = max(1, -(-queries.count() // max(256, BLOCK // max(1, size["dim"] or 0))))
    parts = shuffle_partitions(spark)
    slices = max(1, min(-(-size["n"] // BUCKET), -(-2 * parts // n_blocks)))

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = F.lit(None)
    q = _seeded(queries, nodes, size["n"], k + 1)
    q = q.select(F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int").alias("block"), every(slices).alias("slice"), "dim", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("index"), "node", "v", "norm2", "reach", none.cast("array<long>").alias("ids"))
    c = ranked(nodes, "dim", [F.col("norm2").desc(), "node"], keep).withColumn("bucket", F.floor(F.col("index") / BUCKET))
    c = c.select(every(n_blocks).alias("block"), F.pmod("bucket", F.lit(slices)).cast("int").alias("slice"), "dim", F.lit(1).alias("kind"), "bucket", "index", none.cast("string").alias("node"), "v", "norm2", none.cast("long").alias("reach"), "ids")
    units = q.unionByName(c).repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", "dim", "kind", "bucket", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, block = None, None
        for t, starts in blocks(batches, ["block", "slice", "dim", "kind", "bucket"], BUCKET):
            key = [t.column(c).to_numpy() for c in ("block", "slice", "dim")]
            kind = t.column("kind").to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here, part = tuple(int(x[s]) for x in key), t.slice(s, e - s)
                if here != unit:
                    if block is not None:
                        yield block.rows()
                    unit, block = here, None
                vec, squares = matrix(part.column("v"), here[2]), part.column("norm2").to_numpy()
                if kind[s] == 0:
                    block = Block(part.column("node").to_pylist(), vec, squares, part.column("reach").to_numpy(), k + 1)
                elif block is not None:
                    ids = part.column("ids").combine_chunks()
                    block.meet(vec, squares, ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy())))
        if block is not None:
            yield block.rows()

    found = units.mapInArrow(run, "node string, score long, vec_id long")
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = found.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id"))), lambda x: F.struct(x["score"], x["vec_id"])).alias("best"))
    own = F.array_position("best", F.struct(F.col("norm2").alias("score"), F.col("vec_id").alias("vec_id")))
    out = asking.select("vec_id", "norm2", "node").join(keep(lists), "node").withColumn("own", own)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op12_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best for each vec_id divisible by 20, against all rows."""
    return top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
