"""Vector operators: blocked search of a query table against all vectors, quantisation, whitening, a linear bridge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import shuffle_partitions

#: Queries of one block, and vectors of one part, at most and at least; a task holds one block and streams its part.
BLOCK, PART, LEAST_PART = 8192, 1 << 16, 4096
#: Distances that a task works on at once.
PAIRS = 1 << 20


def l2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0))


def negative_dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -(q @ v.T)


def hamming(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bits that differ, of components over 0."""
    a, b = (q > 0).astype(np.float32), (v > 0).astype(np.float32)
    return (a.sum(1)[:, None] + b.sum(1)[None] - 2 * a @ b.T).astype(np.float64)


def _usable(df: DataFrame, ident: str) -> DataFrame:
    vector = F.col("vector")
    if df.schema["vector"].dataType.simpleString() != "array<float>":  # half the bytes; tasks work on doubles all the same
        vector = vector.cast("array<double>")
    return df.select(F.col(ident).cast("long").alias("id"), vector.alias("vector")).filter(F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))


def search(queries: DataFrame, vectors: DataFrame, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int | None = None, within: float | None = None, earlier: bool = False) -> DataFrame:
    """queries(query_id, vector), vectors(vec_id, vector) -> query_id, vec_id, distance: the k least, or all within a distance.

    earlier: only vectors whose id is smaller than the query's count, as in a stream of queries that see what came before.

    Queries are cut into blocks, vectors into parts by hash; each block meets each part in one task, which
    holds the block alone and keeps a running best k by (distance rounded to 6 places, vec_id), so ties do
    not depend on the order of rows. What it works on at once is bounded by PAIRS, whatever the tables' size. Only what is kept is shuffled again. Null vectors, vectors with a null
    or non-finite component and pairs of different length are left out; nothing passes the driver but two counts.
    """
    q, v = _usable(queries, "query_id"), _usable(vectors, "vec_id")
    if q.schema["vector"].dataType.simpleString() != v.schema["vector"].dataType.simpleString():
        q, v = (x.withColumn("vector", F.col("vector").cast("array<double>")) for x in (q, v))
    n, size_q, size_v = shuffle_partitions(vectors.sparkSession), q.count(), v.count()
    blocks = max(1, -(-size_q // BLOCK))
    parts = max(1, -(-size_v // PART), min(-(-n // blocks), -(-size_v // LEAST_PART)))  # few blocks: enough parts for all tasks
    spot = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = q.select(spot(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "vector")
    rows = asked.unionByName(v.select(every(blocks).alias("block"), spot(parts).alias("part"), F.lit(1).alias("kind"), "id", "vector"))
    rows = rows.repartition(n, "block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, best = None, [], {}

        def out() -> Iterator[pa.RecordBatch]:
            for dim, (ids, *_) in best.items():
                row, d, found = settle(dim)
                for at in range(0, len(row), 1 << 18):
                    r = row[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found[at : at + len(r)]), pa.array(d[at : at + len(r)])], ["query_id", "vec_id", "distance"])

        def settle(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What was found is cut to the best k; from then on only what is no farther than a query's last one counts."""
            names, matrix, bound, found = best[dim]
            new = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
            if k is not None and len(new[0]):
                o = np.lexsort((new[2], new[1], new[0]))
                row = new[0][o]
                first = np.r_[True, row[1:] != row[:-1]]
                place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                bound[row[place == k - 1]] = new[1][o[place == k - 1]]
                new = tuple(x[o[place < k]] for x in new)
            best[dim] = names, matrix, bound, [new]
            return new

        def meet(ids: np.ndarray, size: np.ndarray, flat: list[np.ndarray]) -> None:
            for dim in np.unique(size):
                if dim not in best:
                    continue
                every = np.flatnonzero(size == dim)
                names, matrix, bound, found = best[dim]
                wide = max(1, PAIRS // len(names))
                for s in range(0, len(every), wide):
                    at = every[s : s + wide]
                    d = np.round(measure(matrix, np.stack([flat[i] for i in at]).astype(np.float64, copy=False)), 6) + 0.0
                    if earlier:
                        d = np.where(ids[at][None] < names[:, None], d, np.inf)
                    if k is None:
                        near = d <= within
                    else:
                        near = np.isfinite(d) & (d <= bound[:, None])
                        if d.shape[1] > k and np.isinf(bound).any():
                            near &= d <= np.partition(d, k - 1, 1)[:, k - 1 : k]
                    row, col = np.nonzero(near)
                    found.append((row, d[row, col], ids[at[col]]))
                    if k is not None and (np.isinf(bound).all() or sum(len(x[0]) for x in found) > 4 * k * len(names)):
                        settle(dim)
                        found = best[dim][3]

        for b in batches:
            if not b.num_rows:
                continue
            block, part, kind, ids = (b.column(i).to_numpy() for i in range(4))
            vec = b.column(4)
            size = np.diff(vec.offsets.to_numpy())
            flat = np.split(vec.values.to_numpy(zero_copy_only=False)[vec.offsets[0].as_py() : vec.offsets[-1].as_py()], np.cumsum(size)[:-1])
            edges = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip(np.r_[0, edges], np.r_[edges, b.num_rows], strict=True):
                if (block[s], part[s]) != place:
                    yield from out()
                    place, held, best = (block[s], part[s]), [], {}
                if kind[s] == 0:
                    held += [(ids[i], flat[i]) for i in range(s, e)]
                    continue
                if held:
                    for dim in {len(x) for _, x in held}:
                        some = [(i, x) for i, x in held if len(x) == dim]
                        best[dim] = np.array([i for i, _ in some]), np.stack([x for _, x in some]).astype(np.float64, copy=False), np.full(len(some), np.inf), []
                    held = []
                for at in range(s, e, 1024):
                    to = min(e, at + 1024)
                    meet(ids[at:to], size[at:to], flat[at:to])
                if k is None:
                    yield from out()
                    best = {d: (x, y, z, []) for d, (x, y, z, _) in best.items()}
        yield from out()

    return rows.mapInArrow(run, "query_id long, vec_id long, distance double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k least of each query, rank from 1, ties by vec_id."""
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once for a row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return _let(v, lambda u: _let(F.sqrt(dot(u, u)), lambda n: F.transform(u, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def truncated(v: Column, dim: int) -> Column:
    """Layer-normed over all components, cut to dim, unit length."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    var = lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)
    return normalised(_let(mean, lambda m: _let(F.sqrt(var(m) + 1e-5), lambda w: F.slice(F.transform(v, lambda x: (x - m) / w), 1, dim))))


def packed_bits(v: Column, dim: int) -> Column:
    """Signs as words of 32 bits, the first component in the lowest bit; words are BIGINT so that bit_count works."""
    word = lambda w: F.aggregate(F.slice(v, 32 * w + 1, 32), F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("next")), lambda s, x: F.struct((s["bits"] + F.when(x > 0, s["next"]).otherwise(F.lit(0))).alias("bits"), (s["next"] * 2).alias("next")), lambda s: s["bits"])
    return F.array(*[word(w) for w in range(-(-dim // 32))])


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8(v: Column) -> Column:
    """Components scaled so that the largest becomes 127, rounded."""
    top = F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    return _let(F.when(top == 0, 1.0).otherwise(top), lambda t: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * 127 / t).cast("int")))))


def centroids(vectors: DataFrame) -> DataFrame:
    """vectors(label, vector) -> label, n, centroid: the mean of each label, renormalised. Sums are combined before the shuffle."""
    parts = vectors.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    g = parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return g.select("label", "n", normalised(F.col("mean")).alias("centroid"))


def whitening(vectors: DataFrame, eps: float = 1e-6) -> DataFrame:
    """vectors(vector) -> i, mean, weight: per dimension its mean and 1 / sqrt(variance + eps); one row for each dimension."""
    x = vectors.select(F.posexplode("vector").alias("i", "x"))
    return x.groupBy("i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).select("i", "mean", (1 / F.sqrt(F.col("var") + eps)).alias("weight"))


def bridge(pairs: DataFrame, dim: int, ridge: float = 1.0) -> np.ndarray:
    """pairs(x, y) of vectors -> W with x W near y, by ridge regression; tasks send sums of dim x dim, never rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, dim, dim))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x, y = (np.array(b.column(i).slice(at, 4096).to_pylist(), np.float64).reshape(-1, dim) for i in (0, 1))
                sums += np.stack((x.T @ x, x.T @ y))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * dim * dim)), pa.array(sums.ravel())], ["i", "s"])

    total = pairs.select("x", "y").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toArrow()["s"].to_numpy()
    xx, xy = total.reshape(2, dim, dim)
    return np.linalg.solve(xx + ridge * np.eye(dim), xy)
