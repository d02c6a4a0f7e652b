"""Graph operators over node and edge tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, scratched
from graphloom.functions.text import secret_matches

#: Buckets of PageRank's nodes (fewer for few edges, more for more nodes than these hold) and nodes in each: what a round sends grows
#: with the buckets, the memory of a task with their nodes. Edges of a piece.
BUCKETS, BUCKET, PIECE = 8, 1 << 23, 1 << 20
WHOLE_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").union(edges.select(F.col("target"), F.col("source"))).distinct()


def god_nodes(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Nodes by their number of different neighbours that exist; the first few."""
    both = undirected(edges).filter("source <> target")
    known = both.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    degree = known.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))
    return degree.join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(most)


@scratched
def reach(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, *, keep: Scratch) -> DataFrame:
    """id, hop of all ids reached, ends of edges that are no nodes among them."""
    both = keep(undirected(edges))
    seen = front = keep(starts.select("id").distinct().join(nodes.select("id"), "id", "left_semi").withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        step = front.select(F.col("id").alias("source")).join(both, "source").select(F.col("target").alias("id")).distinct()
        front = keep(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


@scratched
def k_hop(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, *, keep: Scratch) -> DataFrame:
    """id, hop of all nodes reached from the starts in at most depth undirected steps."""
    return reach(starts, nodes, edges, depth, keep=keep).join(nodes.select("id"), "id", "left_semi")


@scratched
def k_hop_edges(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, *, keep: Scratch) -> DataFrame:
    """The edges between ids that k_hop visits, dead ends included, each once."""
    seen = keep(reach(starts, nodes, edges, depth, keep=keep).select("id"))
    e = edges.select("source", "target").distinct().join(seen.withColumnRenamed("id", "source"), "source", "left_semi")
    return e.join(seen.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


@scratched
def shortest_paths(pairs: DataFrame, edges: DataFrame, max_edges: int = 9, *, keep: Scratch) -> DataFrame:
    """pairs(start, goal) -> start, goal, path (empty if none): fewest undirected steps, the smallest path among equals.

    Each round extends the frontier of every start by one edge and keeps one path for each node met.
    """
    both = keep(undirected(edges).filter("source <> target"))
    goals = keep(pairs.select("start", "goal").distinct())
    seen = front = keep(goals.select("start", F.col("start").alias("at"), F.array("start").alias("path")).distinct())
    for _ in range(max_edges):
        step = front.join(both, front["at"] == both["source"]).select("start", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
        front = keep(step.join(seen.select("start", "at"), ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = goals.join(seen.withColumnRenamed("at", "goal"), ["start", "goal"], "left")
    return found.withColumn("path", F.coalesce("path", F.array().cast(found.schema["path"].dataType)))


@scratched
def subgraph_stats(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 48, *, keep: Scratch) -> DataFrame:
    """seeds(id) -> id, n_nodes, n_edges of its one-hop bundle: the seed and its first neighbours that are nodes, edges among them."""
    known = nodes.select("id")
    both = undirected(edges).filter("source <> target").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    own = seeds.select(F.col("id").alias("seed")).distinct().join(known.withColumnRenamed("id", "seed"), "seed", "left_semi")
    near = own.join(both, own["seed"] == both["source"]).select("seed", F.col("target").alias("id"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).filter(F.col("n") < most).drop("n")
    bundle = keep(near.unionByName(own.select("seed", F.col("seed").alias("id"))))
    e = edges.select("source", "target").distinct()
    inside = bundle.select("seed", F.col("id").alias("source")).join(e, "source").join(bundle.select("seed", F.col("id").alias("target")), ["seed", "target"])
    count = bundle.groupBy("seed").agg(F.count("*").alias("n_nodes")).join(inside.groupBy("seed").agg(F.count("*").alias("n_edges")), "seed", "left")
    return count.select(F.col("seed").alias("id"), "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def latest(rows: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last in the order, or where there is none (or a tie) the greatest by its fields as text."""
    if order is None:
        by = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]))
    else:
        by = F.struct(order, F.to_json(F.struct(*[c for c in rows.columns if c not in [*keys, order]])))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("row_")).select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest])


def replace_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """By id: a new row wins whole; of new rows with one id the last in `order` (a column of the new side alone)."""
    n = latest(new, ["id"], order)
    return old.join(n.select("id"), "id", "left_anti").unionByName(n.select(*old.columns))


def _folded(new: DataFrame, keys: list[str], order: str | None, columns: list[str], maps: set[str]) -> DataFrame:
    """Rows of one key merged one over the other in order: each field's last value that is not null, each map's last entries."""
    at = F.struct(order) if order else F.to_json(F.struct(*[c for c in columns if c not in keys]))
    rest = [c for c in columns if c not in keys]
    plain = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest if c not in maps]
    # entries one after the other: the last one of a name stays
    entry = lambda c: F.aggregate(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.map_entries(c).alias("e"))))), lambda x: x["e"]), F.create_map().cast(new.schema[c].dataType), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.transform(e, lambda y: y["key"]), k)), F.map_from_entries(e)))
    nested = [F.when(F.max(F.col(c).isNotNull()), entry(c)).alias(c) for c in rest if c in maps]
    return new.groupBy(*keys).agg(*plain, *nested).select(*columns)


def _merged(old: DataFrame, new: DataFrame, on: F.Column, columns: list[str], maps: set[str]) -> DataFrame:
    """old and new (aliases o and n) joined: a new field wins where it is not null, a map is merged entry by entry."""

    def field(c: str) -> F.Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c not in maps:
            return F.coalesce(n, o).alias(c)
        kept = F.map_filter(o, lambda k, _: ~F.coalesce(F.map_contains_key(n, k), F.lit(False)))
        return F.when(n.isNotNull() & o.isNotNull(), F.map_concat(kept, n)).otherwise(F.coalesce(n, o)).alias(c)

    return old.alias("o").join(new.alias("n"), on, "full").select(*[field(c) for c in columns])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """By unordered pair of ends, whatever the relation: a new edge's fields that are not null win, the others stay.

    New edges without both ends among the nodes are left out; several of one pair are merged in `order`, a column of the new side alone.
    """
    ids = nodes.select("id").distinct()
    good = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    pair = lambda e: e.withColumn("low_", F.least("source", "target")).withColumn("high_", F.greatest("source", "target"))
    columns, maps = ["low_", "high_", *old.columns], {f.name for f in old.schema.fields if f.dataType.typeName() == "map"}
    n = _folded(pair(good), ["low_", "high_"], order, columns, maps)
    on = (F.col("o.low_") == F.col("n.low_")) & (F.col("o.high_") == F.col("n.high_"))
    return _merged(pair(old), n, on, columns, maps).drop("low_", "high_")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those ids and what hangs on them."""
    g = gone.select("id").distinct()
    rest = edges.join(g.withColumnRenamed("id", "source"), "source", "left_anti").join(g.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(g, "id", "left_anti"), rest


@scratched
def deep_search(seeds: DataFrame, edges: DataFrame, k: int = 10, wide: int = 10, step: float = 0.1, *, keep: Scratch) -> DataFrame:
    """seeds(query_id, id, rank, distance) -> hop 0 seeds, hop 1 and 2 neighbours a step further each; first reach wins, the k nearest."""
    both = keep(undirected(edges).filter("source <> target").select(F.col("source").alias("id"), "target"))

    def onward(rows: DataFrame, hop: int) -> DataFrame:
        return rows.join(both, "id").groupBy("query_id", F.col("target").alias("id")).agg(F.min("distance").alias("distance")).withColumn("distance", F.round(F.col("distance") + step, 9)).withColumn("hop", F.lit(hop))

    zero = keep(seeds.select("query_id", "id", "distance").withColumn("hop", F.lit(0)))
    one = keep(onward(zero, 1).join(zero.select("query_id", "id"), ["query_id", "id"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    first = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= wide).drop("n")
    seen = zero.unionByName(one)
    two = onward(first, 2).join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
    every = seen.unionByName(two).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hop", "id")))
    return every.filter(F.col("position") <= k)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, code, p, out, onward in the order of bucket and code -> one row a bucket: its codes, p, 1 / out (0 where the walk ends), ranks to send, p that ends."""

    def row(bucket: int, parts: list) -> pa.RecordBatch:
        code, p, out, onward = (np.concatenate(x) for x in zip(*parts, strict=True))
        inverse = np.divide(1.0, out, out=np.zeros(len(out)), where=onward)
        return _blobs({"bucket": bucket, "codes": code, "rank": p, "inverse": inverse, "sent": p * inverse, "lost": float(p[~onward].sum())})

    at, parts = None, []
    for b in batches:
        bucket = b.column(0).to_numpy()
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
        edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if hi > lo:
                if parts and bucket[lo] != at:
                    yield row(at, parts)
                    parts = []
                at = int(bucket[lo])
                parts.append([c[lo:hi] for c in columns])
    if parts:
        yield row(at, parts)


def _blobs(row: dict) -> pa.RecordBatch:
    """One row; arrays become binary."""
    kinds = {int: pa.int32(), float: pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], kinds[type(v)]) for v in row.values()], list(row))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, source, target, weight -> cell, source, target, weight as binary: the edges of a cell among each two million."""

    def rows(parts: list) -> Iterator[pa.RecordBatch]:
        cell, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cell, kind="stable")
        cell, columns = cell[order], [c[order] for c in columns]
        edge = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            yield _blobs({"cell": int(cell[lo]), "source": columns[0][lo:hi], "target": columns[1][lo:hi], "weight": columns[2][lo:hi]})

    parts, n = [], 0
    for b in batches:
        if b.num_rows:
            parts.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
        if n >= 2 * PIECE:
            yield from rows(parts)
            parts, n = [], 0
    if parts:
        yield from rows(parts)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, first, source, target, weight by cell, the codes of its two buckets first -> cell, piece, size, source, target, weight: ends are places among the codes."""

    def row(cell: int, piece: int, parts: list, size: int) -> pa.RecordBatch:
        source, target, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, short = np.argsort(source, kind="stable"), weight.astype(np.float32)
        return _blobs({"cell": cell, "piece": piece, "size": size, "source": source[order], "target": target[order], "weight": (short if (short == weight).all() else weight)[order]})

    cell, piece, parts, n, codes = None, 0, [], 0, ()
    for b in batches:
        for i in range(b.num_rows):
            at, first = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            ends = [np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (2, 3)]
            if parts and (n >= PIECE or first == 0):
                yield row(cell, piece, parts, len(codes[1]))
                piece, parts, n = piece + 1, [], 0
            if first == 0:
                cell, piece, codes = at, 0, [e.copy() for e in ends]
            else:
                source, target = (np.searchsorted(c, e).astype(np.int32) for c, e in zip(codes, ends, strict=True))
                parts.append((source, target, np.frombuffer(b.column(4)[i].as_buffer(), np.float64).copy()))
                n += len(source)
    if parts:
        yield row(cell, piece, parts, len(codes[1]))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, size, source, target, weight, sent by cell, the ranks sent in its first row -> cell, got: one sum for each node of the cell's second bucket."""
    cell = x = y = None
    for b in batches:
        for i in range(b.num_rows):
            size, source, target, weight, sent = (b.column(c)[i] for c in range(1, 6))
            if sent.is_valid:
                if y is not None:
                    yield _blobs({"cell": cell, "got": y})
                cell, x, y = b.column(0)[i].as_py(), np.frombuffer(sent.as_buffer(), np.float64).copy(), np.zeros(size.as_py())
            s, t = (np.frombuffer(c.as_buffer(), np.int32) for c in (source, target))
            w = np.frombuffer(weight.as_buffer(), np.float32 if len(weight.as_buffer()) == 4 * len(s) else np.float64)
            y += np.bincount(t, w * x[s], len(y))
    if y is not None:
        yield _blobs({"cell": cell, "got": y})


def _moved(alpha: float, lost: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """bucket, kind, one, two by bucket and kind (p and 1 / out, ranks, sums of the cells) -> bucket, rank, sent, change, lost after a round."""

    def row(bucket: int, p: np.ndarray, inverse: np.ndarray, rank: np.ndarray, got: np.ndarray) -> pa.RecordBatch:
        new = alpha * (got + lost * p) + (1 - alpha) * p
        return _blobs({"bucket": bucket, "rank": new, "sent": new * inverse, "change": float(np.abs(new - rank).sum()), "lost": float(new[inverse == 0].sum())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for i in range(b.num_rows):
                kind, one = b.column(1)[i].as_py(), np.frombuffer(b.column(2)[i].as_buffer(), np.float64)
                if kind == 0:
                    if state:
                        yield row(*state)
                    state = [b.column(0)[i].as_py(), one.copy(), np.frombuffer(b.column(3)[i].as_buffer(), np.float64).copy(), None, np.zeros(len(one))]
                elif kind == 1:
                    state[3] = one.copy()
                else:
                    state[4] += one
        if state:
            yield row(*state)

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """codes, rank of whole buckets -> code, rank of each node."""
    for b in batches:
        for i in range(b.num_rows):
            code, rank = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((0, np.int64), (1, np.float64)))
            for at in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + (1 << 16)]), pa.array(rank[at : at + (1 << 16)])], ["code", "rank"])


@scratched
def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 50, *, keep: Scratch) -> DataFrame:
    """edges(source, target, weight), seeds(id, p) -> id, rank. Dangling mass returns to the seeds.

    Nodes lie in buckets and have a place there; an edge lies in the cell of its ends' two buckets as two places and a weight, packed
    with others into pieces that stay. A round sends each bucket's ranks to its row of cells, and a cell's sums to its column's bucket:
    16 bytes a node and row of cells. Tasks hold two such vectors and a piece.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    spark = edges.sparkSession
    if not seeds.filter("p < 0").isEmpty():
        raise ValueError("a seed is negative")
    total = seeds.filter("p > 0").agg(F.sum(F.col("p").cast("double"))).first()[0]
    if not total:
        raise ValueError("the seeds sum to nothing")
    e = keep(edges.filter("weight > 0").select("source", "target", F.col("weight").cast("double").alias("weight")))
    kind, no = e.select("source").union(e.select("target")).union(seeds.select("id")).schema["source"].dataType, F.lit(0.0)
    ends = e.select(F.col("source").alias("id"), no.alias("p"), F.col("weight").alias("out"), F.isnotnull("target").alias("onward")).union(e.select("target", no, no, F.lit(False)))
    ends = ends.union(seeds.select("id", F.coalesce(F.col("p").cast("double"), no), no, F.lit(False))).filter("id is not null")
    nodes = ends.groupBy("id").agg((F.sum("p") / total).alias("p"), F.sum("out").alias("out"), F.max("onward").alias("onward"))
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    nodes = keep(nodes.withColumn("code", F.col("id").cast("long") if whole else F.monotonically_increasing_id()))
    e = e.filter("source is not null and target is not null")
    if not whole:  # ids of other types are numbered
        for end in ("source", "target"):
            e = e.join(nodes.select(F.col("id").alias(end), F.col("code").alias("code_")), end).drop(end).withColumnRenamed("code_", end)
    g = max(2, min(BUCKETS, math.isqrt(e.count() // (PIECE // 4)) + 1), -(-nodes.count() // BUCKET))
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(g)).cast("int")
    dealt = nodes.select(bucket("code").alias("bucket"), "code", "p", "out", "onward").repartition(g, "bucket").sortWithinPartitions("bucket", "code")
    fixed = keep(dealt.mapInArrow(_vectors, "bucket int, codes binary, rank binary, inverse binary, sent binary, lost double"))
    packed = e.select((bucket("source") * g + bucket("target")).alias("cell"), F.col("source").cast("long"), F.col("target").cast("long"), "weight").mapInArrow(_packed, "cell int, source binary, target binary, weight binary")
    heads = fixed.select(F.col("bucket").alias("i"), F.col("codes").alias("source")).crossJoin(fixed.select(F.col("bucket").alias("j"), F.col("codes").alias("target")))
    heads = heads.select((F.col("i") * g + F.col("j")).alias("cell"), F.lit(0).alias("first"), "source", "target", F.lit(None).cast("binary").alias("weight"))
    rows = heads.union(packed.select("cell", F.lit(1), "source", "target", "weight")).repartition(g * g, "cell").sortWithinPartitions("cell", "first")
    cells = rows.mapInArrow(_numbered, "cell int, piece int, size int, source binary, target binary, weight binary")
    was = spark.conf.get(WHOLE_KEYS)
    spark.conf.set(WHOLE_KEYS, "false")  # edges dealt by cell are joined by cell and piece where they lie
    cells = cells.repartition(g * g, "cell").sortWithinPartitions("cell", "piece").persist(StorageLevel.DISK_ONLY)
    try:
        step, lost = fixed, sum(r["lost"] for r in fixed.select("lost").collect())
        for number in range(rounds):
            asked = step.select(F.explode(F.sequence(F.col("bucket") * g, F.col("bucket") * g + g - 1)).alias("cell"), F.lit(0).alias("piece"), "sent").repartition(g * g, "cell")
            sums = cells.join(asked.hint("merge"), ["cell", "piece"], "left").select("cell", "size", "source", "target", "weight", "sent").mapInArrow(_products, "cell int, got binary")
            none = F.lit(None).cast("binary")
            parts = fixed.select("bucket", F.lit(0).alias("kind"), F.col("rank").alias("one"), F.col("inverse").alias("two")).union(step.select("bucket", F.lit(1), "rank", none))
            parts = parts.union(sums.select(F.col("cell") % g, F.lit(2) + F.floor(F.col("cell") / g).cast("int"), "got", none)).repartition(g, "bucket").sortWithinPartitions("bucket", "kind")
            step = keep.round(parts.mapInArrow(_moved(alpha, lost), "bucket int, rank binary, sent binary, change double, lost double"), number)
            told = step.select("change", "lost").collect()  # one row a bucket
            lost = sum(r["lost"] for r in told)
            if sum(r["change"] for r in told) < tolerance:
                break
        ranks = step.select("bucket", "rank").join(fixed.select("bucket", "codes"), "bucket").select("codes", "rank").mapInArrow(_ranks, "code long, rank double")
        return ranks.select(F.col("code").cast(kind).alias("id"), "rank") if whole else ranks.join(nodes.select("code", "id"), "code").select("id", "rank")
    finally:
        cells.unpersist()
        spark.conf.set(WHOLE_KEYS, was)


def lint_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, label, source_uri, fetched_at), edges -> category, id of each finding; a repeated address names its ids, cut at 300."""
    both = undirected(edges)
    ids = nodes.select("id")
    named = lambda c: [F.lit(c).alias("category"), F.col("id").cast("string").alias("id")]
    orphan = ids.join(both.select(F.col("source").alias("id")), "id", "left_anti").select(*named("orphan"))
    key = F.concat_ws("|", F.col("source").cast("string"), F.col("target").cast("string"))
    missing = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").unionByName(edges.join(ids.select(F.col("id").alias("target")), "target", "left_anti")).distinct()
    dead = missing.select(F.lit("dead-edge").alias("category"), key.alias("id"))
    blank = nodes.filter(F.trim(F.coalesce("label", F.lit(""))) == "").select(*named("empty-label"))
    undated = nodes.filter("fetched_at is null").select(*named("missing-fetched-at"))
    leaks = nodes.filter(F.size(secret_matches(F.concat_ws("\n", F.col("id").cast("string"), "label", "source_uri"))) > 0).select(*named("stale-secret-match"))
    # ids are cut at 300 characters, so the list kept for an address is short
    twice = nodes.filter("source_uri is not null").select("source_uri", F.col("id").cast("string").alias("id"))
    w = Window.partitionBy("source_uri")
    first = twice.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("id"))).filter("n >= 2 and k <= 150")
    repeated = first.groupBy("source_uri").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.lit("duplicate-uri").alias("category"), F.substring(F.array_join("ids", ","), 1, 300).alias("id"))
    return orphan.unionByName(dead).unionByName(blank).unionByName(undated).unionByName(leaks).unionByName(repeated)


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows whose required fields are there and not blank."""
    return nodes.filter(" and ".join(f"coalesce(cast({c} as string), '') <> ''" for c in ("id", "label", "file_type", "source_file")))


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Shallow merge by key: a new field wins where it is not null; a map column is merged entry by entry.

    Several new rows of one key are merged one over the other in `order`, a column of the new side alone.
    """
    maps = {f.name for f in old.schema.fields if f.dataType.typeName() == "map"}
    n = _folded(new, [key], order, old.columns, maps)
    return _merged(old, n, F.col(f"o.{key}") == F.col(f"n.{key}"), old.columns, maps)
