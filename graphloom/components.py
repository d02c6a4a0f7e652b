"""Connected components of an edge table by local forests, hooking, pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.frames import Scratch, scratched

#: Nodes that one task's forest holds before it is sent on and begun anew.
FOREST = 500_000


def local_forests(edges: DataFrame) -> DataFrame:
    """edges(hi, lo) -> edges that connect the same nodes, each from a node to the least one its task has joined it to.

    The map-side combine of connectivity: a task sends at most one edge for each node it has seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(x), root(y)
                if a != c:
                    parent[max(a, c)] = min(a, c)
            if len(parent) > FOREST:
                out = [(x, root(x)) for x in list(parent)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], b.schema.field(k).type) for k in (0, 1)], ["hi", "lo"])
                parent = {}
            kind = b.schema
        if parent:
            out = [(x, root(x)) for x in list(parent)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind.field(k).type) for k in (0, 1)], ["hi", "lo"])

    return edges.select("hi", "lo").mapInArrow(run, edges.select("hi", "lo").schema)


def _roots(parents: DataFrame, keep: Scratch) -> DataFrame:
    """Follow parent pointers (child > parent) to the root of each tree; doubles the reach each round."""
    cur = parents
    while True:
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = keep(cur.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        cur = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return cur


@scratched
def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """edges(a, b) of any one orderable type -> (node, component): component is the smallest node reached.

    Only nodes with an edge to another node come back; loops, nulls and repeated edges are ignored,
    an empty table gives an empty result. Each task first joins the edges it holds; then every node hooks
    to its smallest smaller neighbour, trees are flattened by pointer jumping, and edges are contracted
    to roots. A hub's edges meet in a min() that is combined before the shuffle. The driver sees only
    emptiness tests.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = keep(local_forests(e).distinct())
    found = None
    while not e.isEmpty():
        roots = _roots(keep(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))), keep)
        low = roots.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        high = roots.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        joined = e.join(high, "hi").join(low, "lo", "left").select(F.col("hi_root").alias("x"), F.coalesce("lo_root", "lo").alias("y"))
        joined = joined.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
        e = keep(local_forests(joined).distinct())
        if found is None:
            found = roots
        else:
            newer = roots.select(F.col("node").alias("root"), F.col("root").alias("newer"))
            moved = found.join(newer, "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
            found = keep(moved.unionByName(roots))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).filter(F.lit(False))
    tops = found.select(F.col("root").alias("node"), "root").distinct()
    return keep(found.unionByName(tops).select("node", F.col("root").alias("component")))
