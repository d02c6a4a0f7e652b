"""Greedy groups of similar entries in time order, block after block.

Taken one after the other, an entry that is not yet taken takes the later ones within the cosine. So a round decides one block of
each workspace: its entries meet all later ones that are free, spread over tasks; of what they find only each one's most
similar, a few times as many as it may take, come together in the task that decides the block in order. Where those do not settle
an entry, it and the rest of the block wait for the next round. The result is that of the sequential loop; rounds are
the blocks of the largest workspace, and no table of all similar pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, scratched, shuffle_partitions

#: Vectors of one block (a unit of similar_pairs holds two), later vectors of one part, and of one piece that is compared at once.
BLOCK, PART, PIECE = 2048, 1 << 14, 1024
#: An entry's list holds so many times what it may take.
LISTED = 8


def _key(df: DataFrame) -> DataFrame:
    """Entries with vectors of unit length (zero stays zero); those without a vector, or with a component that is null or not finite, are left out."""
    v = F.col("vector")
    if df.schema["vector"].dataType.simpleString() != "array<float>":  # half the bytes, the same values
        v = v.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    e = df.select(F.coalesce(F.col("workspace").cast("string"), F.lit("")).alias("workspace"), "id", "at", v.alias("vector")).filter(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))
    return e.withColumn("key", F.struct("at", "id"))


def similar_pairs(entries: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """entries(workspace, key, vector) -> workspace, a, b, sim: keys a < b of one workspace with cosine >= least, exactly.

    A workspace is cut into blocks by hash; each pair of blocks is a unit of work, so a row is sent once for each block of its workspace.
    """
    parts = entries.groupBy("workspace").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    x = entries.join(parts, "workspace").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select("workspace", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "key", "vector")
    x = x.repartition(shuffle_partitions(entries.sparkSession), "workspace", "low", "high").sortWithinPartitions("workspace", "low", "high")
    kind = entries.schema["key"].dataType.simpleString()

    def pairs(rows: list[tuple], unit: tuple) -> Iterator[pa.RecordBatch]:
        for size in {len(r[2]) for r in rows}:
            some = [r for r in rows if len(r[2]) == size]
            v = np.array([r[2] for r in some], float)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v /= np.where(norm == 0, 1, norm)
            own = np.array([r[0] for r in some])
            left = np.flatnonzero(own == unit[1])
            right = np.flatnonzero(own == unit[2])
            sim = v[left] @ v[right].T
            i, j = np.nonzero(sim >= least)
            out = []
            for p, q, s in zip(left[i].tolist(), right[j].tolist(), sim[i, j].tolist(), strict=True):
                a, b = some[p][1], some[q][1]
                order = (a["at"], a["id"]) < (b["at"], b["id"])
                if p == q or (unit[1] == unit[2] and not order):
                    continue
                out.append((a, b, s) if order else (b, a, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([unit[0]] * len(out)), pa.array([o[0] for o in out], kinds), pa.array([o[1] for o in out], kinds), pa.array([o[2] for o in out])], ["workspace", "a", "b", "sim"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(entries.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for b in batches:
            for w, low, high, own_, key, vector in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (w, low, high) != unit:
                    if unit is not None:
                        yield from pairs(rows, unit)
                    unit, rows = (w, low, high), []
                rows.append((own_, key, vector))
        if unit is not None:
            yield from pairs(rows, unit)

    return x.mapInArrow(run, f"workspace string, a {kind}, b {kind}, sim double")


def _units(rows: DataFrame, kind: str, work: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], *by: str) -> DataFrame:
    """work(batches of one unit, the columns of `by` left out) for each unit of rows that lie together in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(j).to_numpy() for j in range(len(by))])
            edges = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for s, t in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if (now := tuple(at[:, s])) != unit:
                    if held:
                        yield from work(held)
                    unit, held = now, []
                held.append(b.slice(s, t - s).select(b.schema.names[len(by) :]))
        if held:
            yield from work(held)

    return rows.mapInArrow(run, kind)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows of unit length; zero stays zero."""
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def _parted(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Rows kind, i, vector in order of kind -> i and vectors of kind 0 in order of i, and pieces of those of kind 1."""
    own = [b.filter(pa.array(b.column(0).to_numpy() == 0)) for b in batches]
    ids = np.concatenate([b.column(1).to_numpy() for b in own])
    if not len(ids):
        return ids, np.zeros((0, 0)), iter(())
    q = np.concatenate([_matrix(b.column(2)) for b in own if b.num_rows])
    order = np.argsort(ids)

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            rest = b.filter(pa.array(b.column(0).to_numpy() == 1))
            for at in range(0, rest.num_rows, PIECE):
                some = rest.slice(at, PIECE)
                yield some.column(1).to_numpy(), _matrix(some.column(2))

    return ids[order], q[order], pieces()


def _first(rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int | None) -> np.ndarray:
    """Places of the first `most` of each row by similarity (rounded, so that copies are equal), then id."""
    o = np.lexsort((ids, -np.round(sims, 12), rows))
    if most is None or not len(o):
        return o
    r = rows[o]
    start = np.r_[True, r[1:] != r[:-1]]
    return o[np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) < most]


def _lists(units: DataFrame, least: float, most: int | None) -> DataFrame:
    """units(g, part, kind 0 asked or 1 later, i, vector) -> g, a, y, sim, n: of each asked entry the most similar later ones of a part, n of them in all."""

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, pieces = _parted(batches)
        kept, new, n = (np.zeros(0, int), np.zeros(0), np.zeros(0, int)), [], np.zeros(len(ids), int)

        def cut() -> tuple[np.ndarray, ...]:
            x = tuple(np.concatenate(c) for c in zip(kept, *new, strict=True))
            o = _first(*x, most)
            return tuple(c[o] for c in x)

        for names, v in pieces:
            sim = q @ v.T
            i, j = np.nonzero(sim >= least)
            n += np.bincount(i, minlength=len(ids))
            new.append((i, sim[i, j], names[j]))
            if sum(len(c[0]) for c in new) > PIECE * BLOCK // 4:
                kept, new = cut(), []
        rows, sims, found = cut()
        for at in range(0, len(rows), 1 << 16):
            r = rows[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found[at : at + len(r)]), pa.array(sims[at : at + len(r)]), pa.array(n[r])], ["a", "y", "sim", "n"])

    return _units(units, "a long, y long, sim double, n long", work, "g", "part")


def _decide(ids: np.ndarray, v: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray, bool]], least: float, fewest: int, most: int | None) -> list[tuple[int | None, int, int | None]]:
    """Entry after entry of one block: leader, entry, place of those that are taken or lead; leader null: decided, in no group.

    lists has of each entry the later ones outside of the block, most similar first, and whether there are more. Where what is
    left of such a list does not settle an entry, it ends: this and all after it wait for the next round.
    """
    near = v @ v.T
    free, gone, out = np.ones(len(ids), bool), set(), []
    for a in range(len(ids)):
        if not free[a]:
            continue
        inside = np.flatnonzero((near[a, a + 1 :] >= least) & free[a + 1 :]) + a + 1
        ys, sims, more = lists.get(ids[a], (np.zeros(0, int), np.zeros(0), False))
        left = [j for j, y in enumerate(ys.tolist()) if y not in gone] if gone else list(range(len(ys)))
        n = len(left) + len(inside)
        if more and (n + 1 < fewest or n < most or len(left) < most - 1):
            break
        free[a] = False
        if n + 1 < fewest:
            out.append((None, int(ids[a]), None))
            continue
        names, sim = np.r_[ids[inside], ys[left]].astype(int), np.r_[near[a, inside], sims[left]]
        o = np.argsort(names)
        if most is not None and n + 1 > most:
            o = np.lexsort((names, -np.round(sim, 12)))[: most - 1]
        free[inside[o[o < len(inside)]]] = False
        gone.update(names[o[o >= len(inside)]].tolist())
        out += [(int(ids[a]), y, place) for place, y in enumerate([int(ids[a]), *names[o].tolist()])]
    return out


def _round(asked: DataFrame, lists: DataFrame | None, least: float, fewest: int, most: int | None, wide: int | None) -> DataFrame:
    """asked(g, i, vector), lists -> leader, i, place: what a block of each group decides; one task holds one block and its lists."""
    rows = asked.select("g", F.lit(0).alias("kind"), "i", "vector", F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("n"))
    if lists is not None:
        rows = rows.unionByName(lists.join(asked.select("g", F.col("i").alias("a")), "a").select("g", F.lit(1).alias("kind"), F.col("a").alias("i"), F.lit(None).cast(asked.schema["vector"].dataType).alias("vector"), "y", "sim", "n"))
    rows = rows.repartition(shuffle_partitions(asked.sparkSession), "g").sortWithinPartitions("g", "kind", "i")

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        kind = t["kind"].to_numpy()
        own = t.filter(pa.array(kind == 0)).combine_chunks()
        ids, v = own["i"].to_numpy(), np.concatenate([_matrix(c) for c in own["vector"].chunks])
        a, y, sim, n = (t[c].filter(pa.array(kind == 1)).to_numpy() for c in ("i", "y", "sim", "n"))
        y, n = y.astype(int), n.astype(int)
        o = _first(a, sim, y, None)
        edges = np.r_[0, np.flatnonzero(a[o][1:] != a[o][:-1]) + 1, len(o)] if len(o) else np.zeros(1, int)
        found = {}
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            x = o[s:e]
            more = wide is not None and (len(x) > wide or bool((n[x] > wide).any()))
            found[a[x[0]]] = y[x[:wide]], sim[x[:wide]], more
        out = _decide(ids, v, found, least, fewest, most)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["leader", "i", "place"])

    return _units(rows, "leader long, i long, place int", work, "g")


def _taken(units: DataFrame, least: float) -> DataFrame:
    """units(g, part, kind 0 leading or 1 later, i, vector) -> leader, i, place: each later entry with the first leader within the cosine."""

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, pieces = _parted(batches)
        for names, v in pieces:
            near = q @ v.T >= least
            hit = np.flatnonzero(near.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[near[:, hit].argmax(0)]), pa.array(names[hit]), pa.nulls(len(hit), pa.int32())], ["leader", "i", "place"])

    return _units(units, "leader long, i long, place int", work, "g", "part")


@scratched
def greedy_clusters(entries: DataFrame, least: float = 0.8, fewest: int = 5, most: int | None = 100, *, keep: Scratch) -> DataFrame:
    """entries(workspace, id, at, vector) -> workspace, cluster, id, place: greedy groups in the order of (at, id).

    An entry not yet taken takes the later ones within the cosine; with fewer than `fewest` together it takes none and is not
    taken later either; of more than `most` it keeps the most similar (ties in order), in that order, and leaves the rest
    free. cluster is the first entry's id, place 0; a null workspace counts as ''. Repeated (at, id) are one entry.
    """
    spark, n = entries.sparkSession, shuffle_partitions(entries.sparkSession)
    e = keep(_key(entries).dropDuplicates(["workspace", "key"]).withColumn("size", F.size("vector")))
    by = ["workspace", "size", "key"]  # vectors of different size are never similar
    blocks = max(1, -(-e.count() // BLOCK))
    # i follows the order of keys within a group; its upper bits are the block
    e = keep(e.repartitionByRange(blocks, *by).sortWithinPartitions(*by).withColumn("i", F.monotonically_increasing_id()))
    groups = e.groupBy("workspace", "size").agg(F.min("i").alias("g"))
    live = keep.round(e.join(groups, ["workspace", "size"]).select("g", "i", "vector"), 0)
    alone = most is None and fewest <= 1  # whoever is free leads, so a block decides without the entries after it
    wide = None if most is None else LISTED * max(most, fewest)
    made, number = [], 0
    while not live.isEmpty():
        block = F.shiftright("i", 33)
        head = live.groupBy("g").agg(F.min(block).alias("block"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        x = live.join(head, "g")
        asked = x.filter(block == F.col("block"))
        later = x.filter(block > F.col("block")).select("g", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "i", "vector")
        sent = asked.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "i", "vector")
        together = lambda a: a.unionByName(later).repartition(n, "g", "part").sortWithinPartitions("g", "part", "kind")
        own = asked.select("g", "i", "vector")
        if alone:
            first = keep(_round(own, None, least, fewest, most, wide))
            lead = sent.join(first.filter("leader = i").select("i"), "i", "left_semi").select("g", "part", "kind", "i", "vector")
            out = first.unionByName(keep(_taken(together(lead), least)))
        else:
            out = keep(_round(own, _lists(together(sent), least, wide), least, fewest, most, wide))
        made.append(out)
        number += 1
        live = keep.round(live.join(out.select("i"), "i", "left_anti").select("g", "i", "vector"), number)
    every = reduce(DataFrame.unionByName, made, spark.createDataFrame([], "leader long, i long, place int")).filter("leader is not null")
    if most is None:
        every = every.withColumn("place", F.row_number().over(Window.partitionBy("leader").orderBy("i")) - 1)
    names = e.select("i", "workspace", F.col("key.id").alias("id"))
    leaders = names.select(F.col("i").alias("leader"), "workspace", F.col("id").alias("cluster"))
    return every.join(leaders, "leader").join(names.select("i", "id"), "i").select("workspace", "cluster", "id", F.col("place").cast("int").alias("place"))


def subject_clusters(queries: DataFrame, least: float = 0.55) -> DataFrame:
    """queries(workspace, id, at, vector) -> workspace, cluster, id, place: greedy groups without limits; every query is in one."""
    return greedy_clusters(queries, least, 1, None)
