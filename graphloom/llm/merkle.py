"""Merkle manifest of a data set as a postorder append log (operator 11).

Each tree (the documents of one source) has its leaves in order; every ARITY neighbours have a parent, level
by level up to one node, and the trees' tops are the leaves of one tree above them. Leaves are numbered by a
distributed rank and dealt to aligned builders: a builder takes SPAN leaves that begin at a multiple of SPAN, so
its nodes are whole subtrees. It appends each node as soon as it is complete, so a subtree's nodes stand
together, its root last, and a node's place in the log follows from subtree sizes alone (position). A
segment, the stretch of log of one builder, is one row. Tops of segments are the leaves of the next round, until each
tree has one node: a round has 1 / SPAN of the rows of the one before, so the driver counts rounds, not nodes.

Proofs go down from the top: a segment row with the path of its own top finds its nodes' siblings by
their positions. Both sides of that join have one row a segment, so a source of a third of all rows is spread
over as many rows as it has segments.

Defined results: fields that are null count as `-`; a null source is a tree of its own, first in order; leaves of
a tree go by doc_id, null first, then by digest, and equal rows are leaves of their own; a null doc_id is never
tampered with; an empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, shuffle_partitions, stored
from graphloom.llm.ranks import ranked
from graphloom.llm.runs import blocks

#: Children of a node; levels that one builder completes; leaves of one builder.
ARITY, LEVELS = 16, 2
SPAN = ARITY**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def position(level: int, index: np.ndarray | int, n: int, top: int | None = None) -> np.ndarray | int:
    """Place in the log, from 0, of a node of a tree of n leaves with `top` levels (by default all).

    What is complete when the node is: its own subtree and what stands left of it (the nodes of its level and below
    that begin no later), and of each higher level the nodes that end before its subtree begins.
    """
    top = height(n) if top is None else top
    begin, end = index * ARITY**level, np.minimum(n, (index + 1) * ARITY**level)
    return sum(-(-end // ARITY**t) for t in range(level + 1)) + sum(begin // ARITY**t for t in range(level + 1, top + 1)) - 1


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def append(leaves: list[bytes], top: int) -> list[bytes]:
    """The nodes of `top` levels over the leaves, in the order in which they are complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def complete(level: int, digest: bytes) -> None:
        log.append(digest)
        open_[level].append(digest)
        if level < top and len(open_[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        complete(level + 1, parent(run))

    for d in leaves:
        complete(0, d)
    for level in range(top):
        if open_[level]:
            close(level)
    return log


_SEGMENT = "tree string, block long, n long, nodes binary, top binary, doc_ids array<long>, claimed array<binary>"


def _segments(leaves: DataFrame, named: bool) -> DataFrame:
    """leaves(tree, index, n, digest; with named: doc_id, claimed) -> a row for each builder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in blocks(batches, ["tree", "block"], SPAN):
            digests = t.column("digest").to_pylist()
            trees, block, n = t.column("tree"), t.column("block").to_numpy(), t.column("n").to_numpy()
            rows = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                log = append(digests[s:e], min(LEVELS, height(int(n[s]))))
                row = {"tree": trees[s].as_py(), "block": int(block[s]), "n": int(n[s]), "nodes": b"".join(log), "top": log[-1]}
                if named:
                    row |= {"doc_ids": t.column("doc_id")[s:e].to_pylist(), "claimed": t.column("claimed")[s:e].to_pylist()}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("top", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("claimed", pa.list_(pa.binary()))])
    dealt = leaves.withColumn("block", F.floor(F.col("index") / SPAN)).select("tree", "block", "index", "n", "digest", *(["doc_id", "claimed"] if named else []))
    dealt = dealt.repartition(shuffle_partitions(leaves.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "index")
    return dealt.mapInArrow(run, _SEGMENT)


def append_log(leaves: DataFrame, keep: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """leaves(tree, index, n, digest, doc_id, claimed) -> segments of each round, and (tree, top)."""
    rounds = [keep(_segments(leaves, True))]
    while True:
        more = rounds[-1].filter(F.col("n") > SPAN)
        if more.isEmpty():
            break
        up = more.select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest"))
        rounds.append(keep(_segments(up, False)))
    tops = [r.filter(F.col("n") <= SPAN).select("tree", "top") for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return rounds, keep(out)


def log_rows(rounds: list[DataFrame]) -> DataFrame:
    """Segments -> the whole log: tree, position, level, index, digest."""

    def rows(k: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.select(["tree", "block", "leaves", "n", "nodes"]).to_pylist():
                    m = min(SPAN, r["n"] - r["block"] * SPAN)
                    top = min(LEVELS, height(r["n"]))
                    for level in range(0 if k == 0 else 1, top + 1):
                        j = np.arange(-(-m // ARITY**level))
                        index = j + r["block"] * ARITY ** (LEVELS - level)
                        slot = position(level, j, m, top)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["tree"]] * len(j)), pa.array(position(level + k * LEVELS, index, r["leaves"])), pa.array(np.full(len(j), level + k * LEVELS)), pa.array(index), pa.array([r["nodes"][32 * x : 32 * x + 32] for x in slot.tolist()])],
                            ["tree", "position", "level", "index", "digest"],
                        )

        return run

    size = rounds[0].select("tree", F.col("n").alias("leaves")).distinct()
    parts = [r.join(size, "tree").select("tree", "block", "leaves", "n", "nodes").mapInArrow(rows(k), "tree string, position long, level long, index long, digest binary") for k, r in enumerate(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def siblings(nodes: bytes, m: int, top: int) -> list[list[tuple[str, str]]]:
    """Of a segment of m leaves: for each level below the top, and each node of it, the digests left and right of it in its run."""
    out = []
    for level in range(top):
        j = np.arange(-(-m // ARITY**level))
        digests = [nodes[32 * x : 32 * x + 32].hex() for x in position(level, j, m, top).tolist()]
        runs = [digests[at : at + ARITY] for at in range(0, len(digests), ARITY)]
        out.append([("".join(r[:k]), "".join(r[k + 1 :])) for r in runs for k in range(len(r))])
    return out


_PATH = "array<struct<left: string, right: string>>"


def _down(segments: DataFrame, paths: DataFrame, named: bool) -> DataFrame:
    """Segments and their tops' paths (tree, block, subroot, root, path) -> each leaf of theirs with its path.

    The same columns again for the next lower round, or with named: doc_id, leaf, claimed, subroot, root, proof.
    """
    columns = ["doc_id", "leaf", "claimed", "subroot", "root", "proof"] if named else ["tree", "block", "subroot", "root", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                m = min(SPAN, r["n"] - r["block"] * SPAN)
                top = min(LEVELS, height(r["n"]))
                near = siblings(r["nodes"], m, top)
                pairs = [p for level in near for p in level] + [(x["left"], x["right"]) for x in r["path"]]
                # each leaf's pairs by their place in that list: its own ancestor of each level, then all above
                first = np.cumsum([0, *map(len, near)])
                leaf = np.arange(m)
                at = np.stack([first[level] + leaf // ARITY**level for level in range(top)] + [np.full(m, first[top] + x) for x in range(len(r["path"]))], 1) if len(pairs) else np.zeros((m, 0), np.int64)
                store = pa.StructArray.from_arrays([pa.array([p[x] for p in pairs], pa.string()) for x in (0, 1)], ["left", "right"])
                proofs = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * at.shape[1], pa.int32()), store.take(pa.array(at.ravel())))
                above = [pa.array([r[c]] * m, pa.string()) for c in ("subroot", "root")]
                if named:
                    digests = [r["nodes"][32 * x : 32 * x + 32] for x in position(0, leaf, m, top).tolist()]
                    data = [pa.array(r["doc_ids"], pa.int64()), pa.array(digests, pa.binary()), pa.array(r["claimed"], pa.binary()), *above, proofs]
                else:
                    data = [pa.array([r["tree"]] * m, pa.string()), pa.array(r["block"] * SPAN + leaf), *above, proofs]
                yield pa.RecordBatch.from_arrays(data, columns)

    both = segments.select("tree", "block", "n", "nodes", *(["doc_ids", "claimed"] if named else [])).join(paths, ["tree", "block"])
    schema = f"doc_id long, leaf binary, claimed binary, subroot string, root string, proof {_PATH}" if named else f"tree string, block long, subroot string, root string, path {_PATH}"
    return both.mapInArrow(run, schema)


def extract(rounds: list[DataFrame], above: DataFrame, keep: Scratch, named: bool = True) -> DataFrame:
    """All leaves' proofs, from the trees' tops (tree, subroot, root, path) down, as _down gives them."""
    first = above.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "path")
    paths = None
    for k in reversed(range(len(rounds))):
        here = rounds[k].filter(F.col("n") <= SPAN).select("tree").join(first, "tree")
        paths = _down(rounds[k], here if paths is None else here.unionByName(paths), named and k == 0)
        if k:
            paths = keep(paths)
    return paths


def hashed(*columns: Column) -> Column:
    """Lowercase hex digest of the fields, each `-` or its byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c), F.lit(":"), c)) for c in texts]), 256)


def manifest(docs: DataFrame, keep: Scratch, claimed: Column | None = None) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, leaf, claimed, subroot, root, proof.

    proof: for each level up to the root the digests left and right in the run. claimed: a column of docs, the
    text that is held against the manifest; its leaf is returned (null without one). Digests are lowercase hex.
    The result reads tables of `keep`.
    """
    d = pick(docs, *FIELDS)
    d = d.withColumn("claim_", F.lit(None).cast("string") if claimed is None else claimed)
    fields = [F.col(c) for c in FIELDS]
    tree = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    changed = F.when(F.col("claim_").isNotNull(), hashed(*fields[:-1], F.col("claim_")))
    leaves = keep(d.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(hashed(*fields)).alias("digest"), F.unhex(changed).alias("claimed")))
    rounds, tops = append_log(ranked(leaves, "tree", ["doc_id", "digest"], keep), keep)
    # the trees' tops, in order, are the leaves of the tree above
    upper = keep(ranked(tops.withColumn("all", F.lit("")), "all", ["tree"], keep))
    nobody = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("claimed")]
    whole, root = append_log(upper.select(F.col("all").alias("tree"), "index", "n", F.col("top").alias("digest"), *nobody), keep)
    start = root.select("tree", F.lit("").alias("subroot"), F.lower(F.hex("top")).alias("root"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    paths = extract(whole, start, keep, named=False).select(F.col("block").alias("index"), "root", "path")
    above = keep(upper.join(paths, "index").select("tree", F.lower(F.hex("top")).alias("subroot"), "root", "path"))
    proofs = extract(rounds, above, keep)
    return proofs.withColumns({c: F.lower(F.hex(c)) for c in ("leaf", "claimed")})


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every fifth text (by checksum) is tampered with."""
    docs = read(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    with Scratch(spark) as keep:
        m = manifest(docs, keep, F.when(hit, F.translate("text", upper, upper.lower())))
        flat = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
        root = folded(F.coalesce("claimed", "leaf"), F.col("proof"))
        out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(flat, 256).alias("proof_sha256"), root.alias("folded_root"))
        return stored(out.withColumn("verified", F.col("folded_root") == F.col("root")))


#: The checksum of the decimal doc_id bit by bit; trees level by level; each level's siblings; folding upwards.
OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS row_id,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda crc, b:
      list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
f AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claim,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS fields
  FROM d),
h AS (
  SELECT *, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(fields || coalesce(strlen(claim) || ':' || claim, '-')) AS claimed FROM f),
leaves AS (
  SELECT row_id, doc_id, coalesce('=' || source, '-') AS tree, leaf, claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
t(tree, lv, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL SELECT tree, any_value(lv) + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, i // 16),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, (SELECT max(lv) FROM t x WHERE x.tree = t.tree) AS top FROM t WHERE n = 1),
u(lv, i, n, h) AS (
  SELECT 0, i, n, subroot FROM sub
  UNION ALL SELECT any_value(lv) + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 16),
steps AS (
  SELECT l.row_id, t.lv, l.i // pow(16, t.lv)::BIGINT AS own, t.i, t.h FROM leaves l JOIN t ON t.tree = l.tree AND t.n > 1 AND t.i // 16 = l.i // pow(16, t.lv + 1)::BIGINT
  UNION ALL SELECT l.row_id, s.top + u.lv, s.i // pow(16, u.lv)::BIGINT, u.i, u.h FROM leaves l JOIN sub s ON s.tree = l.tree JOIN u ON u.n > 1 AND u.i // 16 = s.i // pow(16, u.lv + 1)::BIGINT),
sides AS (
  SELECT row_id, lv, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS r FROM steps GROUP BY row_id, lv),
proof AS (SELECT row_id, sha256(string_agg(l || r, '' ORDER BY lv)) AS proof_sha256, max(lv) + 1 AS levels FROM sides GROUP BY row_id),
up(row_id, lv, acc) AS (
  SELECT row_id, 0, claimed FROM leaves
  UNION ALL SELECT up.row_id, up.lv + 1, sha256(s.l || up.acc || s.r) FROM up JOIN sides s ON s.row_id = up.row_id AND s.lv = up.lv)
SELECT l.doc_id, l.leaf, s.subroot, root.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, up.acc AS folded_root, up.acc = root.h AS verified
FROM leaves l JOIN sub s ON s.tree = l.tree CROSS JOIN (SELECT h FROM u WHERE n = 1) root LEFT JOIN proof p ON p.row_id = l.row_id JOIN up ON up.row_id = l.row_id AND up.lv = coalesce(p.levels, 0)
"""
