import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.frames import Scratch
from graphloom.llm.merkle import ARITY, OP11_SQL, append, append_log, folded, height, log_rows, manifest, op11_merkle_manifest, position
from graphloom.llm.ranks import ranked

SF = "/root/testdata/sf0.001"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, text):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_of(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][at : at + ARITY])) for at in range(0, len(out[-1]), ARITY)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i - i % ARITY
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
        i //= ARITY
    return out


def plain(rows):
    """Expected result rows of a list of document rows, by a plain loop."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[s] = levels_of([leaf_of(r, r["text"]) for r in by[s]])
    above = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            proof = path(trees[s], i) + path(above, k)
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = leaf_of(r, text)
            for left, right in proof:
                acc = digest(left + acc + right)
            root = above[-1][0]
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], root, digest("".join(a + b for a, b in proof)), acc, acc == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(spark, docs, monkeypatch):
    monkeypatch.setattr("graphloom.llm.merkle.read", lambda *a: docs)
    return sorted((tuple(r[c] for c in COLUMNS) for r in op11_merkle_manifest(spark, "").collect()), key=str)


def test_positions_are_the_order_of_completion():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4097):
        log, at = append([k.to_bytes(32, "big") for k in range(n)], height(n)), {}
        levels = levels_of([k.to_bytes(32, "big").hex() for k in range(n)])
        for level, nodes in enumerate(levels):
            for i, h in enumerate(nodes):
                at[position(level, i, n)] = h
        assert [x.hex() for x in log] == [at[k] for k in range(len(log))] and len(at) == len(log)


def test_query_against_plain_loop_and_sql(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op11_merkle_manifest(spark, SF).collect()), key=str)
    assert got == plain(rows) and not all(r[-1] for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(OP11_SQL)
    assert [c[0] for c in rel.description] == COLUMNS
    assert sorted(rel.fetchall(), key=str) == got


def test_odd_rows(spark, odd_docs, monkeypatch):
    rows = [{c: r[i] for i, c in enumerate(odd_docs.columns[:5])} for r in odd_docs.collect()]
    assert query(spark, odd_docs, monkeypatch) == plain(rows)
    assert query(spark, odd_docs.limit(0), monkeypatch) == []
    assert query(spark, odd_docs.filter("doc_id = 7"), monkeypatch) == plain([r for r in rows if r["doc_id"] == 7])


@pytest.mark.parametrize("n", [273, 4500])
def test_many_leaves_many_sources(spark, monkeypatch, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit(3).alias("n_chars"))
    assert query(spark, docs, monkeypatch) == plain([r.asDict() for r in docs.collect()])


def test_three_rounds_log_and_proofs(spark):
    """One source of more than 256 * 256 leaves: the log holds each node once, at its position, and all proofs fold to the root."""
    n = 66_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).alias("n_chars"))
    with Scratch(spark) as keep:
        proofs = manifest(docs, keep).select("doc_id", (folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), F.size("proof").alias("levels"))
        assert proofs.groupBy("ok", "levels").count().collect() == [(True, 5, n)]
        leaves = ranked(spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("d")), "tree", ["doc_id"], keep)
        rounds, tops = append_log(leaves.select("tree", "index", "n", F.unhex("d").alias("digest"), "doc_id", F.lit(None).cast("binary").alias("claimed")), keep)
        assert len(rounds) == 3
        log = {r.position: (r.level, r["index"], r.digest) for r in log_rows(rounds).collect()}
        want = append([hashlib.sha256(str(k).encode()).digest() for k in range(n)], height(n))
        assert [bytes(log[k][2]) for k in range(len(want))] == want and len(log) == len(want)
        assert bytes(tops.first()["top"]) == want[-1]


def test_ranked_splits_groups_and_equal_rows(spark):
    df = spark.range(5000, numPartitions=7).select(F.lit("g").alias("g"), F.when(F.col("id") % 2 == 0, F.lit(1)).alias("x"))
    df = df.unionByName(spark.createDataFrame([("h", 5), ("h", 4)], "g string, x int"))
    with Scratch(spark) as keep:
        rows = ranked(df, "g", ["x"], keep).collect()
    assert sorted(r["index"] for r in rows if r.g == "g") == list(range(5000)) and all(r.n == 5000 for r in rows if r.g == "g")
    assert max(r["index"] for r in rows if r.g == "g" and r.x is None) == 2499
    assert sorted((r["index"], r.x, r.n) for r in rows if r.g == "h") == [(0, 4, 2), (1, 5, 2)]
