"""Ranking operators over tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.frames import Scratch, shuffle_partitions, stored
from graphloom.functions.text import search_tokens
from graphloom.operators.vectors import best, l2, search


#: Stands for the document itself among its terms; no token is empty.
WHOLE = ""
#: Pairs of a query and a term in one block, postings in one part (at most, at least), cells and additions that a task works on at once.
ASKED, PART, LEAST_PART, CELLS = 1 << 18, 1 << 21, 1 << 16, 1 << 20


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(doc_id, text), terms(term, code) -> doc_id, dl, code, tf of the terms asked for; the code of WHOLE gives every document's length.

    One pass over the texts: tokens that nobody asks for are dropped before the shuffle (the distinct terms are sent to
    the tasks where Spark finds them small enough), the others are counted in the task first, so a posting is shuffled, never a text.
    """
    tokens = docs.select("doc_id", search_tokens(F.col("text")).alias("tokens"))
    each = tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.lit(WHOLE)))).alias("term"))
    return each.join(terms, "term").groupBy("doc_id", "dl", "code").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries(query_id, text), docs(doc_id, text) -> query_id, doc_id, score, rank; OR of the query's terms.

    Postings are stored once and read for lengths, document frequencies and scores. Documents meet the queries in
    parts, each of which gives its best k for every query, so pairs of a query and a document are not shuffled.
    """
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        asked = keep(queries.select("query_id", F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("term")).distinct())
        terms = keep(asked.select("term").distinct().unionByName(spark.range(1).select(F.lit(WHOLE).alias("term"))).withColumn("code", F.monotonically_increasing_id()))
        used = keep(postings(docs, terms))
        whole = terms.filter(F.col("term") == WHOLE).select("code")
        size = used.join(F.broadcast(whole), "code").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).alias("avgdl")).withColumn("one", F.lit(1))
        df = used.groupBy("code").agg(F.count("*").alias("df"))
        stats = df.withColumn("one", F.lit(1)).join(F.broadcast(size), "one")  # one row
        idf = stats.select("code", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
        weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        weighed = used.join(keep(idf), "code").select("doc_id", "code", weight.alias("weight"))
        coded = keep(asked.join(terms, "term").select("query_id", "code"))  # joins are planned by its real size
        found = _best_sums(coded, weighed, k, coded.count(), used.count())
        return stored(top(found, k, F.desc("score"), F.asc("doc_id")))


def _best_sums(asked: DataFrame, weighed: DataFrame, k: int, n_asked: int, n_weighed: int) -> DataFrame:
    """asked(query_id, code), weighed(doc_id, code, weight over 0) -> query_id, doc_id, score: the sum of the common codes' weights to 6 places, the best k of each part.

    Queries are cut into blocks, documents into parts by hash; a posting goes to the blocks that ask for its code. A
    task holds one block and streams one part in order of doc_id, so of equal scores the earlier stays, as in the ranking.
    doc_id stands first in the sort, where most comparisons end; the block's queries have none and come before all.
    """
    n = shuffle_partitions(weighed.sparkSession)
    blocks = max(1, -(-n_asked // ASKED))
    parts = max(1, -(-n_weighed // PART), min(-(-n // blocks), -(-n_weighed // LEAST_PART)))  # few blocks: enough parts for all tasks
    spot = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    q = asked.withColumn("block", spot("query_id", blocks))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    slot = lambda part: (F.col("block") * parts + part).alias("slot")
    rows = q.select(F.explode(F.sequence(slot(0), slot(parts - 1))).alias("slot"), none(weighed, "doc_id"), F.lit(0).alias("kind"), "query_id", "code", F.lit(0.0).alias("weight"))
    met = weighed.join(q.select("block", "code").distinct(), "code")
    rows = rows.unionByName(met.select(slot(spot("doc_id", parts)), "doc_id", F.lit(1).alias("kind"), none(asked, "query_id"), "code", "weight"))
    rows = rows.repartitionById(blocks * parts, F.col("slot")).drop("slot").sortWithinPartitions("doc_id", "kind", "query_id", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for b in batches:
            asks = int(np.searchsorted(b.column(1).to_numpy(), 1))  # queries come first
            if asks:
                held.append((b.column(2).slice(0, asks), b.column(3).slice(0, asks).to_numpy()))
            if asks == b.num_rows:
                continue
            if block is None:
                block, held = _Block(pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held]), k), []
            block.meet(b.column(0).slice(asks), b.column(3).slice(asks).to_numpy(), b.column(4).slice(asks).to_numpy())
        if block:
            yield from block.out()

    schema = T.StructType().add("query_id", asked.schema["query_id"].dataType).add("doc_id", weighed.schema["doc_id"].dataType).add("score", "double")
    return rows.mapInArrow(run, schema)


class _Block:
    """The queries of a block, sorted, and their best k documents of a stream in order of doc_id."""

    def __init__(self, queries: pa.Array, codes: np.ndarray, k: int):
        runs = pc.run_end_encode(queries)
        self.ids, ends, self.k = runs.values, runs.run_ends.to_numpy(), k
        self.n = len(ends)
        order = np.argsort(codes, kind="stable")
        self.query = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))[order]
        self.codes, self.first, self.many = np.unique(codes[order], return_index=True, return_counts=True)
        self.bound, self.best = np.full(self.n, -1.0), (np.zeros(0, int), np.zeros(0), None)
        self.doc, self.sums = None, None  # the last document, whose postings may go on

    def meet(self, docs: pa.Array, codes: np.ndarray, weights: np.ndarray) -> None:
        """Postings of documents in order; what is worked on at once is bounded by cells (documents by queries) and by additions."""
        at = np.searchsorted(self.codes, codes)  # every code is asked for
        work = np.cumsum(self.many[at])
        runs = pc.run_end_encode(docs)
        number = np.repeat(np.arange(len(runs.run_ends)), np.diff(runs.run_ends.to_numpy(), prepend=0))
        s = 0
        while s < len(at):
            e = np.searchsorted(work, (work[s - 1] if s else 0) + CELLS, "right")
            e = max(s + 1, min(e, np.searchsorted(number, number[s] + max(1, CELLS // self.n))))
            self._add(runs.values.slice(number[s], number[e - 1] - number[s] + 1), number[s:e] - number[s], at[s:e], weights[s:e])
            s = e

    def _add(self, docs: pa.Array, number: np.ndarray, at: np.ndarray, weights: np.ndarray) -> None:
        many = self.many[at]
        start = np.cumsum(many) - many
        query = self.query[np.repeat(self.first[at] - start, many) + np.arange(many.sum())]
        sums = np.bincount(np.repeat(number, many) * self.n + query, np.repeat(weights, many), len(docs) * self.n).reshape(-1, self.n)
        if self.doc is not None:
            if self.doc.equals(docs.slice(0, 1)):
                sums[0] += self.sums
            else:
                self._rank(self.doc, self.sums[None])
        self._rank(docs.slice(0, len(docs) - 1), sums[:-1])
        self.doc, self.sums = docs.slice(len(docs) - 1), sums[-1].copy()

    def _rank(self, docs: pa.Array, sums: np.ndarray) -> None:
        scores = np.floor(sums * 1e6 + 0.5) / 1e6
        near = (sums > 0) & (scores > self.bound)
        if len(scores) > self.k:
            near &= scores >= np.partition(scores, len(scores) - self.k, 0)[len(scores) - self.k]
        doc, query = np.nonzero(near)
        if not len(doc):
            return
        old, had, ids = self.best
        ids = docs if ids is None else pa.concat_arrays([ids, docs])
        query, score, doc = np.concatenate([old, query]), np.concatenate([had, scores[doc, query]]), np.concatenate([np.arange(len(old)), len(ids) - len(docs) + doc])
        order = np.lexsort((doc, -score, query))
        row = query[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.bound[row[place == self.k - 1]] = score[order[place == self.k - 1]]
        kept = order[place < self.k]
        kept = kept[np.argsort(doc[kept], kind="stable")]
        self.best = query[kept], score[kept], ids.take(pa.array(doc[kept]))

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.doc is not None:
            self._rank(self.doc, self.sums[None])
        query, score, ids = self.best
        for s in range(0, len(query), 1 << 18):
            some = slice(s, s + (1 << 18))
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(query[some])), ids.slice(s, 1 << 18), pa.array(score[some])], ["query_id", "doc_id", "score"])


def top(hits: DataFrame, k: int, *order: F.Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """queries(query_id, vector), vectors(vec_id, vector) -> query_id, vec_id, distance, rank by exact L2, ties by vec_id."""
    return best(search(queries, vectors, l2, k), k)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """Two ranked lists (query_id, id, rank from 0; dense with distance) -> fused score and order; a hit of the
    second list alone has distance 0."""
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), "distance").join(sparse.select("query_id", "id", F.col("rank").alias("sparse_rank")), ["query_id", "id"], "full")
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c) + 1), F.lit(0.0))
    s = both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9)).withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return s.withColumn("position", F.row_number().over(w))


def recency_rerank(hits: DataFrame, half_life: float = 14.0) -> DataFrame:
    """hits(query_id, id, rank, distance, age_days) -> relevance, decay, combined, position."""
    rel = F.least(F.lit(1.0), 1 / (1 + F.greatest(F.lit(0.0), F.col("distance"))))
    decay = F.when(F.col("age_days").isNull(), 1.0).otherwise(F.pow(F.lit(0.5), F.col("age_days") / half_life))
    out = hits.withColumn("relevance", F.round(rel, 9)).withColumn("decay", F.round(decay, 9)).withColumn("combined", F.round(rel * decay, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("combined"), F.asc("rank"))
    return out.withColumn("position", F.row_number().over(w))


def energy_gate(queries: DataFrame, sims: DataFrame, t: float = 0.1, tau: float = -0.016, least_gap: float = 0.01, min_hits: int = 2, beta: float = 12.0) -> DataFrame:
    """queries(query_id), sims(query_id, sim) -> n, free_energy (-t logsumexp(sim/t)), separation of the best two, floor, admit.

    A query without sims has infinite energy and is not admitted. Sums are combined before the shuffle; the
    exponent is taken against 1, the largest cosine, so no list of sims is held.
    """
    g = sims.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.exp((F.col("sim") - 1) / t)).alias("total"), F.max("sim").alias("first"))
    second = sims.join(g.select("query_id", "first"), "query_id").groupBy("query_id").agg(F.max(F.when(F.col("sim") < F.col("first"), F.col("sim"))).alias("below"), F.count_if(F.col("sim") == F.col("first")).alias("tops"))
    x = queries.select("query_id").distinct().join(g, "query_id", "left").join(second, "query_id", "left").fillna(0, ["n"])
    x = x.withColumn("free_energy", F.when(F.col("n") == 0, float("inf")).otherwise(F.round(-(1 + t * F.log("total")), 6)))
    x = x.withColumn("separation", F.when((F.col("n") < 2) | (F.col("tops") > 1), 0.0).otherwise(F.round(F.col("first") - F.col("below"), 6)))
    floor = F.when(F.col("n") >= 2, F.round(F.log(2 * (F.col("n") - 1) * F.col("n") * beta) / beta, 6))
    admit = (F.col("n") >= min_hits) & (-F.col("free_energy") >= tau) & (F.col("n") >= 2) & (F.col("separation") >= least_gap)
    return x.select("query_id", "n", "free_energy", "separation", floor.alias("floor"), admit.alias("admit"))
