"""Models that a caller supplies, as parameters of jobs: iterator functions over pandas batches, loaded once a task.

A model is a function from an iterator of Series (for scores: of pairs of Series) to an iterator of Series. Defaults need no weights:
hashed bags of words, their cosine, and first sentences; they are deterministic, for tests and as a floor to compare with.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.frames import Scratch, scratched
from graphloom.operators.graph import undirected
from graphloom.operators.retrieval import bm25_topk, rrf_fuse
from graphloom.operators.vectors import best, l2, search

Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
Scorer = Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.Series]]
_TOKEN = re.compile(r"[a-z0-9]+")
DIMENSIONS = 256


def _bag(text: str | None) -> np.ndarray:
    v = np.zeros(DIMENSIONS)
    for t in _TOKEN.findall((text or "").lower()):
        h = zlib.crc32(t.encode())
        v[h % DIMENSIONS] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def bag_of_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed hashed word counts of unit length; zero for a text without words."""
    for texts in batches:
        yield pd.Series([_bag(t).tolist() for t in texts])


def bag_overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Cosine of both texts' bags of words."""
    for a, b in batches:
        yield pd.Series([float(_bag(x) @ _bag(y)) for x, y in zip(a, b, strict=True)])


def first_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first sentence of each text of a list."""
    for lists in batches:
        yield pd.Series([" ".join(re.split(r"(?<=[.!?])\s", t.strip(), maxsplit=1)[0] for t in texts if t and t.strip()) if texts is not None else None for texts in lists])


def embed(text: Column, model: Embedder = bag_of_words) -> Column:
    """Vectors of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return F.pandas_udf(run, "array<double>")(text)


def cross_score(query: Column, text: Column, model: Scorer = bag_overlap) -> Column:
    """A score of each pair of texts."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from model(batches)

    return F.pandas_udf(run, "double")(query, text)


def summarise(texts: Column, model: Embedder = first_sentences) -> Column:
    """One text for a list of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from model(batches)

    return F.pandas_udf(run, "string")(texts)


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int, model: Embedder = bag_of_words, overfetch: int = 4) -> DataFrame:
    """queries(query_id, text), docs(id, text) -> query_id, id, score, distance, position: vectors and words searched, fused by rank."""
    v = docs.select(F.col("id").alias("vec_id"), embed(F.col("text"), model).alias("vector"))
    near = best(search(queries.select("query_id", embed(F.col("text"), model).alias("vector")), v, l2, overfetch * k), overfetch * k)
    dense = near.select("query_id", F.col("vec_id").alias("id"), (F.col("rank") - 1).alias("rank"), "distance")
    words = bm25_topk(queries, docs.select(F.col("id").alias("doc_id"), "text"), overfetch * k)
    sparse = words.select("query_id", F.col("doc_id").alias("id"), (F.col("rank") - 1).alias("rank"))
    return rrf_fuse(dense, sparse).filter(F.col("position") <= k).select("query_id", "id", "score", "distance", "position")


@scratched
def explore(queries: DataFrame, docs: DataFrame, edges: DataFrame, k: int = 3, depth: int = 3, model: Embedder = bag_of_words, *, keep: Scratch) -> DataFrame:
    """From text to a neighbourhood: query_id, id, hop of all nodes within depth undirected steps of the query's k hits.

    queries(query_id, text), docs(id, text) are the nodes, edges(source, target) between them; ends that are no nodes lead nowhere.
    """
    ids = keep(docs.select("id").distinct())
    both = keep(undirected(edges).filter("source <> target").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target"))
    seen = front = keep(hybrid_search(queries, docs, k, model).select("query_id", "id").withColumn("hop", F.lit(0)))
    for hop in range(1, depth + 1):
        step = front.select("query_id", F.col("id").alias("source")).join(both, "source").select("query_id", F.col("target").alias("id")).distinct()
        front = keep(step.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen
