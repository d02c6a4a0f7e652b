"""Token counts by separator scan (operator 2).

A flat token file is a stream of 16-bit ids in which END closes each document; blocks cut it at a fixed
number of tokens, wherever documents end. It has no index. The scan searches each block for END with one
vectorised comparison. A document that crosses blocks is stitched by a prefix scan over the blocks of
its file: the running sum of block sizes gives where a block starts, the running maximum of the last END
before it gives where its first document starts.

Defined results: null and empty texts have no tokens and still close a document of length 0; tokens
after a file's last END form an open document; null or repeated doc_ids are documents of their own; an
empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, stored

END, BLOCK = 50256, 1 << 16


@lru_cache(maxsize=1)
def _encoder(name: str):  # noqa: ANN202
    import base64

    import public_tokenizers
    import tiktoken

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_stream(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text) -> file, block, tokens (little-endian 16-bit ids), closes (doc_ids that end in the block).

    Each partition of the input is one file. closes is the writer's roll call, for naming results; the
    scan finds documents by their separators alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, number = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        buffer, size = [], 0
        ends: list[tuple[int, int | None]] = []  # position in the buffer, doc_id

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            """Blocks of the buffer while it holds so many tokens; the rest stays."""
            nonlocal buffer, size, ends, number
            flat, at, done = np.concatenate(buffer), 0, 0
            while size - at >= least and at < size:
                to, k = min(at + block, size), done
                while done < len(ends) and ends[done][0] < to:
                    done += 1
                closed = [d for _, d in ends[k:done]]
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([flat[at:to].tobytes()], pa.binary()), pa.array([closed], pa.list_(pa.int64()))], ["file", "block", "tokens", "closes"])
                at, number = to, number + 1
            buffer, size = [flat[at:].copy()], size - at
            ends = [(p - at, d) for p, d in ends[done:]]

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = np.array([*enc.encode_ordinary(text), END], np.uint16)
                    buffer.append(ids)
                    size += len(ids)
                    ends.append((size - 1, doc_id))
                if size >= block:
                    yield from cut(block)
        if size:
            yield from cut(1)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file int, block long, tokens binary, closes array<long>")


def scan_separators(stream: DataFrame, end: int = END) -> DataFrame:
    """stream(file, block, tokens, closes) -> file, start, n_tokens, doc_id, closed; one row for each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(x, np.uint16) for x in b.column(2).to_pylist()]
            found = [np.flatnonzero(t == end) for t in tokens]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(found, pa.list_(pa.int64())), b.column(3)], ["file", "block", "n", "ends", "closes"])

    per = stream.select("file", "block", "tokens", "closes").mapInArrow(find, "file int, block long, n long, ends array<long>, closes array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = per.withColumn("after", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1) + 1))
    per = per.withColumn("open_from", F.coalesce(F.max("after").over(before), F.lit(0)))
    tail = per.groupBy("file").agg(F.sum("n").alias("size"), F.coalesce(F.max("after"), F.lit(0)).alias("start")).filter("size > start")
    docs = per.select("file", "start", "open_from", "ends", F.posexplode(F.arrays_zip("ends", "closes")).alias("k", "doc"))
    first = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("start") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    docs = docs.select("file", first.alias("at"), (F.col("start") + F.col("doc.ends") - first).alias("n_tokens"), F.col("doc.closes").alias("doc_id"), F.lit(True).alias("closed"))
    open_docs = tail.select("file", F.col("start").alias("at"), (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("closed"))
    return docs.unionByName(open_docs).withColumnRenamed("at", "start")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files that are written first."""
    with Scratch(spark) as keep:
        stream = keep(token_stream(read(spark, sf_dir, "documents")))
        return stored(scan_separators(stream).select("doc_id", "n_tokens", "closed"))
