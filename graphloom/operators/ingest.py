"""Items to chunks, nodes and edges, and what an ingest run did."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import content_sha256

#: From coarse to fine; a piece keeps the separator it ends with.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def _pieces(text: str, most: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """The text cut at the first separator it holds, pieces still too long at the finer ones, else at `most`."""
    if len(text) <= most:
        yield text
        return
    for i, s in enumerate(separators):
        if s in text[: -len(s)]:
            for p in filter(None, re.split(f"(?<={re.escape(s)})", text)):
                yield from _pieces(p, most, separators[i + 1 :])
            return
    for at in range(0, len(text), most):
        yield text[at : at + most]


def chunk_text(text: str | None, most: int = 1200, overlap: int = 100, least: int = 80) -> list[tuple[int, str]]:
    """(offset, text) of each chunk. The next chunk starts with the last words of the one before; a short rest joins it."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text or ""))).strip()
    out: list[tuple[int, str]] = []
    held, start, at = "", 0, 0
    for p in _pieces(text, most) if text else ():
        if held and len(held) + len(p) > most:
            out.append((start, held))
            if len(held) > overlap:
                held = held[len(held) - overlap :].split(" ", 1)[-1] if overlap else ""
            start = at - len(held)
        start = start if held else at
        held += p
        at += len(p)
    if held and (len(held) >= least or not out):
        out.append((start, held))
    elif held:
        out[-1] = out[-1][0], out[-1][1] + held
    return out


def chunks(items: DataFrame, most: int = 1200, overlap: int = 100, least: int = 80) -> DataFrame:
    """items(source_uri, title, text) -> source_uri, title, chunk_index, n_chunks, offset, text; a map over rows.

    A null or empty text has no chunks. Lengths count code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for uri, title, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    made = chunk_text(text, most, overlap, least)
                    rows += [(uri, title, i, len(made), *c) for i, c in enumerate(made)]
                kinds = [part.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["source_uri", "title", "chunk_index", "n_chunks", "offset", "text"])

    d = items.select("source_uri", F.col("title").cast("string").alias("title"), "text")
    return d.mapInArrow(run, f"source_uri {d.schema['source_uri'].dataType.simpleString()}, title string, chunk_index int, n_chunks int, offset long, text string")


def chunk_nodes(chunked: DataFrame, summary: int = 1500) -> DataFrame:
    """Chunks -> id, label, source_uri, chunk_index, summary: one chunk keeps the item's names, several are numbered."""
    uri, several = F.col("source_uri").cast("string"), F.col("n_chunks") > 1
    ident = F.when(several, F.concat(uri, F.lit("#chunk-"), F.col("chunk_index"))).otherwise(uri)
    label = F.when(several, F.concat("title", F.lit(" [chunk "), F.col("chunk_index") + 1, F.lit("/"), F.col("n_chunks"), F.lit("]"))).otherwise(F.col("title"))
    return chunked.select(ident.alias("id"), label.alias("label"), "source_uri", "chunk_index", F.substring("text", 1, summary).alias("summary"))


def next_edges(nodes: DataFrame) -> DataFrame:
    """Chunk nodes -> an edge from each chunk to the next of its item."""
    w = Window.partitionBy("source_uri").orderBy("chunk_index")
    return nodes.select(F.col("id").alias("source"), F.lead("id").over(w).alias("target"), F.lit("next_chunk").alias("relation")).filter("target is not null")


def classify(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """items(source_id, source_uri, text), nodes(source_uri, id, digest) -> items with status new, updated or skipped.

    An item is known by its address or by its first chunk; the same digest, or nothing to chunk, is skipped.
    """
    old = nodes.select(F.col("id").alias("known"), F.col("digest").alias("old")).dropDuplicates(["known"])
    first = nodes.select(F.col("id").alias("known"), F.col("digest").alias("old_chunk")).dropDuplicates(["known"])
    x = items.withColumn("digest", content_sha256(F.col("text"))).withColumn("known", F.col("source_uri"))
    x = x.join(old, "known", "left").withColumn("known", F.concat("source_uri", F.lit("#chunk-0"))).join(first, "known", "left").drop("known")
    x = x.withColumn("old", F.coalesce("old", "old_chunk")).drop("old_chunk")
    empty = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    return x.withColumn("status", F.when(empty | F.coalesce(F.col("old") == F.col("digest"), F.lit(False)), "skipped").when(F.col("old").isNotNull(), "updated").otherwise("new"))


def run_report(classified: DataFrame) -> DataFrame:
    """Items seen, new, updated and skipped of each source."""
    n = lambda s: F.count_if(F.col("status") == s)
    return classified.groupBy("source_id").agg(F.count("*").alias("items_seen"), n("new").alias("items_new"), n("updated").alias("items_updated"), n("skipped").alias("items_skipped"))
