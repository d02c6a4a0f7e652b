"""Periodic runs of words by a dictionary of basic factors (operator 13).

Words are the stretches between ASCII blanks. For each power-of-two length the dictionary names every
factor (stretch of so many words): equal names, equal words; names of twice the length come from pairs
of names. A factor that occurs once in its text is dropped, and with it every longer factor from there.
The next occurrence of a factor proposes a period. A run of period q is at least 3 q long, so with the
length L that has L/2 < q <= L the run's first factor and the next one q words on both lie inside it, and
no nearer occurrence exists, else the run had a smaller period (Fine and Wilf). So per length only gaps
over L/2 and up to L count, each period belongs to one length, and nothing is found twice. Equal gaps at
neighbouring places are the progression of one run: they begin at its first word, and the last of them
plus L plus q is its end, since the next factor holds the first word that differs from the one q before.

Many short texts are named together, each with words of its own; a text is never cut, and memory follows
the words of one text or BATCH words, whichever is more. It is a map over rows without a shuffle.

Defined results: null and empty texts and texts without words have no runs and the empty collapsed text;
doc_ids pass through, null or repeated; an empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import pick, read

#: Words that are named together; a longer text is on its own.
BATCH = 1 << 18
LEAST, REPEATS = 24, 3


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of texts one after the other, no number in two texts, and the texts' sizes -> text, start, length, period.

    Every run of length >= max(least, repeats * period), by text, start, period. repeats is 3 or more.
    """
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    stop = np.repeat(np.cumsum(sizes), sizes)
    size = np.repeat(sizes, sizes)
    at, name = np.flatnonzero(size >= max(least, repeats)), None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    full = np.full(len(words), -1, np.int64)
    name, long = words[at].astype(np.int64), 1
    while len(at):
        order = np.argsort(name, kind="stable")
        p, s = at[order], name[order]
        same = s[1:] == s[:-1]
        gap = np.where(same, p[1:] - p[:-1], 0)
        near = (2 * gap > long) & (gap <= long)
        i, d = p[:-1][near], gap[near]
        o = np.argsort(i)
        i, d = i[o], d[o]
        if len(i):
            first = np.append(True, (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1]))
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(i)) - 1
            length = i[end] - i[begin] + long + d[begin]
            big = length >= np.maximum(least, repeats * d[begin])
            found.append((i[begin][big], length[big], d[begin][big]))
        # names for twice the length: both halves occur more than once, and a period over `long` still fits the text
        again = np.append(same, False) | np.append(False, same)
        group = np.cumsum(np.append(0, ~same))
        live = p[again]
        full[live] = group[again]
        at = np.sort(live)
        two = (at + 2 * long <= stop[at]) & (repeats * (long + 1) <= size[at])
        at = at[two]
        other = full[at + long]
        at, other = at[other >= 0], other[other >= 0]
        name = full[at] * (len(words) + 1) + other
        full[live] = -1
        long *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((period, start))
    start, length, period = start[o], length[o], period[o]
    offsets = np.cumsum(sizes)
    text = np.searchsorted(offsets, start, "right")
    return text, start - (offsets - sizes)[text], length, period


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Word numbers of texts one after the other; no two texts share one."""
    out, first = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        out.extend(known.setdefault(w, first + len(known)) for w in words)
        first += len(known)
    return np.array(out, np.int64)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _together(texts: Iterator[tuple[object, bytes]]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, some, n = [], [], 0
    for doc_id, text in texts:
        words = text.split()
        if some and n + len(words) > BATCH:
            yield ids, some
            ids, some, n = [], [], 0
        ids.append(doc_id), some.append(words)
        n += len(words)
        if len(some) >= 4096:
            yield ids, some
            ids, some, n = [], [], 0
    if some:
        yield ids, some


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    for b in batches:
        text = b.column(1).cast(pa.large_binary())
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), text[k].as_py() or b""


def collapse_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs array<struct<start, length, period>>, collapsed text.

    runs: by start, then period. collapsed: the words that no run contains after its first `period` words,
    joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in _together(_each(batches)):
            sizes = np.array([len(w) for w in some], np.int64)
            text, start, length, period = find_runs(numbered(some), sizes, least, repeats)
            cuts = np.searchsorted(text, np.arange(len(some) + 1))
            kept = []
            for k, words in enumerate(some):
                lo, hi = cuts[k], cuts[k + 1]
                if lo < hi:
                    level = np.zeros(len(words) + 1, np.int64)
                    np.add.at(level, start[lo:hi] + period[lo:hi], 1)
                    np.add.at(level, start[lo:hi] + length[lo:hi], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(level[:-1]) == 0)]
                kept.append(b" ".join(words))
            items = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items).cast(_RUNS)
            collapsed = pc.cast(pa.array(kept, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the same, every tenth text (by the checksum of its doc_id) with a periodic tail.

    With h = crc32 of the decimal doc_id, g = h // 10 and n words, where h % 10 = 0 and n > 0: from word a = g % n
    on, words repeat with period 1 + (n - a) // (3 + g % 8). Other texts, and those of null doc_ids, stay.
    """

    def tail(doc_id: int | None, text: str | None) -> str | None:
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not text or not (words := text.encode().split()):
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [tail(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per planted text: its number of runs, the run of the greatest length / period, digests of runs and collapsed text."""
    found = collapse_runs(plant(read(spark, sf_dir, "documents")))
    # the greater exponent by exact products; ties to the smaller start, then period
    better = "r.length * b.period > b.length * r.period or (r.length * b.period = b.length * r.period and (r.start, r.period) < (b.start, b.period))"
    best = F.expr(f"aggregate(runs, element_at(runs, 1), (b, r) -> if({better}, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
