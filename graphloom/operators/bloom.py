"""Bloom filters as tables: built inside tasks, merged by OR, probed by a join.

A filter is rows (filter, m, k, word, bits): m bits, k indexes a value, and its 64-bit words that are not
zero. Bit i of the filter is bit i % 64 of word i / 64, so the words in order, little-endian, are the byte array
of the exchange format. Each distinct value of a filter is hashed once; tasks send the words that their values touch, sorted out of
batches of bounded size, and bit_or() merges them before and after the shuffle: a task's work follows its values, however
many filters there are and however large one is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The hash and its two seeds, and the bounds of a filter's shape.
FNV_PRIME, SEEDS = 0x01000193, (0x811C9DC5, 0xDEADBEEF)
LEAST_BITS, MOST_BITS, MOST_HASHES = 8, 1 << 26, 32
#: Bytes that a task works on at once, before it sends words on; it holds a quarter of them as bit numbers.
HELD = 1 << 26


def optimal_params(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits (whole bytes, at most MOST_BITS) and hashes for n values at a false-positive rate p."""
    n, p = max(1, n), p if 0 < p < 1 else 0.01
    m = min(MOST_BITS, max(LEAST_BITS, math.ceil(-n * math.log(p) / math.log(2) ** 2 / 8) * 8))
    return m, max(1, min(MOST_HASHES, math.floor(m / n * math.log(2) + 0.5)))


def check_shape(m: int, k: int) -> None:
    if not LEAST_BITS <= m <= MOST_BITS or not 1 <= k <= MOST_HASHES:
        raise ValueError(f"a filter has {LEAST_BITS} to {MOST_BITS} bits and 1 to {MOST_HASHES} hashes, not {m} and {k}")


def fnv_indexes(values: pa.Array, m: int, k: int) -> np.ndarray:
    """Strings -> rows of k bit numbers: both 32-bit FNV-1a hashes of the UTF-8 bytes, then h1 + i h2 (mod 2^32) mod m."""
    data = values.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    order = np.argsort(-np.diff(offsets), kind="stable")
    starts, sizes = offsets[:-1][order], np.diff(offsets)[order]
    h = np.repeat(np.array(SEEDS, np.uint32)[:, None], len(order), 1)
    live, at, less = int(np.count_nonzero(sizes)), 0, -sizes
    while live:  # one byte of all values that are long enough at a time
        h[:, :live] = (h[:, :live] ^ raw[starts[:live] + at]) * np.uint32(FNV_PRIME)
        at += 1
        live = int(np.searchsorted(less, -at, "left"))
    both = np.empty_like(h)
    both[:, order] = h
    steps = np.arange(k, dtype=np.uint32)
    return ((both[0][:, None] + steps * both[1][:, None]) % np.uint32(m)).astype(np.int64)


_WORDS = "filter string, word int, bits long"


def bloom_build(values: DataFrame, m: int, k: int) -> DataFrame:
    """values(filter, value) -> the filters' words. Null values are left out; a null filter is one of its own."""
    check_shape(m, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array | np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            """The words of what is held: sorted by filter and bit, so that its size follows the values and not m."""
            if held:
                names = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
                code = np.repeat(names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), k)
                spot = np.unique(code * (m + 64) + np.concatenate([h[1] for h in held]))
                code, bit = spot // (m + 64), spot % (m + 64)
                word, one = bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64)
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (word[1:] != word[:-1])))
                named = pa.concat_arrays([names.dictionary, pa.array([None], names.dictionary.type)]).take(pa.array(code[first]))
                yield pa.RecordBatch.from_arrays([named, pa.array(word[first].astype(np.int32)), pa.array(np.bitwise_or.reduceat(one, first).view(np.int64))], ["filter", "word", "bits"])
            held.clear()

        for b in batches:
            if b.num_rows:
                held.append([b.column(0), fnv_indexes(b.column(1), m, k).ravel()])
            if sum(h[1].nbytes for h in held) >= HELD // 4:
                yield from out()
        yield from out()

    rows = values.select(F.col("filter").cast("string").alias("filter"), F.col("value").cast("string").alias("value")).filter("value is not null").distinct()
    merged = rows.mapInArrow(run, _WORDS).groupBy("filter", "word").agg(F.bit_or("bits").alias("bits"))
    return merged.select("filter", F.lit(m).alias("m"), F.lit(k).alias("k"), "word", "bits")


def bloom_union(*filters: DataFrame) -> DataFrame:
    """Filters of the same name united; a name with two shapes is an error."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    odd = every.groupBy("filter").agg(F.count_distinct("m", "k").alias("n")).filter("n > 1").first()
    if odd is not None:
        raise ValueError(f"filters of different shape cannot be united: {odd['filter']}")
    return every.groupBy("filter", "m", "k", "word").agg(F.bit_or("bits").alias("bits"))


def bloom_probe(filters: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    """probes(filter, value) -> each distinct one with `maybe`: false is certain, true is wrong at the filter's rate.

    A value asks for its bits, those of one word together; only words asked for meet. A missing filter is empty.
    """
    check_shape(m, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = fnv_indexes(b.column(1), m, k)
            row = np.repeat(np.arange(b.num_rows), k)
            word, bit = (index >> 6).ravel(), np.uint64(1) << (index & 63).ravel().astype(np.uint64)
            o = np.lexsort((word, row))
            row, word, bit = row[o], word[o], bit[o]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1]))) if len(row) else np.zeros(0, int)
            asked = np.bitwise_or.reduceat(bit, first) if len(row) else bit
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(word[first].astype(np.int32)), pa.array(asked.view(np.int64))], ["filter", "value", "word", "asked"])

    p = probes.select(F.col("filter").cast("string").alias("filter"), F.col("value").cast("string").alias("value")).filter("value is not null").distinct()
    asked = p.mapInArrow(run, "filter string, value string, word int, asked long")
    have = filters.filter((F.col("m") == m) & (F.col("k") == k)).select(F.col("filter").alias("of"), F.col("word").alias("at"), "bits")
    met = asked.join(have, F.col("filter").eqNullSafe(F.col("of")) & (F.col("word") == F.col("at")), "left")
    held = F.coalesce(F.col("bits").bitwiseAND(F.col("asked")) == F.col("asked"), F.lit(False))
    return met.groupBy("filter", "value").agg(F.bool_and(held).alias("maybe"))


def bloom_estimate(filters: DataFrame) -> DataFrame:
    """Per filter its set bits, their share and the estimated number of distinct values (infinite for a full one)."""
    g = filters.groupBy("filter", "m", "k").agg(F.sum(F.bit_count("bits")).cast("long").alias("set_bits"))
    fill = F.col("set_bits") / F.col("m")
    n = F.when(F.col("set_bits") == F.col("m"), float("inf")).otherwise(-F.col("m") / F.col("k") * F.log(1 - fill))
    return g.select("filter", "m", "k", "set_bits", F.round(fill, 9).alias("fill"), F.round(n, 6).alias("estimate"))


def bloom_bytes(filters: DataFrame) -> DataFrame:
    """filter, m, k, bytes: the filters as byte arrays of m / 8 bytes, rounded up (at most 8 MB each)."""

    def one(t: pa.Table) -> pa.Table:
        m = t.column("m")[0].as_py()
        words = np.zeros(-(-m // 64), np.int64)
        words[t.column("word").to_numpy()] = t.column("bits").to_numpy()
        return pa.table({"filter": t.column("filter").slice(0, 1), "m": t.column("m").slice(0, 1), "k": t.column("k").slice(0, 1), "bytes": pa.array([words.tobytes()[: -(-m // 8)]], pa.binary())})

    return filters.groupBy("filter", "m", "k").applyInArrow(one, "filter string, m int, k int, bytes binary")
