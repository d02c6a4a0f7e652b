"""MinHash near-duplicates with an LSH forest (operator 10).

Each whole text becomes its set of word shingles and a signature of HASHES minimum hashes. Equal
sets are merged first. The forest is TREES sort orders of the signatures: order t starts at hash
t * STEP and wraps around. In each order a document's candidates are its neighbours by longest common
prefix: a region is a run of documents that agree on at least MIN_DEPTH leading hashes, and since
the order goes on through the whole signature, a crowded region is sorted ever deeper and a
document meets the WINDOW next ones, those with the longest common prefixes. Orders are range
partitioned by the prefix itself, so a crowded region is spread over partitions.

Candidates of the forest whose sketches are not similar are dropped (one byte for each hash; the bound
lies seven standard deviations below the threshold). A small region that a partition boundary cuts is
joined again from the ends of the partitions. Links are confirmed on full sets, in rounds: in each of the
first BEST_ROUNDS every document checks its best candidate outside its own component; what still runs
between different components is confirmed next, until nothing is left. So a group of thousands of near
copies costs a few checks for each document, not one for each pair.

What a window leaves out inside a crowded region is then caught up exactly: documents outside the
region's largest component are compared with all documents of other components in the region. First by
sizes and by BUCKETS counts of each set's shingles, whose minima bound the intersection from above, so
that only a pair that cannot reach the similarity is ruled out (never by sketches); a row of that step is
some 300 bytes. Only documents with a partner left send their texts, for confirmation on full sets inside
blocks of bounded size. The comparisons of a crowd still grow with its size times its documents outside
the largest component; what is shipped is one row for each of these and block of COUNT_BLOCK documents.

A link at similarity 0.8 agrees on two given hashes with probability 0.64; 16 orders miss it with
probability 8e-8. By the binomial its sketches agree in fewer than 29 of 64 hashes, and the forest drops
it, with probability 1.8e-10.

Defined results: null and empty texts and texts without words have an empty set, 0 shingles and
link with nothing; fewer words than a shingle give one shingle, the whole sequence; rows that repeat
a doc_id are rows of their own, which name the same id; a null doc_id takes part, and a component
whose ids are all null has a null id; extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.components import components
from graphloom.frames import Scratch, pick, read, scratched, shuffle_partitions, stored

HASHES, TREES, STEP, MIN_DEPTH, WINDOW, BEST_ROUNDS = 64, 16, 4, 2, 4, 3
#: Documents of a crowded region, and shingles of them all, that one block of the catching-up holds.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Counts that bound an intersection, and how many documents' counts one block holds.
BUCKETS, COUNT_BLOCK = 256, 1 << 15
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    bytes.lower() changes A-Z alone, bytes.split() splits at 0x20 and 0x09 to 0x0D.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    word_hash = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mixed(acc * _M + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def signature(items: np.ndarray) -> np.ndarray:
    """HASHES minima of multiplicative hashes, 32 bits each."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(items), 16384):
        part = items[at : at + 16384]
        for i in range(HASHES):
            out[i] = min(out[i], int((part * factors[i]).min() >> np.uint64(32)))
    return out


def bucket_counts(items: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of BUCKETS parts of the hash range; all 255 (no bound) where one exceeds 254."""
    n = np.bincount((items >> np.uint64(56)).astype(np.intp), minlength=BUCKETS)
    return np.full(BUCKETS, 255, np.uint8) if n.max() > 254 else n.astype(np.uint8)


def can_link(sizes: np.ndarray, counts: np.ndarray, size: int, count: np.ndarray, percent: int) -> np.ndarray:
    """Rows that sizes and bucket counts do not rule out as links of a set with this size and these counts."""
    both = np.minimum(counts, count).sum(1, dtype=np.int64)
    both = np.where((counts[:, 0] == 255) | (count[0] == 255), sizes + size, both)
    both = np.minimum(both, np.minimum(sizes, size))
    return 100 * both >= percent * (sizes + size - both)


_FEATURES = "doc_id long, th long, n_shingles long, node long, sig binary, counts binary"


def set_features(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th (hash of the text), n_shingles, node (hash of the set), sig, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sizes, nodes, sigs, counts = [], [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    s = shingles(text, width)
                    sizes.append(len(s))
                    nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                    sigs.append(signature(s).tobytes() if len(s) else None)
                    counts.append(bucket_counts(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "th", "n_shingles", "node", "sig", "counts"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, _FEATURES)


def least_alike(threshold: float) -> float:
    """Share of equal signature hashes, seven standard deviations below the threshold."""
    return threshold - 7 * (threshold * (1 - threshold) / HASHES) ** 0.5


def forest_pairs(nodes: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """nodes(node, n_shingles, sig) -> candidate pairs (a, b, alike), a < b, each once."""
    least = least_alike(threshold)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
                for t in range(TREES):
                    turned = np.roll(sig, -t * STEP, 1)
                    lead = [x.tobytes() for x in turned[:, :STEP].astype(">u4")]
                    sketch = [x.tobytes() for x in (turned & 255).astype(np.uint8)]
                    prefix = [bytes([t]) + x + y[STEP:] for x, y in zip(lead, sketch, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prefix, pa.binary()), pa.array([y[:STEP] for y in sketch], pa.binary())], ["node", "n_shingles", "prefix", "head"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = 1 + 4 * MIN_DEPTH
        carry = first = None

        def end(ids: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
            """Rows of the region of the first row given, unless it is crowded or goes on beyond these rows."""
            run = int((lead == lead[0]).all(1).sum())
            run = run if run <= WINDOW else 0
            none = pa.nulls(run)
            return pa.RecordBatch.from_arrays([pa.array(ids[:run]), none.cast(pa.int64()), none.cast(pa.float64()), pa.array(sizes[:run]), pa.array([x.tobytes() for x in lead[:run]], pa.binary())], names)

        names = ["a", "b", "alike", "size", "region"]
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            head = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, STEP)
            now = b.column(0).to_numpy(), b.column(1).to_numpy(), raw[:, :depth], np.hstack((head, raw[:, 1 + 4 * STEP :]))
            fresh = 0 if carry is None else min(WINDOW, len(carry[0]))
            ids, sizes, lead, sketch = now if carry is None else tuple(np.concatenate((x[-WINDOW:], y)) for x, y in zip(carry, now, strict=True))
            for k in range(1, WINDOW + 1):
                two = np.arange(max(fresh, k), len(ids))
                one = two - k
                near = (lead[one] == lead[two]).all(1)
                if not near.any():
                    break
                one, two = one[near], two[near]
                same = (sketch[one] == sketch[two]).mean(1)
                small, large = np.minimum(sizes[one], sizes[two]), np.maximum(sizes[one], sizes[two])
                ok = (same >= least) & (small >= threshold * large - 1e-9) & (ids[one] != ids[two])
                one, two, same = one[ok], two[ok], same[ok]
                if len(one):
                    none = pa.nulls(len(one))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[one], ids[two])), pa.array(np.maximum(ids[one], ids[two])), pa.array(same), none.cast(pa.int64()), none.cast(pa.binary())], names)
            carry = tuple(x[-WINDOW - 1 :] for x in (now if carry is None else tuple(np.concatenate((x, y)) for x, y in zip(carry, now, strict=True))))
            if first is None or len(first[0]) <= WINDOW:
                first = tuple(x[: WINDOW + 1].copy() for x in (now[:3] if first is None else tuple(np.concatenate((x, y)) for x, y in zip(first, now[:3], strict=True))))
        if carry is not None:
            yield end(*first)
            yield end(*[x[::-1] for x in carry[:3]])

    n = shuffle_partitions(nodes.sparkSession)
    laid = nodes.select("node", "n_shingles", "sig").mapInArrow(orders, "node long, n_shingles long, prefix binary, head binary")
    laid = laid.repartitionByRange(n, "prefix", "node").sortWithinPartitions("prefix", "node")
    found = keep(laid.mapInArrow(neighbours, "a long, b long, alike double, size long, region binary"))
    # a region that a boundary cuts: at most WINDOW rows on each side, two sides a partition
    ends = found.filter("b is null").select("region", "a", "size").distinct()
    other = ends.select("region", F.col("a").alias("b"), F.col("size").alias("size_b"))
    cut = ends.join(other, "region").filter((F.col("a") < F.col("b")) & (F.least("size", "size_b") >= threshold * F.greatest("size", "size_b") - 1e-9))
    pairs = found.filter("b is not null").select("a", "b", "alike").unionByName(cut.select("a", "b", F.lit(0.0).alias("alike")))
    return keep(pairs.groupBy("a", "b").agg(F.max("alike").alias("alike")))


def _dealt(met: DataFrame, parts: DataFrame, n: int, *columns: str) -> DataFrame:
    """met(top, node, asks, ...), parts(top, parts) -> a row in its own part; those that ask also in every part, after the others."""
    own = "array(struct(cast(pmod(xxhash64(node), parts) as int) as part, false as asks))"
    every = "transform(sequence(0, parts - 1), p -> struct(p as part, true as asks))"
    at = F.explode(F.expr(f"if(asks, concat({own}, {every}), {own})")).alias("at")
    work = met.join(parts, "top").select("top", at, "node", *columns).select("top", "at.*", "node", *columns)
    return work.repartition(n, "top", "part").sortWithinPartitions("top", "part", "asks", "node")


@scratched
def crowded_links(nodes: DataFrame, comps: DataFrame, source: DataFrame, width: int, percent: int, *, keep: Scratch) -> DataFrame:
    """Links (a, b) between different components that share a region too large for the window.

    Each document outside the largest component of its region meets all documents of the region; regions
    with the same largest component are taken together. Who can have a link is found from sizes and bucket
    counts, in blocks of COUNT_BLOCK rows; only those documents send their texts, to blocks of bounded rows
    and shingles that hold full sets, so a pair is confirmed where it is found and only links leave the
    block, at most one for each document and component.
    """
    spark = nodes.sparkSession
    n = shuffle_partitions(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
                for t in range(TREES):
                    key = _mixed(_mixed((sig[:, t * STEP] << np.uint64(32) | sig[:, t * STEP + 1]) + np.uint64(t)) + _M).view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key)], ["node", "region"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts = [bucket_counts(shingles(x, width)).tobytes() for x in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.binary())], ["id", "th", "counts"])

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(top, part, asks, node, comp, n_shingles, counts), sorted -> top and node of all that can have a link here."""
        place, held, block = None, [], None

        def left() -> pa.RecordBatch:
            ids = np.unique(np.concatenate((block[0][block[4]], np.array(asked, np.int64)))) if block else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), place[0] if place else 0, np.int64)), pa.array(ids)], ["top", "node"])

        asked: list[int] = []
        for b in batches:
            if not b.num_rows:
                continue
            top, part, asks, ids, comp, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            counts = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, BUCKETS)
            for i in range(b.num_rows):
                if (top[i], part[i]) != place:
                    yield left()
                    place, held, block, asked = (top[i], part[i]), [], None, []
                if not asks[i]:
                    held.append((ids[i], comp[i], size[i], counts[i]))
                    continue
                if not held:
                    continue
                if block is None:
                    held.sort(key=lambda x: x[2])  # by size, so that the sizes that fit are neighbours
                    block = (*(np.array([x[k] for x in held]) for k in range(4)), np.zeros(len(held), bool))
                ids_, comp_, size_, counts_, able_ = block
                lo, hi = np.searchsorted(size_, [size[i] * percent / 100 - 1e-6, size[i] * 100 / percent + 1e-6])
                y = lo + np.flatnonzero(can_link(size_[lo:hi], counts_[lo:hi], size[i], counts[i], percent) & (comp_[lo:hi] != comp[i]))
                if len(y):
                    able_[y] = True
                    asked.append(ids[i])
        yield left()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(top, part, asks, node, comp, text), sorted -> links."""
        place, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            top, part, asks, ids, comp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            texts = b.column(5).cast(pa.binary())
            found_a, found_b = [], []
            for i in range(b.num_rows):
                if (top[i], part[i]) != place:
                    place, held, block = (top[i], part[i]), [], None
                items = shingles(texts[i].as_py(), width)
                if not asks[i]:
                    held.append((ids[i], comp[i], len(items), bucket_counts(items), items))
                    continue
                if not held:
                    continue
                if block is None:
                    ids_, comp_, sizes, counts = (np.array([x[c] for x in held]) for c in range(4))
                    words, at = np.unique(np.concatenate([x[4] for x in held]), return_inverse=True)
                    held = [None]
                    block = ids_, comp_, sizes, counts, words, np.split(at.astype(np.int32), np.cumsum(sizes)[:-1]), np.zeros(len(words), np.int32)
                ids_, comp_, sizes, counts, words, at, mark = block
                y = np.flatnonzero(can_link(sizes, counts, len(items), bucket_counts(items), percent) & (comp_ != comp[i]))
                if not len(y):
                    continue
                spot = np.minimum(np.searchsorted(words, items), len(words) - 1)
                spot = spot[words[spot] == items]
                mark[spot] = 1
                both = np.add.reduceat(mark[np.concatenate([at[k] for k in y])], np.append(0, np.cumsum(sizes[y])[:-1]))
                mark[spot] = 0
                y = y[100 * both >= percent * (sizes[y] + len(items) - both)]
                for k in y[np.unique(comp_[y], return_index=True)[1]]:
                    found_a.append(min(ids_[k], ids[i]))
                    found_b.append(max(ids_[k], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    regions = nodes.select("node", "sig").mapInArrow(keyed, "node long, region long")
    crowded = regions.groupBy("region").agg(F.count("*").alias("m")).filter(F.col("m") > WINDOW + 1)
    rows = keep(regions.join(crowded, "region").join(comps, "node", "left").select("region", "node", F.coalesce("component", "node").alias("comp")))
    tops = rows.groupBy("region", "comp").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    met = keep(rows.join(tops.filter("comps > 1"), "region").select("top", "node", "comp", (F.col("comp") != F.col("top")).alias("asks")).distinct())
    known = nodes.select("node", "n_shingles", F.col("stands.id").alias("id"), F.col("stands.th").alias("th"), *(["counts"] if "counts" in nodes.columns else []))
    if "counts" not in nodes.columns:
        known = known.join(source.select("id", "th", "text").mapInArrow(counted, "id long, th long, counts binary").dropDuplicates(["id", "th"]), ["id", "th"])
    parts = met.groupBy("top").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("parts"))
    work = _dealt(met.join(known.select("node", "n_shingles", "counts"), "node"), parts, n, "comp", "n_shingles", "counts")
    live = keep(work.mapInArrow(able, "top long, node long").distinct())
    live = keep(live.join(met, ["top", "node"]).join(known.select("node", "n_shingles", "id", "th"), "node"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    # a document is in one region of each tree, so the list stays short
    spots = live.groupBy("id", "th", "node", "comp").agg(F.collect_list(F.struct("top", "asks")).alias("spots"))
    texts = source.join(spots, ["id", "th"]).dropDuplicates(["id", "th"])
    full = texts.select("node", "comp", "text", F.explode("spots").alias("s")).select("s.top", "node", "s.asks", "comp", "text")
    links = _dealt(full, live.groupBy("top").agg(parts), n, "comp", "text").mapInArrow(compared, "a long, b long").distinct()
    return keep(links)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, b), texts(node, text) -> the pairs whose full sets reach the similarity."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            ids_a, ids_b = b.column(0).to_pylist(), b.column(1).to_pylist()
            keep = []
            for at in range(0, b.num_rows, 256):
                texts_a = b.column(2).slice(at, 256).cast(pa.binary()).to_pylist()
                texts_b = b.column(3).slice(at, 256).cast(pa.binary()).to_pylist()
                for i, (x, y) in enumerate(zip(texts_a, texts_b, strict=True), at):
                    if ids_b[i] != last:
                        last, held = ids_b[i], shingles(y, width)
                    s = shingles(x, width)
                    both = len(np.intersect1d(s, held, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(held) - both):
                        keep.append((ids_a[i], ids_b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.int64())], ["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keyed: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs.

    component_id is the smallest doc_id reachable over links of 100 * intersection >= percent * union.
    keyed adds th, the hash of the text, and component, which names the component whatever its doc_ids
    are (null for an empty set).
    """
    with Scratch(docs.sparkSession) as keep:
        features = keep(set_features(docs, width))
        # one document stands for all with its set; the one with the smallest (doc_id, text hash)
        stands = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "th")
        nodes = features.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(stands).alias("stands"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("counts").alias("counts"))
        nodes = keep(nodes)
        pairs = forest_pairs(nodes, percent / 100, keep)
        source = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), "text")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = nodes.join(wanted, "node", "left_semi").select("node", F.col("stands.id").alias("id"), F.col("stands.th").alias("th"))
        texts = keep(source.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "text"))
        links, turn = pairs.select("a", "b").limit(0), 0
        while True:  # until no pair is left between the components of the links confirmed so far
            comps = components(links, keep=keep)
            at = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))  # noqa: E731, B023
            apart = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b"))
            pairs = keep(apart.select("a", "b", "alike"))
            if pairs.isEmpty():
                break
            ask = pairs.select("a", "b")
            if turn < BEST_ROUNDS:
                ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "alike")
                ask = keep(ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
            links = keep(links.unionByName(confirm(ask, texts, width, percent)))
            pairs = pairs.join(ask, ["a", "b"], "left_anti")
            turn += 1
        caught = crowded_links(nodes, comps, source, width, percent, keep=keep)
        if not caught.isEmpty():
            comps = components(links.unionByName(caught), keep=keep)
        placed = keep(nodes.select("node", "least").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")))
        ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
        by_node = placed.join(ids, "component").select(F.col("node").alias("of"), "component_id", "component")
        out = features.select("doc_id", "n_shingles", "node", "th").join(by_node, F.col("node") == F.col("of"), "left")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        kept = F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
        return stored(out.select("doc_id", "n_shingles", component.alias("component_id"), kept, *(["th", "component"] if keyed else [])))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles of all documents, links at 0.8: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)
