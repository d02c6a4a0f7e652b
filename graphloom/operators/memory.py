"""Memory upkeep and answer decisions: gates, forgetting, contradictions, clusters, contracts, receipts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.frames import Scratch, scratched, shuffle_partitions
from graphloom.operators.clusters import greedy_clusters  # noqa: F401  the step between candidates and memories
from graphloom.operators.telemetry import retention, retention_band

#: Sets whose parts are made in common, sets of one label that are compared in a block, and the bytes of a token.
COMMON, BLOCK, WORD = 1 << 10, 512, np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))


def decide_contract(score: Column, risk: Column, observed_parts: Column | None = None, energy_admit: Column | None = None) -> Column:
    """What to do with an answer: use_memory, verify_one_source, search or ask_user.

    From .85 on (or admitted by energy) memory is used, but with fewer than four observed parts verified; risk lowers the verdict.
    """
    use = score >= 0.85 if energy_admit is None else (score >= 0.85) | F.coalesce(energy_admit, F.lit(False))
    shallow = F.lit(False) if observed_parts is None else observed_parts < 4
    base = F.when(use & ~shallow, "use_memory").when(use | (score >= 0.65), "verify_one_source").when(score >= 0.4, "search").otherwise("ask_user")
    risky = F.when((risk == "elevated") & (base == "use_memory"), "verify_one_source").when((risk == "high") & base.isin("use_memory", "verify_one_source"), "search")
    return F.coalesce(risky, base)


def reweight(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the parts that are observed, the plain mean where weights sum to nothing, 0 without any."""
    seen = [(p, F.coalesce(c, F.lit(0.0)), F.when(c.isNotNull(), 1.0).otherwise(0.0)) for p, c in parts.items()]
    add = lambda xs: sum(xs, F.lit(0.0))
    w, n = add([F.lit(float(weights.get(p, 0.0))) * s for p, _, s in seen]), add([s for _, _, s in seen])
    weighted, plain = add([F.lit(float(weights.get(p, 0.0))) * c * s for p, c, s in seen]), add([c * s for _, c, s in seen])
    return F.when(w > 0, F.try_divide(weighted, w)).when(n > 0, F.try_divide(plain, n)).otherwise(0.0)


def judge_receipt(decision: Column, full_coverage: Column, would_search: Column, signal: Column, outcome: Column) -> Column:
    """Label of a receipt that has none: a skip that covered all is good; a search in the shadow is judged by the signal of use."""
    return F.when(outcome.isNotNull(), outcome).when((decision == "use_memory") & full_coverage, "good_skip").when(would_search & (signal == "helped"), "bad_skip").when(would_search & (signal == "useless"), "good_search")


def receipt_summary(receipts: DataFrame) -> DataFrame:
    """receipts(decision, would_search, coverage, outcome) -> counts and rates of all, rounded to 3, null on an empty denominator."""
    d = lambda x: F.count_if(F.col("decision") == x)
    g = receipts.agg(
        F.count("*").alias("total"), d("use_memory").alias("used"), d("verify_one_source").alias("verified"), d("search").alias("searched"), d("ask_user").alias("asked"),
        F.count_if("would_search").alias("shadow"), F.avg("coverage").alias("coverage"), F.count_if(F.col("outcome").isNotNull()).alias("labelled"), F.count_if(F.col("outcome") == "bad_skip").alias("bad"),
    )
    r = lambda a, b: F.round(F.try_divide(a, b), 3)
    return g.select("total", "used", "verified", "searched", "asked", r("used", "total").alias("skip_rate"), r("shadow", "total").alias("shadow_rate"), F.round("coverage", 3).alias("mean_coverage"), r("bad", "labelled").alias("bad_skip_rate"))


def ood_signals(sims: DataFrame, t: float = 0.1) -> DataFrame:
    """sims(query_id, sim) -> -energy, first, gap to the second, to the mean of the rest, to the last, -entropy of softmax(sim / t).

    Sums against a fixed level, combined before the shuffle; the second comes from the two largest.
    """
    e = F.exp((F.col("sim") - 1) / t)
    g = sims.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(e).alias("z"), F.sum(e * (F.col("sim") - 1) / t).alias("ez"), F.max("sim").alias("top"), F.min("sim").alias("last"), F.sum("sim").alias("total"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"))
    second = sims.withColumn("k", F.row_number().over(w)).filter("k = 2").select("query_id", F.col("sim").alias("second"))
    x = g.join(second, "query_id", "left")
    rest = F.when(F.col("n") > 1, F.col("top") - (F.col("total") - F.col("top")) / (F.col("n") - 1)).otherwise(0.0)
    r = lambda c: F.round(c, 6)
    return x.select("query_id", r(1 + t * F.log("z")).alias("energy"), r(F.col("top")).alias("top"), r(F.coalesce(F.col("top") - F.col("second"), F.lit(0.0))).alias("gap"), r(rest).alias("over_rest"), r(F.col("top") - F.col("last")).alias("range"), r(F.col("ez") / F.col("z") - F.log("z")).alias("sharpness"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers mixed, different ones staying different."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case UTF-8 texts one after the other -> hashes of the different runs of [a-z0-9_] longer than two letters, in order within each text, and their offsets."""
    n, rows = len(data), np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    word = WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[rows], after[rows[1:] - 1] = False, False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    long = end - start > 2
    start, size = start[long], (end - start)[long]
    # eight letters at a time; the last ones of a run are cut out by a mask
    eights = np.ndarray((n,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)) if n else np.zeros(0, np.uint64)
    h, left, which = _mixed(size.astype(np.uint64)), size, np.arange(len(start))
    at = start
    while len(which):
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        h[which] = _mixed(h[which] ^ (eights[at] & (~np.uint64(0) >> (np.uint64(64) - keep))))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    edge = np.searchsorted(start, offsets)
    for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        h[lo:hi].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[edge[:-1][edge[:-1] < edge[1:]]] = True
    return h[first], np.append(0, np.cumsum(first))[edge]


def _sets(df: DataFrame) -> DataFrame:
    """df(text, ...) with `set` in place of text, the digest of its token set, and k, the tokens' hashes as unsigned numbers in order; without tokens a row is left out."""
    rest = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            at = 0
            while at < b.num_rows:  # texts of some four million letters at once
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 22), "right")) - 1)
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[at] : offsets[to]]
                k, edge = _token_hashes(data, offsets[at : to + 1] - offsets[at])
                some = np.flatnonzero(np.diff(edge))
                digests = [hashlib.md5(k[edge[i] : edge[i + 1]]).digest() for i in some.tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge[some], len(k)).astype(np.int32)), pa.array(k.view(np.int64)))
                columns = [b.column(i + 1).take(pa.array(some + at)) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), lists], [*rest, "set", "k"])
                at = to

    schema = T.StructType([df.schema[c] for c in rest]).add("set", T.BinaryType()).add("k", T.ArrayType(T.LongType()))
    return df.select(F.lower("text").alias("text"), *rest).mapInArrow(run, schema)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """set, k -> the first row of each set in this task."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for i, s in enumerate(b.column(0).to_pylist()):
            if s not in seen:
                seen.add(s)
                new.append(i)
        yield b.take(pa.array(new, pa.int64()))


def _schemes(low: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each class up to `most`, and parts of each: no set reaches the similarity with one more than a class
    above its own, and in a pair whose smaller set is of the class fewer tokens differ than there are parts."""
    first = [1]
    while first[-1] <= most:
        first.append(int(first[-1] / low) + 1)
    last = np.array(first[1:]) - 1
    return np.array(first[:-1]), ((1 - low) / (1 + low) * (last + np.floor(last / low)) + 1e-9).astype(np.int64) + 1


def _parts(low: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """s, k -> part, before, s, n: digests of the parts of each set in the scheme of its class (n) and in that of the class below (-n), with that of the part before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COMMON):
                b = whole.slice(at, COMMON)
                s, k = b.column(0).to_numpy(), b.column(1)
                flat, n = k.flatten().to_numpy().view(np.uint64), np.diff(k.offsets.to_numpy()).astype(np.int64)
                first, parts = _schemes(low, int(n.max()))
                own, total = np.searchsorted(first, n, "right") - 1, np.append(np.uint64(0), np.cumsum(flat))
                for step in (0, 1):
                    scheme = own - step
                    has = scheme >= 0
                    m = np.where(has, parts[scheme], 1)
                    edge = np.append(0, np.cumsum(m))
                    # a token's part follows from its hash alone and rises with it, so a part is a stretch of the sorted hashes
                    place = (flat >> np.uint64(32)) * np.repeat(m, n).astype(np.uint64) >> np.uint64(32)
                    ends = np.cumsum(np.bincount(np.repeat(edge[:-1], n) + place.astype(np.int64), minlength=edge[-1]))
                    sums = np.diff(total[np.append(0, ends)])
                    row = np.repeat(np.arange(len(n)), m)
                    label = (scheme[row].astype(np.uint64) << np.uint64(32)) + (np.arange(edge[-1]) - edge[row]).astype(np.uint64)
                    part = _mixed(sums + _mixed(label)).view(np.int64)
                    before = np.roll(part, 1)
                    before[edge[:-1]] = s
                    keep = has[row]
                    size = (n if step == 0 else -n).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part[keep]), pa.array(before[keep]), pa.array(s[row][keep]), pa.array(size[row][keep])], ["part", "before", "s", "n"])

    return run


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: which of the tokens that two sets or more have are in it."""
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, some = np.repeat(np.arange(len(sets)), [len(k) for k in sets]), count[place] > 1
    column = np.cumsum(count > 1)[place[some]] - 1
    out = np.zeros((len(sets), -(-int((count > 1).sum()) // 8)), np.uint8)
    np.bitwise_or.at(out, (row[some], column >> 3), (1 << (column & 7)).astype(np.uint8))
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, kind, s, other, set, k by block, a block's sets first -> a, b, both, shared: each pair's digests, the sum of its sizes and its common tokens.

    Where a block has more than a few pairs, its sets become bits.
    """
    block, at, names, sets, bits = None, {}, [], [], None
    for batch in batches:
        blocks, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1), len(blocks)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if lo == hi:
                continue
            if blocks[lo] != block:
                block, at, names, sets, bits = blocks[lo], {}, [], [], None
            part = batch.slice(lo, hi - lo)
            s = part.column(2).to_pylist()
            if kind[lo] == 0:
                at |= {x: len(sets) + i for i, x in enumerate(s)}
                names += part.column(4).to_pylist()
                flat, ends = part.column(5).flatten().to_numpy().copy(), np.append(0, np.cumsum(part.column(5).value_lengths().to_numpy()))
                sets += [flat[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            else:
                a, b = np.array([at[x] for x in s]), np.array([at[x] for x in part.column(3).to_pylist()])
                sizes = np.array([len(k) for k in sets])
                if bits is None and len(a) > 10:
                    bits = _bits(sets)
                if bits is None:
                    shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
                else:
                    step = 1 + (1 << 22) // (bits.shape[1] + 1)
                    shared = np.concatenate([np.bitwise_count(bits[a[i : i + step]] & bits[b[i : i + step]]).sum(1, dtype=np.int64) for i in range(0, len(a), step)])
                both = sizes[a] + sizes[b]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a.tolist()], pa.binary()), pa.array([names[j] for j in b.tolist()], pa.binary()), pa.array(both), pa.array(shared)], ["a", "b", "both", "shared"])


def similar_sets(members: DataFrame, least: float, keep: Scratch) -> DataFrame:
    """members(set, k) -> a, b, jaccard: different token sets, each pair once, that reach `least` (0.5 or more); copies stand for one set.

    Tokens fall into parts by their hashes, one part more than tokens may differ in a pair of such sizes, so the sets of a pair
    have a part in common, whole. Only those are joined on: sets that merely share tokens, however common, do not meet. A pair with
    several parts in common meets at the first of each stretch of them. What has met is compared in blocks of sets.
    """
    n, low = shuffle_partitions(members.sparkSession), least - 1e-6
    once = members.select("set", "k").mapInArrow(_once, "set binary, k array<bigint>").repartition(n, "set").mapInArrow(_once, "set binary, k array<bigint>")
    sets = keep(once.withColumn("s", F.monotonically_increasing_id()))
    parts = sets.select("s", "k").mapInArrow(_parts(low), "part long, before long, s long, n int")
    side = lambda x: parts.select("part", F.col("before").alias(f"before{x}"), F.col("s").alias(x), F.col("n").alias(f"n{x}"))
    size = F.least(F.abs("na"), F.abs("nb")) >= least * F.greatest(F.abs("na"), F.abs("nb")) - 1e-9
    met = side("a").join(side("b"), "part").filter((F.col("a") < F.col("b")) & (F.col("beforea") != F.col("beforeb")) & ((F.col("na") > 0) | (F.col("nb") > 0)) & size)
    near = keep(met.select("a", "b").distinct())
    # sets that are near many others are near the same ones: pairs come to blocks by their sets' first neighbours, each set once to a block
    label = near.select(F.col("a").alias("s"), "b").union(near.select(F.col("b"), F.col("a"))).groupBy("s").agg(F.least(F.min("b"), F.col("s")).alias("label"))
    crowd = label.groupBy("label").agg(F.count("*").alias("crowd"))
    labels = keep(label.join(crowd, "label").select("s", F.xxhash64("label", F.pmod(F.xxhash64("s"), F.ceil(F.col("crowd") / BLOCK))).alias("label")))
    at = lambda x: labels.select(F.col("s").alias(x), F.col("label").alias(f"label{x}"))
    blocks = keep(near.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.xxhash64(F.least("labela", "labelb"), F.greatest("labela", "labelb")).alias("block")))
    members = blocks.select("block", F.col("a").alias("s")).union(blocks.select("block", F.col("b"))).distinct().join(sets, "s")
    rows = members.select("block", F.lit(0).alias("kind"), "s", F.lit(None).cast("long").alias("other"), "set", "k").union(blocks.select("block", F.lit(1), "a", "b", F.lit(None).cast("binary"), F.lit(None).cast("array<long>")))
    rows = rows.repartition(n, "block").sortWithinPartitions("block", "kind")
    full = rows.mapInArrow(_compared, "a binary, b binary, both long, shared long")
    return full.select("a", "b", F.round(F.col("shared") / (F.col("both") - F.col("shared")), 6).alias("jaccard")).filter(F.col("jaccard") >= least)


@scratched
def write_gate(candidates: DataFrame, existing: DataFrame, *, keep: Scratch) -> DataFrame:
    """candidates(id, uri, body, importance, concepts), existing(id, text, strength, seq) -> id, verdict, against.

    The first rule that fails decides; a body that nearly repeats a strong memory (the first in order) contradicts it.
    """
    both = existing.filter("strength >= 0.8").select("id", "text", "seq", F.lit(True).alias("strong")).unionByName(candidates.select("id", F.col("body").alias("text"), F.lit(False).alias("strong")), allowMissingColumns=True)
    members = keep(_sets(both))
    pairs = keep(similar_sets(members, 0.9, keep).select("a", "b"))
    strong, asked = members.filter("strong"), members.filter("not strong")
    # of each set the first two strong memories: the first of them that is not the candidate itself is the first of all
    own = strong.groupBy("set", "id").agg(F.min("seq").alias("seq"))
    two = own.withColumn("k", F.row_number().over(Window.partitionBy("set").orderBy("seq", "id"))).filter("k <= 2").select("set", "seq", "id")
    there = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = there.join(two.withColumnRenamed("set", "b"), "b").select(F.col("a").alias("set"), "seq", "id").unionByName(two)
    best = beside.withColumn("k", F.row_number().over(Window.partitionBy("set").orderBy("seq", "id"))).filter("k <= 2").select("set", "seq", F.col("id").alias("against"))
    first = asked.select("id", "set").distinct().join(best, "set").filter(F.col("id") != F.col("against")).groupBy("id").agg(F.min(F.struct("seq", "against"))["against"].alias("against"))
    x = candidates.select("id", "uri", "importance", "concepts", (F.length(F.coalesce("body", F.lit(""))) < 16).alias("short")).join(first, "id", "left")
    verdict = (
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "schema_no_source").when(F.coalesce("importance", F.lit(0)) <= 2, "importance").when(F.coalesce(F.size("concepts"), F.lit(0)) < 1, "concepts")
        .when(F.col("short"), "body").when(F.coalesce("uri", F.lit("")) == "", "schema_no_source").when(F.col("against").isNotNull(), "contradiction").otherwise("promote")
    )
    return x.select("id", verdict.alias("verdict"), F.when(verdict == "contradiction", F.col("against")).alias("against"))


@scratched
def contradictions(nodes: DataFrame, least: float = 0.9, *, keep: Scratch) -> DataFrame:
    """nodes(id, text, concepts, at) -> kept, demoted: near-equal memories that share a concept while each has one of its own; the older is demoted."""
    members = keep(_sets(nodes.select("id", "text", "concepts", "at")))
    sets = keep(similar_sets(members, least, keep).select("a", "b"))
    side = lambda n: members.select(F.col("set").alias(f"{n}_set"), F.col("id").alias(n), F.col("concepts").alias(f"{n}_c"), F.col("at").alias(f"{n}_at"))
    there = sets.select(F.col("a").alias("a_set"), F.col("b").alias("b_set")).unionByName(sets.select(F.col("b").alias("a_set"), F.col("a").alias("b_set")))
    across = there.join(side("a"), "a_set").join(side("b"), "b_set").filter("a < b")
    within = side("a").join(side("b"), F.col("a_set") == F.col("b_set")).filter("a < b")
    x = across.select(*within.columns).unionByName(within)
    own = lambda p, q: F.size(F.array_except(p, q)) > 0
    x = x.filter((F.size(F.array_intersect("a_c", "b_c")) > 0) & own("a_c", "b_c") & own("b_c", "a_c"))
    older = F.col("a_at") <= F.col("b_at")
    return x.select(F.when(older, F.col("b")).otherwise(F.col("a")).alias("kept"), F.when(older, F.col("a")).otherwise(F.col("b")).alias("demoted"))


def forget_plan(nodes: DataFrame, now: Column, base: float = 0.5, band: str = "frozen", contradicting: bool = True) -> DataFrame:
    """nodes(id, tier, is_latest, forget_after, at, accesses) -> id, action, reason, against: delete what is due, demote what is old and frozen, else keep.

    band `cold` demotes cold memories too. A missing is_latest counts as live. Where the nodes have text and concepts, what is kept is
    searched for contradictions: the older of a pair is demoted, once for each pair (against names the newer).
    """
    at = F.coalesce("at", now)
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 86.4e9)
    weak = retention_band(retention(age, F.col("accesses"), F.lit(0.0), base)).isin("frozen", *(["cold"] if band == "cold" else []))
    action = F.when(F.coalesce(F.col("forget_after") <= now, F.lit(False)), "delete").when((age >= 30) & weak, "demote").otherwise("keep")
    reason = F.when(action == "delete", "ttl_expired").when(action == "demote", "retention_frozen")
    live = nodes.filter((F.col("tier") != "observation") & F.coalesce("is_latest", F.lit(True)))
    plan = live.select("id", action.alias("action"), reason.alias("reason"), F.lit(None).cast(nodes.schema["id"].dataType).alias("against"))
    if not contradicting or not {"text", "concepts"} <= set(nodes.columns):
        return plan
    kept = live.filter(action == "keep").select("id", "text", "concepts", at.alias("at"))
    pairs = contradictions(kept).select(F.col("demoted").alias("id"), F.lit("demote").alias("action"), F.lit("contradiction").alias("reason"), F.col("kept").alias("against"))
    return plan.join(pairs.select("id").distinct(), "id", "left_anti").unionByName(pairs)


def forget_stats(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: nodes inspected, those with a tier that are live, deletes, demotes, contradictions."""
    n = nodes.agg(F.count("*").alias("inspected")).withColumn("one", F.lit(1))
    count = lambda c: F.count_if(c)
    p = plan.agg(F.count_distinct("id").alias("tiered"), count(F.col("action") == "delete").alias("deletes"), count(F.col("action") == "demote").alias("demotes"), count(F.coalesce(F.col("reason") == "contradiction", F.lit(False))).alias("contradictions"))
    return n.join(F.broadcast(p.withColumn("one", F.lit(1))), "one").drop("one")  # one row each


def apply_forget_plan(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """Nodes without the deleted, the demoted no longer the latest."""
    p = plan.groupBy("id").agg(F.bool_or(F.col("action") == "delete").alias("delete_"), F.bool_or(F.col("action") == "demote").alias("demote_"))
    x = nodes.join(p, "id", "left")
    return x.filter(~F.coalesce("delete_", F.lit(False))).withColumn("is_latest", F.when(F.coalesce("demote_", F.lit(False)), False).otherwise(F.col("is_latest"))).drop("delete_", "demote_")


def forget_rest(edges: DataFrame, vectors: DataFrame, nodes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What else a plan changes: edges and vectors(id) without the deleted nodes, and errors(id, message) for items whose node is not there."""
    gone = plan.filter("action = 'delete'").select("id").distinct()
    rest = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)
    lost = plan.filter("action <> 'keep'").join(nodes.select("id"), "id", "left_anti")
    message = F.when(F.col("action") == "demote", "node missing at demote time").otherwise("delete failed: node missing")
    return rest, vectors.join(gone, "id", "left_anti"), lost.select("id", message.alias("message"))


def session_retention(nodes: DataFrame, signal: Column, cutoff: Column, prefix: str = "session://") -> DataFrame:
    """Nodes without the session entries older than the cutoff that hold no key signal."""
    old = F.startswith("source_uri", F.lit(prefix)) & (F.col("fetched_at") < cutoff) & ~signal
    return nodes.filter(~F.coalesce(old, F.lit(False)))


def consolidated(clusters: DataFrame, summaries: DataFrame) -> DataFrame:
    """clusters(workspace, cluster, id), summaries(workspace, cluster, summary) -> one memory a cluster: id from its content, sources sorted; blank summaries give none."""
    ids = clusters.groupBy("workspace", "cluster").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("sources"))
    x = ids.join(summaries, ["workspace", "cluster"]).filter(F.trim(F.coalesce("summary", F.lit(""))) != "")
    ident = F.concat(F.lit("consolidated:"), F.substring(F.sha2(F.concat_ws(":", "workspace", F.array_join("sources", ","), "summary"), 256), 1, 32))
    return x.select(ident.alias("id"), "workspace", "sources", "summary")



#: The kind of a node that stands for a cluster.
MEMORY = "consolidated_memory"


def consolidation_candidates(nodes: DataFrame, vectors: DataFrame, workspace: str | None = None) -> DataFrame:
    """nodes(id, workspace, kind, consolidated_at, timestamp, fetched_at), vectors(id, vector) -> workspace, id, at, vector: entries for greedy_clusters().

    Nodes of one workspace, or of all, that are neither consolidated nor such a memory and have a vector; without a time they are of 1970.
    """
    raw = nodes.filter((F.coalesce(F.col("consolidated_at").cast("string"), F.lit("")) == "") & (F.coalesce("kind", F.lit("")) != MEMORY))
    if workspace is not None:
        raw = raw.filter(F.col("workspace") == workspace)
    at = F.coalesce(F.col("timestamp").cast("string"), F.col("fetched_at").cast("string"), F.lit("1970-01-01T00:00:00Z"))
    return raw.select("workspace", "id", at.alias("at")).join(vectors.select("id", "vector"), "id").select("workspace", "id", "at", "vector")


def mark_consolidated(nodes: DataFrame, memories: DataFrame, at: Column) -> DataFrame:
    """Nodes with consolidated_at set for the sources of the memories(id, sources)."""
    done = memories.select(F.explode("sources").alias("source_")).distinct().withColumn("done_", F.lit(True))
    x = nodes.join(done, F.col("id").cast("string") == F.col("source_"), "left")
    return x.withColumn("consolidated_at", F.when(F.col("done_"), at).otherwise(F.col("consolidated_at"))).select(*nodes.columns)


def consolidation_status(nodes: DataFrame) -> DataFrame:
    """nodes(workspace, kind, consolidated_at) -> per workspace raw, consolidated_raw, consolidated_memories."""
    memory = F.coalesce("kind", F.lit("")) == MEMORY
    done = F.coalesce(F.col("consolidated_at").cast("string"), F.lit("")) != ""
    count = lambda c, n: F.count_if(c).alias(n)
    return nodes.groupBy(F.coalesce("workspace", F.lit("(no workspace)")).alias("workspace")).agg(count(~memory & ~done, "raw"), count(~memory & done, "consolidated_raw"), count(memory, "consolidated_memories"))


def consolidation_prune(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, vectors(id) without the consolidated sources (write_prune_backup first); memories stay."""
    gone = nodes.filter((F.coalesce(F.col("consolidated_at").cast("string"), F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != MEMORY)).select("id").distinct()
    rest = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), rest.select(*edges.columns), vectors.join(gone, "id", "left_anti").select(*vectors.columns)
