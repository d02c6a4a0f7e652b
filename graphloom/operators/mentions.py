"""Entity mentions: what texts name, by the registry's aliases and by form; who is credited for it.

One Arrow pass finds the candidates of a text with their places. The registry stays a table: a Bloom filter of its names (at
most 8 MB, whatever the registry's size) drops words that it cannot know, and the few candidates left are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import entity_id, normalise_alias
from graphloom.operators import bloom
from graphloom.operators.folds import folded
from graphloom.operators.joins import resolve_alias

# Capitalised words that name nothing.
PLAIN_WORDS = frozenset(
    "The This That These Those Their There When What Where While Which Who Why How And But For Not Are Was Were Has Have Had Will Would Could Should May Might Can"
    " Must Did Does Done Yes No Maybe A An I Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December".split()
)
#: Kinds of candidates in the order in which they win a tie.
KINDS = ("word", "repo", "url", "symbol")
_WORD = re.compile(r"[a-zA-Z][a-zA-Z0-9._-]*")
_REPO = re.compile(r"github\.com/([a-zA-Z0-9][a-zA-Z0-9_-]*/[a-zA-Z0-9][a-zA-Z0-9._-]*)")
_HOST = re.compile(r"https?://([a-z0-9.-]+\.[a-z]{2,})(?:/[^\s)>\"']*)?", re.IGNORECASE)
_NAME = re.compile(r"\b[A-Z][a-zA-Z0-9]{2,}\b", re.ASCII)
LEAST_NAME, MOST_NAME = 4, 40


def candidates(text: str) -> list[tuple[int, str, int]]:
    """Kind (its number), surface and start of what a text may mention; of each surface the first place."""
    out: dict[tuple[int, str], int] = {}
    for m in _WORD.finditer(text):
        if m.end() - m.start() >= 2:
            out.setdefault((0, m[0].lower()), m.start())
    for kind, pattern in ((1, _REPO), (2, _HOST)):
        for m in pattern.finditer(text):
            out.setdefault((kind, m[1] if kind == 1 else m[1].lower()), m.start(1))
    for m in _NAME.finditer(text):
        s = m[0]
        if LEAST_NAME <= len(s) <= MOST_NAME and s not in PLAIN_WORDS and s != s.upper():
            out.setdefault((3, s), m.start())
    return [(kind, surface, start) for (kind, surface), start in out.items()]


def known_names(entities: DataFrame, p: float = 0.01) -> tuple[np.ndarray, int, int]:
    """A Bloom filter, as one array of bytes, of all ids and normalised aliases."""
    names = entities.select(F.col("id").alias("value")).unionByName(entities.select(F.explode("aliases").alias("alias")).select(normalise_alias(F.col("alias")).alias("value")))
    m, k = bloom.optimal_params(entities.select(F.coalesce(F.sum(F.size("aliases") + 1), F.lit(0))).first()[0], p)
    t = bloom.bloom_build(names.select(F.lit("names").alias("filter"), "value"), m, k).select("word", "bits").toArrow()  # at most 8 MB
    words = np.zeros(-(-m // 64), np.int64)
    words[t["word"].to_numpy()] = t["bits"].to_numpy()
    return words.view(np.uint8), m, k


def extract_mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """texts(id, text), entities(id, seq, aliases) -> id, entity_id, kind, surface, start, end: one mention of each entity, its earliest.

    Words that are aliases (of one word), repositories, hosts of addresses, and capitalised names that the
    registry does not know; what it does not know gets an id of its own. Places count code points. Null texts mention nothing.
    """
    sc = texts.sparkSession.sparkContext
    bits, m, k = known_names(entities)
    shared = sc.broadcast(bits)
    kind_of_id = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def maybe(some: list[str]) -> np.ndarray:
            i = bloom.fnv_indexes(pa.array(some, pa.string()), m, k)
            return ((shared.value[i >> 3] >> (i & 7)) & 1).all(1)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(n, *c) for n, t in enumerate(part.column(1).to_pylist()) if t for c in candidates(t)]
                if not rows:
                    continue
                n, kind, surface, start = (list(x) for x in zip(*rows, strict=True))
                able = maybe(surface) | maybe([s.lower() for s in surface])
                keep = np.flatnonzero(able | (np.array(kind) > 0))
                take = lambda xs: [xs[j] for j in keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take(n))), pa.array(take(kind), pa.int32()), pa.array(take(surface), pa.string()), pa.array(take(start), pa.int64()), pa.array(able[keep])], ["id", "rank", "surface", "start", "able"]
                )

    found = texts.select("id", "text").mapInArrow(run, f"id {kind_of_id}, rank int, surface string, start long, able boolean")
    ids = resolve_alias(found.filter("able"), entities).filter("id is not null").select("surface", F.col("id").alias("known"))
    x = found.join(ids, "surface", "left").filter("(rank = 0 and known is not null) or rank in (1, 2) or (rank = 3 and known is null)")
    kind = F.element_at(F.array(*[F.lit(c) for c in KINDS]), F.col("rank") + 1)
    entity = F.coalesce("known", entity_id(kind, F.col("surface")))
    row = F.struct("rank", F.col("surface").alias("key"), "start")
    g = x.withColumn("entity_id", entity).groupBy("id", "entity_id").agg(F.min_by(row, F.struct("start", "rank")).alias("m"))
    named = F.element_at(F.array(*[F.lit(c) for c in KINDS]), F.col("m.rank") + 1)
    return g.select("id", "entity_id", named.alias("kind"), F.col("m.key").alias("surface"), F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.key")).alias("end"))


def hit_mentions(hits: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """hits(query_id, id), edges(source, target, relation), entities(id) -> query_id, entity_id: registered entities that the hits mention, each once."""
    m = edges.filter("relation = 'mentions'").select(F.col("source").alias("id"), F.col("target").alias("entity_id"))
    return hits.select("query_id", "id").join(m, "id").select("query_id", "entity_id").distinct().join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("query_id", "entity_id")


#: What a peer that only passed a match on counts for, and the satisfaction under which an ask says nothing.
RELAY_WEIGHT, LEAST_SATISFACTION = 0.4, 0.4
#: Evidence that every peer begins with (mean a half, as three reviews), and the days in which evidence halves.
PRIOR_SUM, PRIOR_COUNT, HALF_LIFE = 1.5, 3.0, 45.0


def attributed_subjects(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """matches(ask_id, position, node_id, source_peer, also_from_peers), edges(source, target, relation) -> ask_id, peer, subject, place.

    The peers of a match are its source, then those that passed it on, without `local` and blanks; each is given the
    entities that the match mentions. One row for each ask, peer and subject; place orders an ask's peers as they first appear.
    """
    also = F.coalesce("also_from_peers", F.array().cast("array<string>"))
    peers = F.filter(F.concat(F.array("source_peer"), also), lambda p: p.isNotNull() & (p != "") & (p != "local"))
    m = matches.select("ask_id", "position", F.col("node_id").alias("source"), F.posexplode(peers).alias("at", "peer"))
    mentioned = edges.filter("relation = 'mentions' and target <> ''").select("source", F.col("target").alias("subject")).distinct()
    x = m.join(mentioned, "source")
    first = x.groupBy("ask_id", "peer").agg(F.min(F.struct("position", "at")).alias("place"))
    return x.select("ask_id", "peer", "subject").distinct().join(first, ["ask_id", "peer"]).select("ask_id", "peer", "subject", "place")


def review_credits(asks: DataFrame, matches: DataFrame, edges: DataFrame, cap: bool = True) -> DataFrame:
    """asks(ask_id, at, reviewer, satisfaction) and their matches -> subject, peer, ask_id, created_at, weight, score: rows for peer_scores().

    A peer that is the source of any match of the ask counts whole, others RELAY_WEIGHT. Asks below LEAST_SATISFACTION or without a
    `did:` reviewer give nothing. With cap a relay's score is at most the best posterior that the ask's sources
    have for the subject by then (none: no cap), a fold over each subject's asks in time order; without, it is a map.
    """
    good = asks.filter(F.col("satisfaction") >= LEAST_SATISFACTION).filter(F.rlike("reviewer", F.lit("(?i)^did:[a-z0-9]+:.+"))).select("ask_id", F.col("at").alias("created_at"), "satisfaction")
    sources = matches.filter("source_peer <> '' and source_peer <> 'local'").groupBy("ask_id").agg(F.array_sort(F.collect_set("source_peer")).alias("sources"))
    x = attributed_subjects(matches, edges).join(good, "ask_id").join(sources, "ask_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    x = x.withColumn("weight", F.when(F.array_contains("sources", F.col("peer")), 1.0).otherwise(RELAY_WEIGHT)).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("satisfaction").cast("double"))))
    if not cap:
        return x.select("subject", "peer", "ask_id", "created_at", "weight", "score")

    def step(state: dict, b: pa.RecordBatch) -> pa.RecordBatch:
        score = []
        for peer, at, weight, s, sources_ in zip(*[b.column(c).to_pylist() for c in ("peer", "micros", "weight", "score", "sources")], strict=True):
            if weight < 1:
                s = min(s, max((state[p][3] for p in sources_ if p in state), default=s))
            total, count, last, _ = state.get(peer, (0.0, 0.0, at, 0.5))
            decay = 0.5 ** (max(0, at - last) / 86.4e9 / HALF_LIFE)
            total, count = total * decay + weight * s, count * decay + weight
            state[peer] = total, count, at, min(1.0, max(0.0, (PRIOR_SUM + total) / (PRIOR_COUNT + count)))
            score.append(s)
        names = ["subject", "peer", "ask_id", "created_at", "weight"]
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(score, pa.float64())], [*names, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("subject", "peer", "ask_id", "created_at", "weight", "score"))
    rows = x.withColumn("micros", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("p", F.col("place.position")).withColumn("q", F.col("place.at")).drop("place")
    return folded(rows.select("subject", "peer", "ask_id", "created_at", "weight", "score", "sources", "micros", "p", "q"), ["subject"], ["micros", "ask_id", "p", "q"], dict, step, schema)


