import random

from pyspark.sql import functions as F

from graphloom.frames import Scratch
from graphloom.operators import memory


def texts(seed):
    """Sets near each other at many sizes, copies in other order and case, without tokens, missing."""
    r = random.Random(seed)
    words = [f"w{i:03d}" for i in range(300)]
    out = []
    for _ in range(14):
        base = r.sample(words, r.choice([3, 9, 10, 19, 20, 40, 120]))
        for _ in range(5):
            some = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                some[r.randrange(len(some))] = r.choice(words)
            r.shuffle(some)
            out.append(" ".join(some).upper() if r.random() < 0.3 else " ".join(some))
        out.append(out[-1])
    return [*out, "", "a b", None, None]


def alike(x, y, least):
    a, b = ({t for t in (s or "").lower().split() if len(t) > 2} for s in (x, y))
    return bool(a and b) and round(len(a & b) / len(a | b), 6) >= least


def test_pairs_and_gate_equal_all_against_all(spark):
    every = texts(1)
    rows = [(i, t, ["all", str(i % 3)], i * 7 % 11) for i, t in enumerate(every)]
    got = {tuple(r) for r in memory.contradictions(spark.createDataFrame(rows, "id long, text string, concepts array<string>, at long"), 0.9).collect()}
    want = {((b, a) if a * 7 % 11 <= b * 7 % 11 else (a, b)) for a in range(len(every)) for b in range(a + 1, len(every)) if a % 3 != b % 3 and alike(every[a], every[b], 0.9)}
    assert got == want and len(want) > 60
    c = [(i, "u", t, 5, ["x"]) for i, t in enumerate(every)]
    e = [(i, t, 0.5 if i % 5 == 0 else 0.9, 1000 - i) for i, t in enumerate(every)]
    gate = memory.write_gate(spark.createDataFrame(c, "id long, uri string, body string, importance int, concepts array<string>"), spark.createDataFrame(e, "id long, text string, strength double, seq long"))
    for row in gate.filter("verdict in ('contradiction', 'promote')").collect():
        near = [j for j in range(len(every)) if j != row.id and j % 5 and alike(every[row.id], every[j], 0.9)]
        assert row.against == (max(near) if near else None)


def test_sets_against_all_pairs_with_few_ranked_tokens(spark, monkeypatch):
    every = texts(2)
    docs = spark.createDataFrame([(t,) for t in every], "text string")
    sets = {frozenset(t for t in s.lower().split() if len(t) > 2) for s in every if s} - {frozenset()}
    for common in (1 << 17, 20, 1):
        monkeypatch.setattr(memory, "COMMON", common)
        for least in (0.5, 0.8):
            with Scratch(spark) as keep:
                got = sorted(r.jaccard for r in memory.similar_sets(memory._sets(docs), least, keep).collect())
            some = list(sets)
            want = sorted(round(len(a & b) / len(a | b), 6) for i, a in enumerate(some) for b in some[i + 1 :] if round(len(a & b) / len(a | b), 6) >= least)
            assert got == want


def test_copies_meet_as_one_set(spark):
    """3,000 copies: as pairs with their sets these would be 9 million times 5 kB."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("word"), i)), " ")
    x = spark.range(3000).select("id", text.alias("text"))
    c = x.select("id", F.lit("u").alias("uri"), F.col("text").alias("body"), F.lit(5).alias("importance"), F.array(F.lit("x")).alias("concepts"))
    got = memory.write_gate(c, x.select("id", "text", F.lit(0.9).alias("strength"), F.col("id").alias("seq")))
    assert {(r.verdict, r.against, r["count"]) for r in got.groupBy("verdict", "against").count().collect()} == {("contradiction", 0, 2999), ("contradiction", 1, 1)}
