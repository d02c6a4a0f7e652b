import random
from collections import Counter

from pyspark.sql.classic.dataframe import DataFrame

from graphloom.frames import Scratch
from graphloom.operators import memory


def test_sets_of_common_words_do_not_meet(spark, monkeypatch):
    """1,500 sets of 40 of 120 words, three of them in two near forms: hardly more pairs meet than reach the similarity."""
    r = random.Random(3)
    words = [f"w{i:03d}" for i in range(120)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(1500)]
    texts += [t.replace(t.split()[7], "other") for t in texts[:3]]
    met, plain = [], DataFrame.distinct

    def counted(self):
        met.append(self.count())
        return plain(self)

    monkeypatch.setattr(DataFrame, "distinct", counted)
    with Scratch(spark) as keep:
        got = memory.similar_sets(memory._sets(spark.createDataFrame([(t,) for t in texts], "text string")), 0.9, keep).collect()
    assert [x.jaccard for x in got] == [round(39 / 41, 6)] * 3
    assert met and max(met) < 300


def test_tokens_end_where_the_regular_expression_ends_them(spark):
    """Long words, signs of other scripts, capitals that become plain letters, missing and empty texts."""
    r = random.Random(4)
    parts = ["abc", "ab", "x" * 8, "x" * 9, "y" * 1000, "y" * 1001, "ünï", "Kelvin", "Kelvin", "a_b", "_12", "99", "Straße", "日本abc語", "\0nul", "İstanbul", " ", "-", "'", "\n"]
    texts = [None, "", "ab", "abc", "..."] + ["".join(r.choice(parts) + r.choice(["", " ", "é", "--"]) for _ in range(r.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from graphloom.functions.text import jaccard_tokens

    want = {x.id: set(x.t) for x in df.select("id", jaccard_tokens(df.text).alias("t")).collect() if x.t}
    got = {x.id: x for x in memory._sets(df).collect()}
    assert set(got) == set(want) and all(len(set(got[i].k)) == len(got[i].k) == len(want[i]) for i in want)
    same = {(t, h) for i in want for t, h in zip([frozenset(want[i])], [bytes(got[i].set)], strict=True)}
    assert len({t for t, _ in same}) == len({h for _, h in same}) == len(same)
    of = Counter(t for s in want.values() for t in s)  # a token and its hash are in the same texts
    seen = Counter(h for x in got.values() for h in x.k)
    assert sorted(of.values()) == sorted(seen.values())


def test_sets_of_a_crowd_are_sent_to_few_blocks(spark, monkeypatch):
    """300 near copies make 44,850 pairs; each set goes to a few blocks in place of to 299 pairs, and every pair is found with its similarity."""
    r = random.Random(6)
    words, base = [f"w{i:04d}" for i in range(3000)], [f"b{i:03d}" for i in range(120)]
    sets = list({frozenset([*r.sample(base, 118), *r.sample(words, r.choice([1, 2, 8]))]) for _ in range(300)}) + [frozenset(r.sample(words, 50)) for _ in range(20)]
    want = sorted(j for i, a in enumerate(sets) for b in sets[i + 1 :] if (j := round(len(a & b) / len(a | b), 6)) >= 0.9)
    sent, plain = [], DataFrame.distinct

    def counted(self):
        if "block" in self.columns:
            sent.append(plain(self).count())
        return plain(self)

    monkeypatch.setattr(DataFrame, "distinct", counted)
    monkeypatch.setattr(memory, "BLOCK", 100, raising=False)
    with Scratch(spark) as keep:
        got = memory.similar_sets(memory._sets(spark.createDataFrame([(" ".join(s),) for s in sets], "text string")), 0.9, keep).collect()
    assert len(got) == len(want) > 20000 and all(abs(x.jaccard - y) < 2e-6 for x, y in zip(sorted(got, key=lambda x: x.jaccard), want, strict=True))
    assert len({frozenset((bytes(x.a), bytes(x.b))) for x in got}) == len(want)
    assert sent and sent[0] <= 6 * len(sets)
