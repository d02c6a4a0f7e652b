"""Stages of the pipeline against plain loops, and odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """Documents with toxic words, near copies, secrets, repeated and odd rows; a folder with their labels."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeghilmnorstu"), int(rng.integers(3, 8)))) for _ in range(400)]
    docs, labels = [], []
    for i in range(160):
        w = list(rng.choice(words, 60))
        if i % 4 == 0:
            w[5:8] = ["xqzzkv", "wwxqjj", "xqzzkv"]
        labels.append((i, int(i % 4 == 0)))
        docs.append((i, " ".join(w), "en", "abc"[i % 3], None))
    docs += [(500, docs[1][1] + " more", "en", "a", 3), (501, docs[1][1] + " more", "en", "b", 3), (1, docs[1][1], "en", "b", None), (None, docs[2][1], "en", "b", None), (None, docs[2][1], "en", "b", None)]
    docs += [(600, None, None, None, None), (601, "", "en", "a", 0), (None, " \t", None, "b", None)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, TEXT string")
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return df, docs, dict(labels), folder


def scores(docs, labels):
    """Class-conditional Kneser-Ney scores with dictionaries, one document after the other."""
    fold = {d[0]: 0 if d[0] is None else zlib.crc32(str(d[0]).encode()) % 5 for d in docs}
    of = lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower()))
    grams = lambda w: [f"^{w}$"[max(0, i - 3) : i + 1] for i in range(1, len(w) + 2)]
    count, seen = {0: Counter(), 1: Counter()}, set()
    for d in docs:
        k = labels.get(d[0]) if fold[d[0]] not in (0, 4) else None
        for w in of(d[1]):
            for g in grams(w):
                seen |= {g[j:] for j in range(max(1, len(g) - 1)) if len(g) > 1}
                if k is not None:
                    count[k][g] += 1
    cont = Counter(g[1:] for g in seen)
    heads = {k: Counter() for k in (0, 1, "c")}
    types = {k: Counter() for k in (0, 1, "c")}
    for k, c in ((0, count[0]), (1, count[1]), ("c", cont)):
        for g, n in c.items():
            heads[k][g[:-1]] += n
            types[k][g[:-1]] += n > 0

    def shared(g):
        p = 1 / 256
        for size in range(1, 4):
            x = g[-size:]
            if len(g) > size and heads["c"][x[:-1]]:
                p = (max(cont[x] - 0.75, 0) + 0.75 * types["c"][x[:-1]] * p) / heads["c"][x[:-1]]
        return max(p, 1e-9)

    def llr(w):
        out = 0.0
        for g in grams(w):
            low = shared(g)
            p = [(max(count[k][g] - 0.75, 0) + 0.75 * types[k][g[:-1]] * low) / heads[k][g[:-1]] if heads[k][g[:-1]] else low for k in (0, 1)]
            out += log(max(p[1], 1e-12)) - log(max(p[0], 1e-12))
        return out

    evidence = [sum(max(llr(w) - 2, 0) for w in of(d[1])) / len(of(d[1])) ** 0.7 if of(d[1]) else 0.0 for d in docs]
    return fold, evidence


def test_toxicity_against_a_plain_loop(spark, labelled):
    import corpus_pipeline
    from graphloom.llm.toxicity import ToxicityModel, curve

    df, docs, labels, folder = labelled
    fold, evidence = scores(docs, labels)
    fit = [i for i, d in enumerate(docs) if d[0] in labels and fold[d[0]] == 4]
    a, b = curve(np.array([evidence[i] for i in fit]), np.array([float(labels[docs[i][0]]) for i in fit]))
    want = sorted((d[1] or "", round(1 / (1 + exp(-(a * e + b))), 5)) for d, e in zip(docs, evidence, strict=True))
    named = df.toDF("doc_id", "text", "lang", "source", "n_chars", "extra")
    model = ToxicityModel(named, spark.read.parquet(f"{folder}/labels.parquet"))
    got = sorted((r["text"] or "", round(r["score"], 5)) for r in rows(model.score(named, ["doc_id", "text"])))
    assert got == want
    kept = rows(corpus_pipeline.toxicity(spark, df, folder))
    assert sorted(r["text"] or "" for r in kept) == sorted(t for t, s in want if s < 0.5)
    held = [(labels[d[0]], s) for d, s in zip(docs, evidence, strict=True) if d[0] in labels and fold[d[0]] == 0]
    assert len(held) > 10 and min(s for k, s in held if k) > max(s for k, s in held if not k)


def test_near_dedup_keeps_one_of_each_group(spark, labelled):
    import corpus_pipeline

    df, docs, _, folder = labelled
    sets = []
    for d in docs:
        w = (d[1] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    got = rows(corpus_pipeline.near_dedup(spark, df, folder))
    groups = {t for i, t in enumerate(top) if sets[i]}
    assert len(got) == len(groups) + sum(not s for s in sets)
    assert list(got[0]) == corpus_pipeline.COLUMNS
    place = {d[1]: top[i] for i, d in enumerate(docs)}
    assert {place[r["text"]] for r in got if (r["text"] or "").strip()} == groups
    for r in got:
        if (r["text"] or "").strip():
            mates = [d[0] for i, d in enumerate(docs) if top[i] == place[r["text"]] and d[0] is not None]
            assert r["doc_id"] == (min(mates) if mates else None)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), folder).count() == 0


def test_secret_scan_mixing_bpe_on_odd_rows(spark, labelled):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline

    df, docs, _, folder = labelled
    out = rows(corpus_pipeline.secret_scan(spark, df, folder))
    assert sorted(str(r["text"]) for r in out) == sorted(str(d[1]) for d in docs)  # none of these holds a secret
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs]
    source = sorted({d[3] for d in docs if d[3] is not None}) + [None]
    own = {s: sum(n for n, d in zip(size, docs, strict=True) if d[3] == s) for s in source}
    weight = {s: 1 + i % 3 for i, s in enumerate(source)}
    goal, left, free = {}, float(sum(size)), [s for s in source]
    while True:  # step by step: cap the sources that are above, share the rest again
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > 3 * own[s]]
        if not above:
            goal |= {s: weight[s] * level for s in free}
            break
        for s in above:
            goal[s] = 3 * own[s]
            left -= goal[s]
            free.remove(s)
    from graphloom.llm.mixing import mix

    named = df.toDF("doc_id", "text", "lang", "source", "n_chars", "extra")
    mixed = rows(mix(named))
    for s in source:
        part = [r for r in mixed if r["source"] == s]
        assert abs(part[0]["target"] - goal[s]) < 1e-6 and sum(r["taken"] for r in part) == int(goal[s] + 1e-9)
        assert sorted(r["size"] for r in part) == sorted(n for n, d in zip(size, docs, strict=True) if d[3] == s)
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += -(-r["taken"] // r["size"]) if r["taken"] else 0
    copies = rows(corpus_pipeline.mixing(spark, df, folder))
    got = Counter(r["doc_id"] for r in copies)
    assert {k: n for k, n in got.items() if k not in (1, None)} == {k: n for k, n in want.items() if n and k not in (1, None)}
    assert list(copies[0]) == corpus_pipeline.COLUMNS
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    ids = {hashlib.sha256(" ".join(map(str, t.encode(d[1] or "", add_special_tokens=False).ids)).encode()).hexdigest() for d in docs}
    coded = rows(corpus_pipeline.bpe(spark, df, folder))
    assert len(coded) == len(docs) and {r["ids_sha256"] for r in coded} == ids
