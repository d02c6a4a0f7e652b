import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm.periodic_runs import collapse_runs, find_runs, numbered, op13_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=24, repeats=3):
    """All runs by trying each period: maximal stretches, smallest period."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 150), rng.choice([1, 2, 3, 5, 50])
            w = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                if n > 5:
                    a, q = rng.randrange(n), rng.randint(1, 30)
                    for x in range(a + q, min(n, a + rng.randint(q, 5 * q))):
                        w[x] = w[x - q]
            texts.append([b"%d" % x for x in w])
        for least in (24, 3):
            t, s, length, p = find_runs(numbered(texts), np.array([len(x) for x in texts], np.int64), least)
            got = [[] for _ in texts]
            for a, b, c, d in zip(t.tolist(), s.tolist(), length.tolist(), p.tolist(), strict=True):
                got[a].append((b, c, d))
            assert got == [plain_runs(w, least) for w in texts]


def test_long_period_and_strings_of_one_letter():
    base = [b"%d" % x for x in range(5000)]
    for w, want in ((base * 4, [(0, 20000, 5000)]), ([b"x"] * 100_000, [(0, 100_000, 1)]), (base * 2, [])):
        t, s, length, p = find_runs(numbered([w]), np.array([len(w)]))
        assert list(zip(s.tolist(), length.tolist(), p.tolist(), strict=True)) == want
    with pytest.raises(ValueError):
        find_runs(np.zeros(3, np.int64), np.array([3]), 24, 2)


def test_collapse_of_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in collapse_runs(odd_docs).collect()}
    assert collapse_runs(odd_docs).count() == odd_docs.count()
    assert [tuple(x) for x in got[5].runs] == [(0, 30000, 1)] and got[5].collapsed == "word"
    assert all(got[k].runs == [] for k in (1, 2, 3, 4, 6, 7, None))
    assert got[3].collapsed == got[4].collapsed == got[6].collapsed == "" and got[None].collapsed == "lonely text here" and got[3].n_words == 0
    assert collapse_runs(odd_docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, " ".join(["a", "b"] * 20 + ["c"] * 30)), (2, "é ü " * 12 + "end")], "doc_id long, text string")
    got = {r.doc_id: r for r in collapse_runs(two).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 40, 2), (40, 30, 1)] and got[1].collapsed == "a b c"
    assert got[2].collapsed == "é ü end"


def test_query_against_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w = (d.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if n > 3000:
            continue  # the loop is quadratic; long texts stand in the tests above
        if h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w)
        planted += bool(runs)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert planted >= 5
