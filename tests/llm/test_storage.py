import hashlib
import os

import duckdb
import pytest

from graphloom.frames import shared_folder
from graphloom.llm.registry import QUERIES, SQL
from graphloom.llm.secrets import redact, scan, spans, verdicts

SF = "/root/testdata/sf0.001"


def folders(spark):
    return set(os.listdir(shared_folder(spark)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_but_the_result_stays(spark, name):
    before = folders(spark)
    out = QUERIES[name](spark, SF)
    out.count()
    left = folders(spark) - before
    assert len(left) <= 1 and all(x.startswith("table-") for x in left)
    assert "secret" not in out.columns


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_key_blocks_of_any_length(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----" + ("\n" + "Ab9+/" * 12) * 400 + "\n-----END RSA PRIVATE KEY-----"
    assert len(key) > 20_000
    assert spans(f"x {key} y") == [(2, 2 + len(key), True)]
    assert spans(f"a{key}{key}") == [(1, 1 + len(key), True), (1 + len(key), 1 + 2 * len(key), True)]
    assert {s[2] for s in spans(key[:200])} == {False}  # no end mark: its lines are candidates of their own
    assert spans("password: hunter22 " + key) == [(10, 18, True), (19, 19 + len(key), True)]
    short = "-----BEGIN PRIVATE KEY----- MIIE -----END PRIVATE KEY-----"
    assert not [s for s in spans(short) if s[2]]
    assert spans(short + key)[-1] == (0, len(short + key), True)  # the first mark goes with the first end that leaves room for a key
    words = "plain words about nothing in particular and some more of them"
    rows = [(i, f"{words} {hashlib.md5(str(i).encode()).hexdigest()} {words} token = {hashlib.sha1(str(i).encode()).hexdigest()} {words}", "s") for i in range(60)] + [(99, f"{words} ü {key} {words}", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r.doc_id, r.secret) for r in scan(docs).filter("is_secret").collect()}
    assert (99, key) in found and "secret" not in verdicts(docs).columns
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[99] == f"{words} ü [REDACTED] {words}"
