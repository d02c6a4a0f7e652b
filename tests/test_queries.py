"""Each query with SQL against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not re.match(r"op\d+_|pipeline$", k)}


def plain(v):
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{v:.6g}" if hasattr(v, "is_integer") and not isinstance(v, (bool, int)) else (str(v) if isinstance(v, (bool, int)) or v is not None else None)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    assert rows == want


def test_pagerank_sums_to_one(spark):
    from graphloom.operators.graph import personalized_pagerank

    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "source long, target long, weight double")
    s = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "id long, p double")
    got = {r.id: r["rank"] for r in personalized_pagerank(e, s).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6
    assert got[2] > got[1] > got[0]
    with pytest.raises(ValueError):
        personalized_pagerank(e, s, alpha=1.5)


def test_pagerank_query_runs_all_rounds(spark):
    """Parts and suppliers swap their rank each round; the suppliers' share goes to 1 / 1.85."""
    from pyspark.sql import functions as F

    got = __spark_entry__.queries()["personalized_pagerank"](spark, SF)
    share = got.filter("id >= 10000000").agg(F.sum("rank")).first()[0]
    assert abs(share - 1 / 1.85) < 2e-4
