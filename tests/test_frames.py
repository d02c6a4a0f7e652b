import os

from graphloom.components import components
from graphloom.frames import Scratch, pick, shared_folder, stored


def test_pick_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, text string, TEXT string")
    assert pick(df, "text", "id").first() == ("a", 1)
    assert pick(df, "TEXT").first() == ("b",)


def test_stored_tables_keep_rows(spark):
    df = stored(spark.range(10).repartition(3))
    assert sorted(r.id for r in df.collect()) == list(range(10))
    assert stored(spark.range(0)).count() == 0
    with Scratch(spark) as keep:
        t = keep(spark.range(3))
        assert t.count() == 3 and os.path.isdir(keep.folder.removeprefix("file:"))
    assert not os.path.isdir(keep.folder.removeprefix("file:"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (3, 3), (None, 1), (10, 9), (9, 8), (8, 10), (5, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | dict.fromkeys(range(100, 161), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_parts(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1900)]
    parent = list(range(3000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
    named = components(df.select(*[F.format_string("n%06d", c).alias(c) for c in ("a", "b")]))
    assert {int(r.node[1:]): int(r.component[1:]) for r in named.collect()} == got
