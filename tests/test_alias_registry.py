from pyspark.sql import functions as F

from graphloom.operators import ask, joins


def test_a_registry_is_neither_sent_whole_nor_sorted_before_the_shuffle(spark):
    i = F.col("id")
    e = spark.range(200).select(F.concat(F.lit("e"), i).alias("id"), i.alias("seq"), F.array(F.concat(F.lit("name "), i % 20), F.lit("same"), F.lit("")).alias("aliases"))
    q = spark.range(60).select(i.alias("query_id"), F.when(i % 2 == 0, F.concat(F.lit("Name "), i)).otherwise(F.concat(F.lit("e"), i)).alias("text"))
    out = ask.alias_queries(q, e)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "partial_min_by" not in plan
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.variant)):
        got.setdefault(r.query_id, []).append(r.text)
    assert got == {n: [f"e{n}", f"name {n % 20}", "same"] if n % 2 else [f"Name {n}", "same"] if n < 20 else [f"Name {n}"] for n in range(60)}


def test_the_first_in_order_has_the_alias(spark):
    e = spark.createDataFrame([("late", 9, ["Acme", "acme "]), ("early", 2, [" ACME"]), ("undated", None, ["acme", "lonely"]), ("acme corp", 5, [None])], "id string, seq long, aliases array<string>")
    s = spark.createDataFrame([("acme",), (" Acme",), ("acme corp",), ("lonely",), (None,)], "surface string")
    assert {r.surface: r.id for r in joins.resolve_alias(s, e).collect()} == {"acme": "early", " Acme": "early", "acme corp": "acme corp", "lonely": None, None: None}
