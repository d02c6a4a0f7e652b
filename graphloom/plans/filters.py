"""Queries on Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import Scratch, read, stored
from graphloom.operators import bloom

WORDS = r"'[^\x20\x09-\x0D]+'"
#: Both hashes of a word, byte by byte; the shape follows the number of distinct words.
FNV = lambda w, seed: f"list_reduce(list_prepend({seed}::BIGINT, list_transform(range(0, strlen({w})), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({w})), CAST(2 * i + 1 AS INTEGER), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({w})), CAST(2 * i + 2 AS INTEGER), 1)) - 1)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
BLOOM = f"""
dw AS (SELECT DISTINCT coalesce(source, '-') AS filter, unnest(regexp_extract_all(text, {WORDS})) AS w FROM documents),
bw AS (SELECT DISTINCT unnest(regexp_extract_all(text, {WORDS})) || CASE item_id % 2 WHEN 0 THEN '' ELSE '~' END AS w FROM benchmark),
n AS (SELECT count(DISTINCT w) AS n FROM dw),
mm AS (SELECT n, CAST(least(67108864, greatest(8, ceil(-n * ln(0.01) / (ln(2) * ln(2)) / 8) * 8)) AS BIGINT) AS m FROM n),
sh AS (SELECT m, CAST(greatest(1, least(32, floor(m / CAST(n AS DOUBLE) * ln(2) + 0.5))) AS BIGINT) AS k FROM mm),
hw AS (SELECT w, {FNV("w", 2166136261)} AS h1, {FNV("w", 3735928559)} AS h2 FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
ix AS (SELECT w, unnest(list_transform(range(0, k), lambda i: ((h1 + i * h2) % 4294967296) % m)) AS i FROM hw, sh),
bits AS (SELECT DISTINCT filter, i FROM dw JOIN ix USING (w))
"""


def words(docs: DataFrame, name: F.Column) -> DataFrame:
    return docs.select(name.alias("filter"), F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("value"))


def sources(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """One filter for each source of documents, over all words; sized for all of them, so that they can be united."""
    w = words(read(spark, d, "documents"), F.coalesce("source", F.lit("-")))
    m, k = bloom.optimal_params(w.select("value").distinct().count())
    return bloom.bloom_build(w, m, k), m, k


@query("bloom_estimate", f"""
WITH {BLOOM}, every AS (SELECT * FROM bits UNION SELECT 'all', i FROM bits), c AS (SELECT filter, count(*) AS set_bits FROM every GROUP BY 1)
SELECT filter, CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, set_bits, round(set_bits / CAST(m AS DOUBLE), 9) AS fill, round(-m / CAST(k AS DOUBLE) * ln(1 - set_bits / CAST(m AS DOUBLE)), 6) AS estimate FROM c, sh""")
def estimates(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's filter, and of their union."""
    with Scratch(spark) as keep:
        f = keep(sources(spark, d)[0])
        union = bloom.bloom_union(f.withColumn("filter", F.lit("all")))
        return stored(bloom.bloom_estimate(f.unionByName(union)))


@query("bloom_probe", f"""
WITH {BLOOM}, p AS (SELECT DISTINCT f.filter, ix.w, ix.i FROM ix JOIN bw USING (w), (SELECT DISTINCT filter FROM dw) f)
SELECT p.filter, p.w AS value, bool_and(b.i IS NOT NULL) AS maybe FROM p LEFT JOIN bits b ON b.filter = p.filter AND b.i = p.i GROUP BY 1, 2""")
def probes(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source may hold each word of the benchmark; the words of every second item are altered."""
    with Scratch(spark) as keep:
        filters, m, k = sources(spark, d)
        f = keep(filters)
        b = words(read(spark, d, "benchmark").withColumn("filter", F.col("item_id") % 2), F.col("filter"))
        asked = b.select(F.concat("value", F.when(F.col("filter") == 0, "").otherwise("~")).alias("value")).distinct()
        names = f.select("filter").distinct()
        every = names.groupBy(F.lit(1).alias("one")).agg(F.collect_set("filter").alias("names"))  # one row: the sources' names
        asked = asked.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select(F.explode("names").alias("filter"), "value")
        return stored(bloom.bloom_probe(f, asked, m, k))
