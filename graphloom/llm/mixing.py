"""Mixing sources to target weights (operator 6), DataFrame functions only.

Each document gets a hash-random key. Within its source the keys are a range sort: the key's
leading hex digits name one of 4096 equal ranges, so a source that holds a third of all rows is
spread over 4096 windows. Token counts are summed per range, ranges are prefix-summed (at most 4096
rows a source), and a window inside each range completes the distributed prefix sum. Each source
is cut at its exact budget; whole epochs are repeated where the budget exceeds the source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null
or repeated doc_ids are rows like others (ties fall to the text's hash; equal rows are
interchangeable); no rows: no result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, scratched

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range within a source.
RANGE_DIGITS = 3


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources(source, source_size) -> those and target double.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the total. A target
    stops at max_epochs times the source's size and the excess is shared again by weight. With
    sources ordered by cap / weight, the capped ones are a prefix: source i is capped when the
    level, (total - caps before it) / (weights from it on), reaches its own cap / weight.
    The windows run over one row per source, without partitions: for a million sources some 50 MB in one task.
    """
    ranked = sources.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    all_rows = Window.partitionBy()
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    r = ranked.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    r = r.withColumn("total", F.sum("source_size").over(all_rows))
    r = r.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("weights_on", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    r = r.withColumn("reach", (F.col("total") - F.col("caps_before")) / F.col("weights_on"))
    free = F.col("reach") < F.col("level")
    r = r.withColumn("final", F.min(F.when(free, F.struct("level", "reach"))).over(all_rows)["reach"])
    return r.select("source", "source_size", F.when(free, F.col("weight") * F.col("final")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, max_epochs: int = 3) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken."""
    return mix_keyed(docs, max_epochs).drop("tie")


@scratched
def mix_keyed(docs: DataFrame, max_epochs: int = 3, *, keep: Scratch) -> DataFrame:
    """As mix(), and tie, the hash of the text, which with doc_id names the row.

    taken counts words, repeats included: floor(target / source_size) whole epochs, then documents
    in key order up to the budget; the document that crosses the budget gives only what is left,
    so each source's sum of taken is floor(target) exactly.
    """
    rows = pick(docs, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64("text").alias("tie"),
    )
    rows = keep(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), max_epochs)
    g = goal.select(F.col("source").alias("of"), "source_size", "target")
    plan = ranges.join(g, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("in_range"), "range_start", "source_size", "target")
    w = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("upto", F.sum("size").over(w))
    x = inside.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    x = x.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    start = F.col("range_start") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - start))
    return x.select("doc_id", "tie", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(read(spark, sf_dir, "documents")).drop("source")


#: Caps are settled by the same closed form; sizes by the same word pattern.
MIX_CTES = r"""
sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM docs),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM per),
lv AS (SELECT *, 3 * source_size AS cap, (3 * source_size) / CAST(weight AS DOUBLE) AS level, sum(source_size) OVER () AS total FROM w),
rc AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS reach FROM lv),
goal AS (
  SELECT source, source_size, CASE WHEN reach < level THEN weight * first_value(reach) OVER (ORDER BY CASE WHEN reach < level THEN 0 ELSE 1 END, level, source NULLS LAST) ELSE CAST(cap AS DOUBLE) END AS target FROM rc),
pos AS (
  SELECT s.*, g.source_size, g.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM pos),
taken AS (
  SELECT *, CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - start)) AS BIGINT) AS taken FROM mixed)
"""
OP6_SQL = f"WITH docs AS (SELECT * FROM documents), {MIX_CTES} SELECT doc_id, size, source_size, target, taken FROM taken"
