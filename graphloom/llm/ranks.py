"""The number of each row in its group's order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.frames import Scratch, shuffle_partitions


def ranked(df: DataFrame, group: str, by: list, keep: Scratch) -> DataFrame:
    """df and `index`, the row's number from 0 in its group by these columns, and `n`, the group's rows.

    group is not null and one of df's columns. One range sort over (group, by) puts neighbours into one partition
    or the next; each partition numbers its rows, and a prefix sum over the groups' counts for each partition (at
    most partitions + groups rows) adds what stands before. A large group so lies in many partitions; rows that are equal
    in all of `by` are interchangeable, and the place they are read from keeps them from falling into one range.
    """
    spread = df.withColumn("tie_", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(shuffle_partitions(df.sparkSession), group, *by, "tie_").sortWithinPartitions(group, *by, "tie_")
    placed = keep(spread.drop("tie_").withColumn("at_", F.monotonically_increasing_id()))
    placed = placed.withColumn("part_", F.shiftright("at_", 33))
    counts = placed.groupBy("part_", group).agg(F.min("at_").alias("first_"), F.count("*").alias("here_"))
    before = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base_", F.coalesce(F.sum("here_").over(before), F.lit(0))).withColumn("n", F.sum("here_").over(Window.partitionBy(group)))
    out = placed.join(keep(counts.select("part_", group, "first_", "base_", "n")), ["part_", group])
    return out.withColumn("index", F.col("at_") - F.col("first_") + F.col("base_")).drop("at_", "part_", "first_", "base_")
