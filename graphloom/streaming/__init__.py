"""Streaming jobs with watermarks; each takes a streaming frame, and run_once drains one to a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.frames import Scratch, shared_folder, stored
from graphloom.operators import ingest


def drained(table: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None, files: int | None = None) -> DataFrame:
    """job over a table as a stream until it ends; what was landed and the stream's state are deleted, the result is stored."""
    with Scratch(table.sparkSession) as keep:
        return stored(run_once(job(follow(table.sparkSession, table, files, keep.folder)), mode, keys, keep.folder))


def follow(spark: SparkSession, table: DataFrame, files: int | None = None, under: str | None = None) -> DataFrame:
    """A stored table as a stream of its files, so many at a time."""
    folder = f"{under or shared_folder(spark)}/landed-{uuid.uuid4()}"
    table.write.parquet(folder)
    reader = spark.readStream.schema(table.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None, under: str | None = None) -> DataFrame:
    """What the stream gives until its input ends; with keys, the last version of each."""
    spark, folder = stream.sparkSession, f"{under or shared_folder(stream.sparkSession)}/stream-{uuid.uuid4()}"
    put = lambda rows, number: rows.withColumn("batch_", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_", LongType())])).parquet(f"{folder}/rows")
    if not keys:
        return rows.drop("batch_")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("r_")).select(*keys, "r_.*")


def event_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """events(ts, event_type) -> window start, event_type, n; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_responses(answers: DataFrame, window: str = "250 milliseconds", limit: float = 0.25) -> DataFrame:
    """answers(request_id, peer_id, issued_at, ts) -> the first answer of each peer to a request; later than the limit is dropped."""
    soon = answers.filter(F.col("ts").cast("double") - F.col("issued_at").cast("double") <= limit)
    return soon.withWatermark("ts", window).dropDuplicatesWithinWatermark(["request_id", "peer_id"])


def debounced(changes: DataFrame, gap: str = "1200 milliseconds", late: str = "10 seconds", most: int = 200) -> DataFrame:
    """changes(root, path, ts) -> the paths of a root that changed without so long a pause, in batches of at most so many."""
    g = changes.withWatermark("ts", late).groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("paths") - 1) / most).cast("int")), lambda k: F.slice("paths", k * most + 1, most))
    return g.select("root", F.col("w.start").alias("start"), F.posexplode(cut).alias("part", "paths"))


def chunk_stream(items: DataFrame) -> DataFrame:
    """items(source_uri, title, text) -> chunk nodes as they arrive; a map over rows, without state."""
    return ingest.chunk_nodes(ingest.chunks(items))
