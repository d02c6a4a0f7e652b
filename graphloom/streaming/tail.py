"""Growing line files: each tick reads the complete lines that came since the last one, exactly once.

Under `out` stand rows/tick=N (the lines) and offsets/tick=N (every file's byte offset, line count and time after the
tick). A tick reads the last finished offsets, writes its rows, then its offsets; it is finished when the offsets are.
One that broke off is run again under its number and replaces what it left; one that is finished is left alone. Only
Spark reads and writes files, so any store it knows will do. The listing reads no content; a changed file is read whole by the
scan (which has no byte ranges) and cut at its offset before anything else sees it. Rows of other files are not read: the
scan is given the changed paths, at most BATCH a scan.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OFFSETS = "path string, modified timestamp, offset long, lines long"
ROWS = "path string, line long, value string"
#: Files that changed this lately may be in the middle of being written.
QUIET = 5.0
BATCH = 10_000


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def finished(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the ticks whose offsets are written."""
    ticks = [int(n.removeprefix("tick=")) for n in _names(spark, f"{out}/offsets") if n.startswith("tick=")]
    return sorted(t for t in ticks if "_SUCCESS" in _names(spark, f"{out}/offsets/tick={t}"))


def offsets(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The offsets after the last finished tick (before a number)."""
    done = [t for t in finished(spark, out) if before is None or t < before]
    return spark.read.schema(OFFSETS).parquet(f"{out}/offsets/tick={done[-1]}") if done else spark.createDataFrame([], OFFSETS)


def tailed(spark: SparkSession, out: str) -> DataFrame:
    """All lines of finished ticks: tick, path, line (from 1 in its file), value."""
    done = finished(spark, out)
    if not done:
        return spark.createDataFrame([], f"tick int, {ROWS}")
    return spark.read.schema(f"{ROWS}, tick int").option("basePath", f"{out}/rows").parquet(*[f"{out}/rows/tick={t}" for t in done]).select("tick", "path", "line", "value")


def _listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def tick(spark: SparkSession, folder: str, out: str, number: int, live: str | None = None, now: Column | None = None, quiet: float = QUIET, glob: str = "*.jsonl") -> bool:
    """One tick; false where it was finished before.

    live: the session whose file (by name) is left alone; quiet: seconds for which a file must not have changed. A file
    that became shorter or older is read from its start, its lines counted on.
    """
    if number in finished(spark, out):
        return False
    now = F.current_timestamp() if now is None else now
    known = offsets(spark, out, number)
    files = _listing(spark, folder, glob)
    calm = F.unix_micros(now) - F.unix_micros("modified") >= int(quiet * 1e6)
    if live is not None:
        calm = calm & (F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1) != live)
    old = known.select("path", F.col("modified").alias("was"), F.col("offset").alias("had"), F.col("lines").alias("seen"))
    start = F.when((F.col("was") <= F.col("modified")) & (F.col("had") <= F.col("size")), F.col("had")).otherwise(F.lit(0))
    plan = files.filter(calm).join(old, "path", "left").select("path", "modified", F.coalesce(start, F.lit(0)).cast("long").alias("start"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), "size")
    grown = [r["path"] for r in plan.filter("size > start").select("path").collect()]  # one short string for each file that changed
    text = F.col("content").substr(F.col("start") + 1, F.col("size") - F.col("start"))
    parts = []
    for at in range(0, len(grown), BATCH):
        content = spark.read.format("binaryFile").load([p for p in grown[at : at + BATCH]]).select("path", "content")
        parts.append(content.join(plan.select("path", "modified", "start", "seen", "size"), "path").withColumn("value", text.cast("string")))
    # what ends in a newline; a half line waits
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p)
    if whole is None:
        spark.createDataFrame([], ROWS).write.mode("overwrite").parquet(f"{out}/rows/tick={number}")
        done = spark.createDataFrame([], OFFSETS)
    else:
        lines = F.regexp_extract("value", r"(?s)^(.*\n)", 1)
        cut = whole.select("path", "modified", "start", "seen", lines.alias("lines_"))
        rows = cut.select("path", "seen", F.posexplode(F.split("lines_", "\n")).alias("at", "value"), F.size(F.split("lines_", "\n")).alias("n")).filter("at < n - 1")
        rows.select("path", (F.col("seen") + F.col("at") + 1).alias("line"), "value").write.mode("overwrite").parquet(f"{out}/rows/tick={number}")
        # the offsets follow from the rows as written, though files may have grown meanwhile
        written = spark.read.schema(ROWS).parquet(f"{out}/rows/tick={number}")
        read = written.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("line").alias("lines"))
        done = plan.join(read, "path").select("path", "modified", (F.col("start") + F.col("bytes")).alias("offset"), "lines")
    rest = known.join(done.select("path"), "path", "left_anti")
    rest.unionByName(done).write.mode("overwrite").parquet(f"{out}/offsets/tick={number}")
    return True


def follow_tail(spark: SparkSession, folder: str, out: str, checkpoint: str, every: str = "10 seconds", live: str | None = None, quiet: float = QUIET) -> StreamingQuery:
    """Ticks as micro-batches: a batch that Spark repeats after a failure has the number it had, so it loses and repeats nothing."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda _, number: tick(spark, folder, out, number, live, quiet=quiet)
    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(run).start()


def wait(query: StreamingQuery, ticks: int, most: float = 60.0) -> None:
    """Until so many batches are done, or the time is over."""
    end = time.time() + most
    while time.time() < end and query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < ticks - 1):
        time.sleep(0.2)
