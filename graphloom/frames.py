"""Small helpers that every job shares: reading tables, picking columns, stored intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession


def sound(spark: SparkSession) -> None:
    """Spark 4.1 may take a union of frames that are partitioned alike as partitioned so itself and leave out a shuffle
    that a join after it needs, which repeats rows; with the setting off, results are right."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", "true") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    sound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, whatever else the frame holds.

    Extra columns may differ from a wanted one by case alone, or repeat its name: the first
    column that matches exactly is taken, else the first that matches without regard to case.
    """
    have = df.columns
    if len({c.lower() for c in have}) == len(have):
        return df.select(*names)
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    at = []
    for n in names:
        exact = [i for i, c in enumerate(have) if c == n]
        at.append((exact or [i for i, c in enumerate(have) if c.lower() == n.lower()])[0])
    return plain.selectExpr(*[f"c{i} as `{n}`" for i, n in zip(at, names, strict=True)])


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a session inside one process (tests) gets a temporary folder of its own;
    on a cluster that would lose data, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The frame, computed now, written to the shared folder as Parquet and read again.

    This cuts the lineage and outlives any executor. Unlike a checkpoint the table is compressed, later
    scans read the columns they need, small files share a scan task, and the size that joins are planned
    by is the real one.
    """
    spark = df.sparkSession
    sound(spark)
    path = f"{folder or shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that are deleted together: with Scratch(spark) as keep: t = keep(frame).

    What leaves the block must not depend on them, so the result is written with stored() inside.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"

    def __call__(self, df: DataFrame) -> DataFrame:
        return stored(df, self.folder)

    def round(self, df: DataFrame, number: int) -> DataFrame:
        """The table of one round of a loop; that of the round before the last goes, since only the last is read."""
        if number >= 2:
            delete(self.spark, f"{self.folder}/round-{number - 2}")
        return stored(df, f"{self.folder}/round-{number}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratched(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(frame, ..., keep) as a function of the other arguments: its result is stored, what it kept on the way is deleted.

    A caller that has a Scratch of its own passes it as keep and reads the result while that lasts.
    """

    @wraps(f)
    def run(first: DataFrame, *args: object, keep: Scratch | None = None, **more: object) -> DataFrame:
        if keep is not None:
            return f(first, *args, keep=keep, **more)
        with Scratch(first.sparkSession) as own:
            return stored(f(first, *args, keep=own, **more))

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
