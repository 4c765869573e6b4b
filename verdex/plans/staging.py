"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a file should hold at least, where many partitions would write few each.
FILE_ROWS = 10_000


def shared_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only where it names none and all work is done on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdex-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/verdex/{label}-{uuid.uuid4().hex[:12]}"


def gathered(df: DataFrame, n: int) -> DataFrame:
    """``df``, of some ``n`` rows, in few partitions where the session's shuffle partitions are far more than so many rows need.

    What makes the rows keeps its tasks; they are dealt on once more, evenly. For each file that it
    writes to a mounted folder, and for its checksum, an executor's JVM starts a process (chmod).
    """
    spark = df.sparkSession
    files = max(spark.sparkContext.defaultParallelism, n // FILE_ROWS + 1)
    return df if int(spark.conf.get("spark.sql.shuffle.partitions")) < 4 * files else df.repartition(files)


def staged(df: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. Given its size, ``n`` rows or so, in few files."""
    path = fresh_dir(df.sparkSession, label)
    (df if n is None else gathered(df, n)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged table that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
