"""The change log as a stream: deduplicated, and folded into each key's state; an extension beyond the batch library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "key long, changes long, latest_us long, terminal string, terminal_us long"


def folded(events: DataFrame) -> DataFrame:
    """Of a stream ``(key, at_us, terminal)``: running count, latest time and last terminal state of each key.

    The state of a key is five numbers, whatever its changes; late changes fold in like
    others, as every part of the state is a maximum or a sum.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, latest, terminal, terminal_at = state.get if state.exists else (0, -1, None, -1)
        for batch in batches:
            n += len(batch)
            latest = max(latest, int(batch["at_us"].max()))
            settled = batch[batch["terminal"].notna()]
            if len(settled):
                last = settled.loc[settled["at_us"].idxmax()]
                if last["at_us"] > terminal_at:
                    terminal, terminal_at = last["terminal"], int(last["at_us"])
        state.update((n, latest, terminal, terminal_at))
        yield pd.DataFrame({"key": [key[0]], "changes": [n], "latest_us": [latest], "terminal": [terminal], "terminal_us": [terminal_at if terminal else None]})

    return events.groupBy("key").applyInPandasWithState(fold, STATE, "changes long, latest_us long, terminal string, terminal_us long", "update", GroupStateTimeout.NoTimeout)


def new_results(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Pick up new result files, once each by content hash, and append them to ``target``; ends when all there are is read."""
    read = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    rows = read.select(F.sha2("value", 256).alias("digest"), F.from_json("value", schema).alias("doc")).where("doc is not null")

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["digest"])
        if spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target)):
            fresh = fresh.join(spark.read.parquet(target).select("digest"), "digest", "left_anti")
        fresh.write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of a stream by window and kind; changes later than ``late`` are let go."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
