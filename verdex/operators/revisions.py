"""Current revisions of records, and what a change log says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], wanted: list[str] | None = None) -> DataFrame:
    """The row of each key that is greatest in ``order``, of the ``wanted`` columns (all by default).

    One aggregate with partial maxima: a key's rows never meet in one task, and only the
    wanted columns and the order are read.
    """
    wanted = wanted or df.columns
    row = F.struct(*[F.col(c) for c in wanted])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def content_duplicates(df: DataFrame, signature: Column, order: Column) -> DataFrame:
    """(signature, first, copies) of each distinct content; ``first`` is its least ``order``."""
    return df.groupBy(signature.alias("signature")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def content_variants(df: DataFrame, key: str, signature: Column) -> DataFrame:
    """Keys that occur with more than one content, and how many."""
    return df.groupBy(key).agg(F.count_distinct(signature).alias("variants")).where("variants > 1")


def change_state(log: DataFrame, key: str, at: Column, terminal: Column) -> DataFrame:
    """Of each key in a change log: number of changes, the latest one's time and the last terminal state.

    ``terminal`` is NULL on changes that don't settle a state; ``at`` orders changes and
    must end in something unique.
    """
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("changes"), F.max(at).alias("latest"), F.max_by(terminal, F.when(terminal.isNotNull(), at)).alias("terminal_state"), F.max(F.when(terminal.isNotNull(), at)).alias("terminal_at")
    )


def freshness(records: DataFrame, states: DataFrame, key: str, modified: Column, status: Column, latest_at: Column, terminal: Column, covered_to: Column | None = None) -> DataFrame:
    """Each record with ``decision``: what keeps it out, or ``current``.

    In this order: the record itself is rejected; the log's last terminal state is a
    rejection; the log has a change after the record's own time and what the snapshot
    covers. Records without log are current.
    """
    upto = modified if covered_to is None else F.greatest(modified, covered_to)
    decision = F.when(status == "rejected", "record_status_rejected").when(terminal == "rejected", "terminal_history_rejected").when(latest_at > upto, "stale_after_history").otherwise("current")
    return records.join(states, key, "left").withColumn("decision", decision)


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that have no partner: log without record, observation without assertion."""
    return left.join(right, keys, "left_anti")


def active_after(log: DataFrame, keys: list[str], at: Column, added: Column, removed: Column) -> DataFrame:
    """Keys that were added and not removed since."""
    last = log.groupBy(*keys).agg(F.max(F.when(added, at)).alias("added_at"), F.max(F.when(removed, at)).alias("removed_at"))
    return last.where(F.col("added_at").isNotNull() & (F.col("removed_at").isNull() | (F.col("added_at") > F.col("removed_at"))))


def with_overrides(base: DataFrame, overrides: DataFrame, keys: list[str], trusted: Column, newest: list[Column] | None = None, present: Column | None = None) -> DataFrame:
    """Trusted overrides, and of the base what no trusted override replaces.

    With ``newest`` only the newest override of a key counts, so that a newer untrusted one
    takes an older trusted one out. An override for which ``present`` is false replaces the
    base with nothing.
    """
    strong = overrides.where(trusted) if newest is None else latest(overrides.withColumn("_trusted", trusted), keys, newest).where("_trusted").drop("_trusted")
    shown = strong if present is None else strong.where(present)
    return shown.unionByName(base.join(strong.select(*keys).distinct(), keys, "left_anti"))


def shard_gaps(df: DataFrame, index: Column, shards: int) -> DataFrame:
    """Of each shard (index modulo shards): count, least, greatest, and whether its indexes are dense."""
    out = df.groupBy(F.pmod(index, F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"))
    return out.withColumn("dense", F.col("n") == F.expr(f"(high - low) div {shards}") + 1)
