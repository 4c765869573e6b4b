"""Joins whose keys may be hot: a key that holds many rows is dealt to several tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: At most this many keys are called hot, whatever the table: so many bound the list that goes to all tasks.
HOT_KEYS = 20_000
#: Rows that no key needs to be split for.
HOT_ROWS = 1000


def hot_limit(total: int) -> int:
    """Rows beyond which a key is hot: a share of the table that HOT_KEYS keys at most can reach."""
    return max(HOT_ROWS, total // HOT_KEYS)


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, _salts): the keys with more than :func:`hot_limit` of ``total`` rows, and among how many tasks each is dealt; none if there are none."""
    if total <= hot_limit(total):
        return None
    return hot_counts(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n", total)


def hot_counts(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """:func:`hot_keys` where the keys are counted already. HOT_KEYS bounds what comes to the driver."""
    limit = hot_limit(total)
    if total <= limit:
        return None
    found = counts.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_salts"))
    hot = found.collect()
    return counts.sparkSession.createDataFrame(hot, found.schema) if hot else None


def salted_join(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame | None, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` by ``key``, rows of a hot key dealt by ``spread``, what they meet repeated for each part.

    Only the list of hot keys is broadcast; without any, this is the plain join. ``how`` may
    be inner or left.
    """
    if hot is None:
        return rows.join(other, key, how)
    hot = F.broadcast(hot)
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def on_distinct(rows: DataFrame, values: dict[str, Column], make: Callable[[DataFrame], DataFrame], out: str, spread: Column) -> DataFrame:
    """``rows`` with ``out``, which ``make`` adds to a table of the distinct ``values``: made once for each, then joined back, nulls as equal.

    For what costs far more to make than to join. Values that many rows share are dealt by ``spread``.
    """
    rows = rows.withColumn("_values", F.struct(*[v.alias(n) for n, v in values.items()]))
    counts = staged(rows.groupBy("_values").agg(F.count(F.lit(1)).alias("_n")), "distinct")
    hot = hot_counts(counts, "_values", "_n", counts.agg(F.sum("_n")).first()[0] or 0)
    made = make(counts.select("_values", "_values.*")).select("_values", out)
    return salted_join(rows, made, "_values", hot, spread).drop("_values")


def first_values(rows: DataFrame, group: list[str], value: str, most: int, name: str) -> DataFrame:
    """(group, name): the ``most`` least distinct values of each group, sorted.

    The rank is cut before rows are shuffled as well as after, so that no group's values
    meet in one task beyond that many from each.
    """
    ranked = rows.select(*group, value).where(F.col(value).isNotNull()).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    return ranked.where(F.col("_rank") <= most).groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias(name))
