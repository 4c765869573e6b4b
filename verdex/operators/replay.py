"""Replay of changes to sets of values, and groups dealt to parts of like size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


def replay_ranges(records: DataFrame, changes: DataFrame) -> DataFrame:
    """(cve_id, ranges, applied, unmatched): ``records(cve_id, ranges)`` after ``changes(cve_id, at_us, action, old_value, new_value)``.

    ``ranges`` is a JSON array of different texts; sorted when given back. Added takes its
    new value in unless it is there, Removed takes its old one out, Changed does both; a
    change that does anything is applied, a removal that finds nothing is unmatched.
    Changes go by time, then action and values. Whether a value is there when a change
    comes is what the last change of that value before it did: one window by key and value,
    so that no record's history has to fit one task. Changes of unknown records are left out.
    """
    base = records.select("cve_id", F.explode(F.from_json(F.coalesce("ranges", F.lit("[]")), "array<string>")).alias("value")).distinct()
    text = lambda c: F.coalesce(c, F.lit(""))
    known = changes.join(records.select("cve_id").distinct(), "cve_id", "left_semi")
    order = F.struct(F.col("at_us"), F.col("action"), text("old_value").alias("old"), text("new_value").alias("new"))
    named = known.select("cve_id", "action", "old_value", "new_value", order.alias("moment"), F.monotonically_increasing_id().alias("change"))
    named = staged(named, "replay-changes")
    out = named.where(F.col("action").isin("Removed", "Changed")).select("cve_id", text("old_value").alias("value"), "moment", F.lit(0).alias("phase"), F.lit(False).alias("there"), "change")
    into = named.where(F.col("action").isin("Added", "Changed") & (text("new_value") != "")).select("cve_id", F.col("new_value").alias("value"), "moment", F.lit(1).alias("phase"), F.lit(True).alias("there"), "change")
    first = base.select("cve_id", "value", F.lit(None).cast(named.schema["moment"].dataType).alias("moment"), F.lit(0).alias("phase"), F.lit(True).alias("there"), F.lit(None).cast("long").alias("change"))
    steps = first.unionByName(out).unionByName(into)
    ordered = Window.partitionBy("cve_id", "value").orderBy(F.col("moment").asc_nulls_first(), "change", "phase")
    steps = steps.withColumn("before", F.coalesce(F.lag("there").over(ordered), F.lit(False))).withColumn("last", F.lead("there").over(ordered).isNull())
    left = steps.where("last and there").groupBy("cve_id").agg(F.array_sort(F.collect_set("value")).alias("values"))
    done = steps.where("change is not null").groupBy("cve_id", "change").agg(F.bool_or(F.col("there") != F.col("before")).alias("hit"), F.count_if(~F.col("there") & ~F.col("before")).alias("missed"))
    counts = done.groupBy("cve_id").agg(F.count_if("hit").alias("applied"), F.sum("missed").alias("unmatched"))
    zero = F.lit(0).cast("long")
    joined = records.select("cve_id").distinct().join(left, "cve_id", "left").join(counts, "cve_id", "left")
    return joined.select("cve_id", F.to_json(F.coalesce("values", F.array().cast("array<string>"))).alias("ranges"), F.coalesce("applied", zero).alias("applied"), F.coalesce("unmatched", zero).alias("unmatched"))


def ranked(df: DataFrame, order: list[Column], parts: int = 200) -> DataFrame:
    """``df`` with ``rank``, each row's place from 0 on in an order that is total, without one task for all rows.

    Rows are dealt by ranges of the order and numbered inside each; only the ranges' counts
    meet in one window.
    """
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranked-ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return inside.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def balanced_parts(groups: DataFrame, parts: int, stratum: str | None = None) -> DataFrame:
    """(group, part): groups dealt to parts, largest first and to and fro; ``groups(group, size)``, by stratum if one is named.

    Any two parts differ by no more than the largest group of each stratum.
    """
    strata = F.col(stratum) if stratum else F.lit("")
    rows = ranked(groups.select("group", "size", strata.alias("_stratum")), [F.col("_stratum"), F.col("size").desc(), F.col("group")])
    start = rows.groupBy("_stratum").agg(F.min("rank").alias("_start"))
    turn = (F.col("rank") - F.col("_start")) % (2 * parts)
    return rows.join(start, "_stratum").select("group", F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn).cast("int").alias("part"))


def record_groups(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(record, group): records that share any key, directly or by others, are one group, named by its least member.

    For splits without leakage: a key is a column's value; null keys tie nothing.
    """
    from .graph import connected_components

    own = F.concat(F.lit("r:"), F.col(record).cast("string"))
    links = [records.where(F.col(k).isNotNull()).select(own.alias("a"), F.concat(F.lit(f"{k}:"), F.col(k).cast("string")).alias("b")) for k in keys]
    both = links[0]
    for more in links[1:]:
        both = both.unionByName(more)
    found = connected_components(both.distinct()).where(F.col("node").startswith("r:"))
    named = found.select(F.substring("node", 3, 1 << 20).alias(record), "component")
    least = named.groupBy("component").agg(F.min(F.struct(F.length(record).alias("n"), F.col(record))).alias("x")).select("component", F.col(f"x.{record}").alias("group"))
    grouped = named.join(least, "component").select(record, "group")
    every = records.select(F.col(record).cast("string").alias(record)).distinct()
    return every.join(grouped, record, "left").select(record, F.coalesce("group", record).alias("group"))


def stratum(bindings: Column, description: Column) -> Column:
    """Buckets by which splits are balanced: how many bindings, how long a description, what shape of ranges.

    ``bindings`` is an array<struct<..., version_ranges: array<struct<start, start_inclusive, end, end_inclusive>>>>.
    """
    n, length = F.coalesce(F.array_size(bindings), F.lit(0)), F.char_length(F.coalesce(description, F.lit("")))
    count = F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")
    size = F.when(length <= 512, "<=512").when(length <= 1024, "513-1024").when(length <= 2048, "1025-2048").otherwise("2049+")

    def shape(r: Column) -> Column:
        point = (r["start"] == r["end"]) & r["start_inclusive"] & r["end_inclusive"]
        return F.when(r["start"].isNull() & r["end"].isNull(), "no-version").when(F.coalesce(point, F.lit(False)), "exact").when(r["start"].isNull(), "upper").when(r["end"].isNull(), "lower").otherwise("bounded")

    shapes = F.array_distinct(F.flatten(F.transform(bindings, lambda b: F.transform(b["version_ranges"], shape))))
    form = F.when(n == 0, "empty-bindings").when(F.array_size(shapes) == 1, F.get(shapes, F.lit(0))).otherwise("mixed")
    return F.struct(count.alias("bindings"), size.alias("length"), form.alias("shape"))
