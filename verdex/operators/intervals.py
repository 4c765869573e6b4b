"""Intervals in one order: merging, relations of sets of them, runs and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], lower: str, upper: str) -> DataFrame:
    """Union of closed intervals by key: those that overlap or touch become one, with the number of parts."""
    ordered = Window.partitionBy(*keys).orderBy(lower, upper)
    before = F.max(upper).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(lower) > before), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper), F.count(F.lit(1)).alias("parts")).drop("_island")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], lower: str, upper: str) -> DataFrame:
    """Pairs of intervals of a key that share a point: an equi-join with the overlap as its residue."""
    a = left.select(*keys, F.col(lower).alias("left_lower"), F.col(upper).alias("left_upper"))
    b = right.select(*keys, F.col(lower).alias("right_lower"), F.col(upper).alias("right_upper"))
    return a.join(b, keys).where("left_lower <= right_upper and right_lower <= left_upper")


def set_relation(left: DataFrame, right: DataFrame, keys: list[str], lower: str, upper: str) -> DataFrame:
    """How the left set of closed intervals of a key relates to the right one.

    equal, left_broader, right_broader, partial_overlap, disjoint, or one_sided where one has none.
    """
    a, b = merge_intervals(left, keys, lower, upper), merge_intervals(right, keys, lower, upper)
    touch = overlapping(a, b, keys, lower, upper)
    hits = touch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_distinct(F.when(F.expr("left_lower >= right_lower and left_upper <= right_upper"), F.struct("left_lower", "left_upper"))).alias("left_inside"),
        F.count_distinct(F.when(F.expr("right_lower >= left_lower and right_upper <= left_upper"), F.struct("right_lower", "right_upper"))).alias("right_inside"),
    )
    n_a, n_b = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    both = n_a.join(n_b, keys, "full").join(hits, keys, "left")
    inside_left, inside_right = F.coalesce("left_inside", F.lit(0)) == F.col("n_left"), F.coalesce("right_inside", F.lit(0)) == F.col("n_right")
    relation = (
        F.when(F.col("n_left").isNull() | F.col("n_right").isNull(), "one_sided")
        .when(inside_left & inside_right, "equal")
        .when(inside_right, "left_broader")
        .when(inside_left, "right_broader")
        .when(F.col("hits") > 0, "partial_overlap")
        .otherwise("disjoint")
    )
    return both.select(*keys, relation.alias("relation"))


def runs(df: DataFrame, keys: list[str], order: list[str], verdict: Column) -> DataFrame:
    """Maximal runs of one verdict in order: verdict, first and last of the order, and length."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_verdict", verdict)
    marked = marked.withColumn("_change", F.when(F.col("_verdict").eqNullSafe(F.lag("_verdict").over(ordered)) & (F.row_number().over(ordered) > 1), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_change").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct(*order)
    return marked.groupBy(*keys, "_run").agg(F.first("_verdict").alias("verdict"), F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value before and after it in its series."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(f"previous_{value}", F.lag(value).over(ordered)).withColumn(f"next_{value}", F.lead(value).over(ordered))


def range_state(lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """ok, inverted_bounds, or degenerate_empty_range for equal ends of which one is open."""
    return F.when(lower > upper, "inverted_bounds").when((lower == upper) & ~(lower_inclusive & upper_inclusive), "degenerate_empty_range").otherwise("ok")


def fold_intervals(intervals: Column) -> Column:
    """Merge of an array<struct<lower, upper>> within a row, without leaving it."""
    empty = F.slice(intervals, F.lit(1), F.lit(0))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lower"].alias("lower"), F.greatest(last["upper"], x["upper"]).alias("upper"))))
        return F.when((F.size(done) > 0) & (x["lower"] <= last["upper"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.when(F.size(intervals) == 0, intervals).otherwise(F.aggregate(F.array_sort(intervals), empty, lambda d, x: F.when(F.size(d) == 0, F.array(x)).otherwise(step(d, x))))


def fixed_by_series(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, series, fixed): the greatest verified fixed version of each series, as text; all patches must be in.

    ``boundaries(keys, series, fixed, verification)``; a boundary counts if nothing or ``ok`` is said of its verification.
    """
    good = boundaries.where(F.coalesce("verification", F.lit("ok")) == "ok").where(F.coalesce("fixed", F.lit("")) != "")
    return good.groupBy(*keys, "series").agg(F.max("fixed").alias("fixed"))
