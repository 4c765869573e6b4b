"""Predictions against gold: rates, groupings, differences, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn in one row, or one a group of a grouped frame."""
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(count(gold & predicted).alias("tp"), count(~gold & predicted).alias("fp"), count(gold & ~predicted).alias("fn"), count(~gold & ~predicted).alias("tn"))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def f_score(precision: Column, recall: Column, beta: float) -> Column:
    weight = beta * beta
    return ratio((1 + weight) * precision * recall, weight * precision + recall)


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    for name, beta in (("f05", 0.5), ("f1", 1.0), ("f2", 2.0)):
        out = out.withColumn(name, f_score(F.col("precision"), F.col("recall"), beta))
    return out.withColumn("jaccard", ratio(tp, tp + fp + fn)).withColumn("false_discovery", ratio(fp, tp + fp)).withColumn("miss_rate", ratio(fn, tp + fn))


def set_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Rates of each case whose labels are arrays, and whether the sets are equal."""
    both = F.size(F.array_intersect(gold, predicted))
    out = df.withColumn("tp", both).withColumn("fp", F.size(F.array_except(predicted, gold))).withColumn("fn", F.size(F.array_except(gold, predicted)))
    return with_rates(out).withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def aggregate_cases(cases: DataFrame) -> DataFrame:
    """Micro rates from summed counts, macro means, and the error of the number of predictions."""
    off = (F.col("fp") - F.col("fn")).cast("double")
    total = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.col("exact").cast("double")).alias("exact_share"),
    )
    return with_rates(total)


def grouped_rates(df: DataFrame, groups: list[str], good: Column) -> DataFrame:
    """Count, successes and rate over all, by each group and by all of them together."""
    sets = [[], *[[F.col(g)] for g in groups], [F.col(g) for g in groups]]
    found = df.withColumn("_good", good).groupingSets(sets, *groups).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_good"), 1)).alias("good"), F.grouping_id().cast("int").alias("level"))
    return found.withColumn("rate", ratio(F.col("good"), F.col("n")))


def prediction_difference(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or same, by key."""
    a, b = old.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, "old", "new", change.alias("change"))


def distribution(df: DataFrame, keys: list[str], value: str, other: str | None = None) -> DataFrame:
    """Count, mean, deviation, linear and nearest-rank percentiles, and correlation with another column."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")]
    aggs += [F.expr(f"percentile({value}, {p})").alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    aggs.append(F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90_disc"))
    if other:
        aggs.append(F.corr(value, other).alias("correlation"))
    return df.groupBy(*keys).agg(*aggs)


def matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row with one column a value, and each one's share of the row."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v.lower()}") for v in values]
    out = df.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.select("*", *[ratio(F.col(f"n_{v.lower()}"), F.col("total")).alias(f"share_{v.lower()}") for v in values])


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key)).limit(k)
