"""Graphs given as tables of links: components, bounded paths, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.skew import hot_keys, salted_join
from ..plans.staging import delete, fresh_dir, gathered


def connected_components(links: DataFrame, max_rounds: int = 60, n: int | None = None) -> DataFrame:
    """(node, component) for the nodes of ``links(a, b)``; component is the smallest node reachable.

    In every round each node takes the least of its label, its neighbours' labels, its
    label's label, and the least label that any node of its label meets; so chains shorten
    by powers, whatever their order. A round is one write to the shared folder, which also
    counts what changed; no link ever reaches the driver. Nodes with many links and labels
    with many nodes are dealt to several tasks. Links with a null end or to themselves only
    yield their node. Where it is known that there are some ``n`` links, few files are written.
    """
    spark = links.sparkSession
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(fresh_dir(spark, "components"))
        (df if n is None else gathered(df, n)).write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    links = links.where("a is not null and b is not null").select("a", "b")
    both = keep(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, "b", both.count())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    total = labels.count()
    for _ in range(max_rounds):
        met = salted_join(both, labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b", hubs, F.col("a"))
        seen = labels.join(met.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")), "node")
        hooks = seen.groupBy(F.col("component").alias("_label")).agg(F.min("near").alias("hook"))
        roots = labels.select(F.col("node").alias("_label"), F.col("component").alias("far")).join(hooks, "_label")
        roots = roots.select(F.col("_label").alias("component"), F.least("far", "hook").alias("jump"))
        moved = salted_join(seen, roots, "component", hot_keys(labels, "component", total), F.col("node"))
        changes = Observation()
        least = F.least("component", "near", "jump")
        new = moved.select("node", least.alias("component"), (least != F.col("component")).alias("moved")).observe(changes, F.count_if("moved").alias("n"))
        labels = keep(new.drop("moved"))
        for path in made[1:-1]:
            delete(spark, path)
        del made[1:-1]
        if not total or not changes.get["n"]:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def best_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, tier, length): the best way from each start to each node in ``hops`` links at most.

    A way is as good as its worst link's ``tier``, then as short as it can be;
    ``edges(a, b, tier)`` go both ways. One join and one aggregate a hop.
    """
    both = edges.select("a", "b", "tier").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "tier")).distinct()
    found = starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("tier"), F.lit(0).alias("length"))
    for _ in range(hops):
        onward = found.join(both.withColumnRenamed("tier", "link"), found["node"] == F.col("a")).select("start", F.col("b").alias("node"), F.greatest("tier", "link").alias("tier"), (F.col("length") + 1).alias("length"))
        best = found.unionByName(onward).groupBy("start", "node").agg(F.min(F.struct("tier", "length")).alias("best"))
        found = best.select("start", "node", "best.tier", "best.length")
    return found


def mutually_unique(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs of which neither side is in another pair."""
    one = lambda c: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(c)
    return pairs.join(one(left), left, "left_semi").join(one(right), right, "left_semi")


def component_summary(members: DataFrame, distinct_pairs: DataFrame | None = None, largest: int = 8) -> DataFrame:
    """(component, size, status): review for components over ``largest`` or with two nodes that are known to differ."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    status = F.when(F.col("size") > largest, "review_size").otherwise("accepted")
    if distinct_pairs is not None:
        a, b = members.select(F.col("node").alias("a"), F.col("component")), members.select(F.col("node").alias("b"), F.col("component").alias("component_b"))
        hard = distinct_pairs.select("a", "b").join(a, "a").join(b, "b").where("component = component_b").select("component").distinct().withColumn("_hard", F.lit(True))
        sizes = sizes.join(hard, "component", "left")
        status = F.when(F.col("_hard"), "review_conflict").otherwise(status)
    return sizes.select("component", "size", status.alias("status"))
