from __future__ import annotations

import random

from pyspark.sql import functions as F

from verdex.operators import mapping, repository


def tables(spark, odd):
    rng = random.Random(3)
    kinds, words = ["a", "o", "h", "*", "unknown", "x", None], ["tool", "tool_driver", "java_driver", "python_driver_tool", "gear", "cli_gear", None]
    products = [(i, "v", rng.choice(words), rng.choice(kinds)) for i in range(60)]
    repositories = [(f"r{i}", "v", rng.choice(words)) for i in range(12)]
    if odd:
        products += [(i, "v", rng.choice(words), rng.choice(kinds)) for i in range(0, 60, 3)] + products[:5]
        repositories += [(f"r{i}", "v", rng.choice(words)) for i in range(0, 12, 4)]
    candidates = [(f"r{rng.randrange(12)}", rng.randrange(60), "exact_pair") for _ in range(60)]
    members = [(i % 3, i) for i in range(60)] + [(0, 1), (1, 1)]
    evidence = [(f"r{rng.randrange(12)}", rng.randrange(60)) for _ in range(25)]
    blocked = [(a, a + 3 * rng.randrange(1, 6)) for a in range(50)] + [(9, 3)]
    make = spark.createDataFrame
    return (
        make(candidates, "repo_key string, product_id long, method string"), make(members, "cluster_id long, product_id long"), make(evidence, "repo_key string, product_id long"), make(blocked, "a long, b long"),
        make(products, "product_id long, vendor_key string, product_key string, part string"), make(repositories, "repo_key string, owner_key string, name_key string"),
    )


def one_by_one(candidates, members, evidence, blocked, products, repositories):
    c = F.col
    seen = evidence.join(members, "product_id").select("repo_key", "cluster_id").distinct()
    anchors = candidates.join(members, "product_id").join(seen, ["repo_key", "cluster_id"], "left_semi").select("repo_key", "cluster_id", c("product_id").alias("anchor_id"))
    pairs = anchors.join(members, "cluster_id").where("product_id <> anchor_id").withColumns({"a": F.least("anchor_id", "product_id"), "b": F.greatest("anchor_id", "product_id")}).join(blocked, ["a", "b"], "left_anti")
    pairs = pairs.join(products.select("product_id", "part", "product_key"), "product_id").join(products.select(c("product_id").alias("anchor_id"), c("part").alias("anchor_part")), "anchor_id").join(repositories, "repo_key")
    return pairs.where(mapping.part_compatible(c("anchor_part"), c("part"))).select("repo_key", "product_id", "anchor_id", "cluster_id", repository.artifact_conflict(c("name_key"), c("product_key")).alias("reason")).distinct()


def test_cluster_expansion_gives_each_pair_once(spark):
    for odd in (False, True):
        given = tables(spark, odd)
        got, want = ([tuple(r) for r in f(*given).collect()] for f in (repository.cluster_expansion, one_by_one))
        assert len(want) > 100 and any(r[-1] for r in want)
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pairs_of_a_cluster_are_not_dealt_anew(spark):
    plan = repository.cluster_expansion(*tables(spark, False))._jdf.queryExecution().optimizedPlan().toString()
    # The sides are read as they were staged; one join makes the pairs.
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_words_of_names_meet_as_they_did(spark):
    rows = [("java_driver", "python_driver", "artifact_language_mismatch"), ("java_driver", "java_driver", None), ("gear_cli", "gear", "repo_is_distinct_artifact"), ("gear_cli", "gear_docs", "artifact_role_mismatch"), ("cli_docs_cli", "docs_cli", None), ("gear", "gear_docs", None), ("gear", None, None), (None, "gear", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = {r["i"]: r["x"] for r in df.select("i", repository.artifact_conflict(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [want for *_, want in rows]


def test_compatible_kinds_are_listed(spark):
    kinds = ["a", "o", "h", "*", "unknown", "x", "y", None]
    df = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string")
    listed = F.coalesce(F.array_contains(mapping.compatible_parts(F.col("a")), F.col("b")), F.lit(False))
    assert df.where(listed != F.coalesce(mapping.part_compatible(F.col("a"), F.col("b")), F.lit(False))).count() == 0
