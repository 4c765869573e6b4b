from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from verdex.operators import answer, applicability, ranges

REQUESTS = "request long, product string, version string, part_state string, part_value string"
SAID = "product string, subject long, claim_group string, is_default boolean, v string, lt string, le string, t string, branch_coverage string, cpe_match_role string, configuration boolean, part_state string, part_values array<string>, source_family string, polarity string, reconciliation string, max_result_state string, identity_provisional boolean"
SUBJECTS = [(i, ("enriched", "rejected", "unenriched", "enriched")[i], i == 3, (None, "prefer_latest_cpe", "accept_added_range", None)[i], (None, "why", "why", None)[i]) for i in range(4)]
AXES = ["part"]


def tables(spark, pairs, several=False):
    rng = random.Random(5)
    pick = rng.choice
    version = lambda: pick(["1.0.1", "1.0.2k", "1.1.0", "2", "2.5", "3.0.1", "3.0.2a", "1.2.3-rc1", "1.2.3", "1:2.0-1", "2.0~beta-1", "r12", "next", "7.x", "1.0.*", "", "*", "n/a", "01", None])
    asked = [(i, f"{pick(['openssl', 'tool'])}{rng.randrange(3)}", version(), pick(["EXACT", "ANY", "NOT_APPLICABLE", "UNKNOWN", None]), pick(["a", "o", "h", None])) for i in range(pairs)]
    if several:
        asked += [(i, f"tool{(i + 1) % 3}", *rest) for i, _, *rest in asked[: pairs // 2]]
    said = [(
        f"{pick(['openssl', 'tool'])}{rng.randrange(3)}", rng.randrange(4), str(rng.randrange(3)), rng.random() < 0.3, version(), pick([None, None, version()]), pick([None, None, None, version()]), pick([None, "semver", "deb", "dotted"]),
        pick(["complete", "partial", None]), pick(["DIRECT_UPSTREAM", "UNRESOLVED", "REQUIRED_PLATFORM", None]), pick([True, True, False, None]), pick(["ANY", "SET", "EXACT", "NOT_APPLICABLE", "UNKNOWN"]), pick([["a", "o"], [], ["h"]]),
        pick(["nvd_cpe", "cna_structured", "llm_description", "osv", None]), pick(["affected", "unaffected", "unknown", None]), pick(["none", "none", "none", "conflict_review", None]), pick(["affected", "potentially_affected", None]), pick([False, True, None]),
    ) for _ in range(90)]
    df = spark.createDataFrame(said, SAID)
    stored = ranges.compile_stated(df, F.col("v"), F.col("lt"), F.col("le"), F.col("t"), F.col("product"))
    return spark.createDataFrame(asked, REQUESTS), stored, spark.createDataFrame(SUBJECTS, "subject long, enrichment string, provisional boolean, history_action string, history_basis string")


def found(df):
    return sorted((r["request"], r["subject"], r["state"], tuple(r["reasons"])) for r in df.collect())


@pytest.mark.parametrize("several", [False, True])
def test_answers_are_those_of_each_pair_by_itself(spark, several):
    requests, stored, subjects = tables(spark, 120, several)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    spanned = answer.branch_span(stored, ["product", "subject", "claim_group"])
    pairs = answer.closed(answer.evaluated(requests, spanned, AXES), ["request", "subject", "claim_group"])
    about = requests.select("request", "product").join(stored.select("product", "subject").distinct(), "product").select("request", "subject").distinct().join(subjects, "subject", "left")
    want = found(applicability.finalize(pairs.drop("version").withColumn("version", F.col("found.truth")), about, ["request", "subject"]))
    got = found(answer.answers(requests, stored, subjects, AXES))
    assert len(got) > 300 and len({s for _, _, s, _ in got}) > 6
    assert got == want


def test_answers_of_a_claim_group_without_a_name(spark):
    requests, stored, subjects = tables(spark, 5)
    one = stored.where("part_state = 'ANY' and configuration and subject = 0").limit(1)
    named = one.withColumns({"v": F.lit("2"), "claim_group": F.lit("g"), "source_family": F.lit("osv"), "polarity": F.lit("affected"), "product": F.lit("p"), "reconciliation": F.lit("none"), "is_default": F.lit(False)})
    asked = spark.createDataFrame([(1, "p", "2", "ANY", None)], REQUESTS)
    assert found(answer.answers(asked, named.withColumn("claim_group", F.lit(None).cast("string")), subjects, AXES)) == found(answer.answers(asked, named, subjects, AXES))


def test_no_pair_is_shuffled_or_sent_to_python(spark):
    requests, stored, subjects = tables(spark, 50)
    out = answer.answers(requests, spark.createDataFrame(stored.collect(), stored.schema), subjects, AXES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "claim_group" in plan
    assert not re.search(r"hashpartitioning\([^)]*request#[^)]*claim_group#", plan)
    optimized = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    join = next(i for i, line in enumerate(optimized) if re.search(r"Join Inner, \(product#", line))
    assert not any("EvalPython" in line and depth(line) < depth(optimized[join]) for line in optimized[:join])


def test_reasons_and_their_numbers():
    assert set(ranges.REASON_CODES) >= {reason for _, reason in ranges.BY_CLASS.values()}
    assert len(answer._REASONS) < answer._FIRM
