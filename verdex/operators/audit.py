"""Audits: named counts of violations that must all be zero, each in as few scans as it takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_audits(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(audit, violations) of any number of row conditions, fused into one scan; an unknown condition is a violation."""
    counted = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(n) for n, ok in checks.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("audit"), F.col(f"`{n}`").alias("violations")) for n in checks])).alias("x")).select("x.*")


def key_audit(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("audit"), "violations")


def reference_audit(name: str, df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is stated but has no target."""
    missing = df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("audit"), "violations")


def all_audits(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ratio_gate(df: DataFrame, name: str, good: Column, least: float) -> DataFrame:
    """(gate, share, passed): the share of good rows against a least one; no rows fail."""
    share = F.coalesce(F.try_divide(F.count(F.when(good, 1)).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
    return df.agg(share.alias("share")).select(F.lit(name).alias("gate"), "share", (F.col("share") >= least).alias("passed"))


def refuse_violations(audits: DataFrame) -> None:
    """Raise if any audit has violations; only those few rows come to the driver."""
    bad = {r["audit"]: r["violations"] for r in audits.where("violations > 0").collect()}
    if bad:
        raise ValueError(f"audits failed: {bad}")


def share_audit(name: str, df: DataFrame, good: Column, least: float | None = None, most: float | None = None, complete: bool = True) -> DataFrame:
    """One violation if the share of good rows is under ``least`` or over ``most``; no rows, or a build that is not complete, have none."""
    n, k = F.count(F.lit(1)), F.count_if(F.coalesce(good, F.lit(False)))
    off = (k < least * n) if least is not None else (k > most * n)
    return df.agg(F.when((n > 0) & off & F.lit(complete), 1).otherwise(0).cast("long").alias("violations")).select(F.lit(name).alias("audit"), "violations")


#: Statuses under which an assertion counts.
COUNTED = ("active", "conflict_review")


def assertion_audits(assertions: DataFrame) -> DataFrame:
    """The audits of stored assertions beside their claims, in one scan.

    Columns: source_family, reconciliation, max_result_state, version_class, indexed, llm_claim,
    role, role_basis, is_default, default_status, default_raw, default_inferred, vulnerable,
    polarity, range_fields, claim_class, claim_version, comparison, reconciled_comparison.
    """
    c = F.col
    counted = c("reconciliation").isin(*COUNTED)
    model = c("source_family") == "llm_description"
    no_range, ranged = c("range_fields") == 0, ("BOUNDED_RANGE", "UNBOUNDED_RANGE", "UNPARSED")
    capped = c("max_result_state").eqNullSafe("potentially_affected")
    any_class = c("version_class") == "CPE_ANY_UNCORROBORATED"
    bad = {
        "A-LLM-VERSION-BINDING": model & counted & (~capped | c("indexed") | c("llm_claim").isNull()),
        "A-CPE-ANY-CEILING": any_class & ~capped,
        "A-CPE-ANY-INDEX": any_class & c("indexed"),
        "A-CPE-ROLE-UPSTREAM": c("role").startswith("DOWNSTREAM_") & c("indexed"),
        "A-CPE-ROLE-UNRESOLVED": (c("role") == "UNRESOLVED") & c("indexed"),
        "A-CPE-ROLE-COVERAGE": (c("source_family") == "nvd_cpe") & counted & (c("role").isNull() | c("role_basis").isNull()),
        "A-UNSPECIFIED-INDEX": (c("version_class") == "UNSPECIFIED") & c("indexed"),
        "A-DEFAULTSTATUS-UNKNOWN-ASSERTION": (c("source_family") == "cna_structured") & c("is_default") & (c("default_status") == "unknown"),
        "A-CONFIG-VULNERABLE-FALSE": ~c("vulnerable") & (c("polarity") == "affected"),
        "A-DEFAULTSTATUS-OMITTED": (c("source_family") == "cna_structured") & c("default_raw").isNull() & c("default_inferred") & (c("default_status") == "unaffected"),
        "A-CPE-RANGE-FIELDS": (c("source_family") == "nvd_cpe") & (c("claim_version") == "*") & F.when(no_range, c("claim_class") != "CPE_ANY_UNCORROBORATED").otherwise(~c("claim_class").isin(*ranged)),
        "A-IDENTITY-ROLE-RECONCILIATION-DRIFT": c("comparison") != c("reconciled_comparison"),
    }
    return domain_audits(assertions, {name: ~F.coalesce(cond, F.lit(False)) for name, cond in bad.items()})


def segment_audits(segments: DataFrame) -> DataFrame:
    """The audits of stored segments (exact, lower, upper, version_kind, claim_class, start_stated, end_stated), in one scan."""
    c = F.col
    signed = lambda x: F.coalesce(x, F.lit("")).rlike("[<>=!]")
    bad = {
        "A-VERSION-EXACT-COMPARATOR": F.coalesce(c("exact"), F.lit("")).rlike("^[<>=!]"),
        "A-WILDCARD-KIND": c("version_kind") == "wildcard",
        "A-CPE-RANGE-SEGMENTS": c("claim_class").isin("BOUNDED_RANGE", "UNBOUNDED_RANGE") & ((c("start_stated") & c("lower").isNull()) | (c("end_stated") & c("upper").isNull())),
        "A-COMPARATOR-BOUND": signed(c("lower")) | signed(c("upper")),
    }
    return domain_audits(segments, {name: ~F.coalesce(cond, F.lit(False)) for name, cond in bad.items()})


def alias_audits(edges: DataFrame) -> DataFrame:
    """The audits of alias edges (tier, status, basis as JSON text), in one scan: no evidence, a basis of another form, weak evidence accepted."""
    c = F.col
    basis = F.from_json("basis", "format string, evidence array<string>, evidence_count bigint, evidence_examples_limit bigint, evidence_truncated boolean")
    whole = (
        F.coalesce(basis["format"] == "bounded_evidence_v1", F.lit(False)) & basis["evidence"].isNotNull() & basis["evidence_count"].isNotNull() & (basis["evidence_examples_limit"] == 32)
        & basis["evidence_truncated"].isNotNull() & (F.size(basis["evidence"]) <= 32) & (basis["evidence_count"] >= F.size(basis["evidence"]))
    )
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    bad = {"A-ALIAS-MISSING-EVIDENCE": empty(c("tier")) | empty(c("basis")), "A-ALIAS-BASIS-ENVELOPE": ~F.coalesce(whole, F.lit(False)), "A-ALIAS-E4-ACCEPTED": (c("tier") == "E4") & (c("status") == "accepted")}
    return domain_audits(edges, {name: ~F.coalesce(cond, F.lit(False)) for name, cond in bad.items()})


def cluster_audits(members: DataFrame, edges: DataFrame, distinct_pairs: DataFrame, largest: int = 8) -> DataFrame:
    """The audits of identity clusters.

    ``members(cluster, node, review_state, strict)``, ``edges(cluster, status, strict)`` those
    inside clusters, ``distinct_pairs(a, b)`` nodes that must not be one.
    """
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("audit"), "violations")
    side = lambda x: members.select(F.col("node").alias(x), F.col("cluster").alias(f"cluster_{x}"))
    together = distinct_pairs.join(side("a"), "a").join(side("b"), "b").where("cluster_a = cluster_b")
    sizes = members.groupBy("cluster").agg(F.count_distinct("node").alias("n"), F.min("review_state").alias("state"), F.bool_or("strict").alias("strict"))
    loose = edges.where(~F.col("strict")).select("cluster").distinct()
    return all_audits([
        count("A-ALIAS-HARD-DISTINCT-CLUSTER", together),
        count("A-ALIAS-NONACCEPTED-IN-CLUSTER", edges.where("status <> 'accepted'")),
        count("A-ALIAS-OVERSIZE-NOT-REVIEW", sizes.where((F.col("n") > largest) & (F.col("state") == "ok"))),
        count("A-ALIAS-STRICT-CONTAMINATION", sizes.where("strict").join(loose, "cluster", "left_semi")),
    ])


def publish_state(audits: DataFrame, built: Column | None = None) -> DataFrame:
    """(state, failed): published where no audit has a violation, else draft with the failed audits' names, sorted."""
    failed = F.array_sort(F.collect_list(F.when(F.col("violations") > 0, F.col("audit"))))
    out = audits.agg(failed.alias("failed"))
    ready = (F.size("failed") == 0) if built is None else (F.size("failed") == 0) & built
    return out.select(F.when(ready, "published").otherwise("draft").alias("state"), "failed")
