from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdex.functions import text as T
from verdex.operators import applicability, mapping, revisions
from verdex.sources import records

FACTS = "k string, source_family string, polarity string, role boolean, scope boolean, configuration boolean, version boolean, predicate boolean, version_reason string, reconciliation string, max_result_state string, identity_provisional boolean"


def fact(source, polarity, predicate, *, role=True, scope=True, configuration=True, version="same", reason="in_range", review="none", cap="affected", alias=False):
    return ("k", source, polarity, role, scope, configuration, predicate if version == "same" else version, predicate, reason, review, cap, alias)


NVD, CNA, LLM = "nvd_cpe", "cna_structured", "llm_description"
CASES = [
    ([], {}, "product_only_observation", ["no_active_assertion"]),
    ([fact(NVD, "affected", True)], {"enrichment": "rejected"}, "insufficient_data", ["rejected_upstream"]),
    ([fact(NVD, "affected", True)], {}, "affected", ["in_range"]),
    ([fact(NVD, "affected", True)], {"provisional": True}, "potentially_affected", ["in_range"]),
    ([fact(NVD, "affected", True, cap="potentially_affected")], {}, "potentially_affected", ["in_range"]),
    ([fact(NVD, "affected", True, alias=True)], {}, "potentially_affected", ["identity_alias_provisional", "in_range"]),
    ([fact("osv", "affected", None, review="conflict_review"), fact(NVD, "affected", True)], {}, "conflict_review", ["authoritative_source_conflict"]),
    ([fact("osv", "affected", False, review="conflict_review"), fact(NVD, "affected", True)], {}, "affected", ["in_range"]),
    ([fact(NVD, "affected", True), fact(NVD, "unaffected", True)], {}, "conflict_review", ["source_family_internal_conflict"]),
    ([fact(NVD, "affected", True), fact(CNA, "affected", False)], {}, "conflict_review", ["nvd_cna_result_conflict"]),
    ([fact(NVD, "affected", True), fact(CNA, "unaffected", True)], {"action": "prefer_latest_cpe"}, "affected", ["history_latest_cpe_affected", "why"]),
    ([fact(NVD, "unaffected", True), fact(CNA, "affected", True)], {"action": "prefer_latest_cpe"}, "not_affected_asserted", ["history_latest_cpe_unaffected", "why"]),
    ([fact(NVD, "affected", False), fact(CNA, "affected", True)], {"action": "prefer_latest_cpe"}, "not_affected_out_of_range", ["history_latest_cpe_out_of_range", "why"]),
    ([fact(NVD, "affected", False), fact(CNA, "affected", True)], {"action": "accept_added_range"}, "affected", ["history_added_range_accepted", "why"]),
    ([fact(NVD, "affected", False, reason="below"), fact(CNA, "unaffected", True, reason="stated")], {}, "not_affected_asserted", ["stated"]),
    ([fact(NVD, "affected", False, reason="below"), fact(LLM, "affected", True)], {}, "not_affected_out_of_range", ["below"]),
    ([fact(LLM, "affected", True, reason="told")], {}, "affected", ["told"]),
    ([fact("osv", "affected", True), fact("ghsa", "unaffected", True)], {}, "conflict_review", ["active_polarity_conflict"]),
    ([fact(NVD, "affected", None, reason="unclear"), fact(CNA, "affected", False, reason="above")], {}, "potentially_affected", ["unclear"]),
    ([fact(NVD, "unaffected", None, reason="unclear")], {}, "product_only_observation", ["no_positive_assertion"]),
    ([fact(NVD, "unaffected", None, reason="unclear")], {"enrichment": "unenriched"}, "insufficient_data", ["nvd_unenriched"]),
    ([fact(NVD, "affected", False, reason="version_not_applicable")], {}, "not_applicable", ["version_not_applicable"]),
    ([fact(NVD, "affected", False, scope=False, version=True)], {}, "not_applicable", ["scope_or_configuration_false"]),
    ([fact(NVD, "affected", False, configuration=False, version=False), fact(CNA, "affected", False, reason="above")], {}, "not_affected_out_of_range", ["above"]),
    ([fact(NVD, "affected", False, role=False, version=True)], {}, "product_only_observation", ["no_positive_assertion"]),
]


def test_final_states(spark):
    facts, subjects = [], []
    for i, (rows, subject, _, _) in enumerate(CASES):
        facts += [(str(i), *r[1:]) for r in rows]
        subjects.append((str(i), subject.get("enrichment", "enriched"), subject.get("provisional", False), subject.get("action"), "why"))
    df = spark.createDataFrame(subjects, "k string, enrichment string, provisional boolean, history_action string, history_basis string")
    got = {int(r["k"]): (r["state"], r["reasons"]) for r in applicability.finalize(spark.createDataFrame(facts, FACTS), df, ["k"]).collect()}
    for i, (_, _, state, reasons) in enumerate(CASES):
        assert got[i] == (state, reasons), CASES[i]


@pytest.mark.parametrize("rows, want", [
    ([fact(NVD, "unknown", True)], None), ([fact(NVD, "unknown", None)], "unknown"), ([fact(NVD, "unaffected", None)], None), ([fact(NVD, "affected", False)], "out_of_range"),
    ([fact(NVD, "affected", True, role=False)], None), ([fact(NVD, "affected", True, scope=None)], "affected"), ([fact(NVD, "affected", False), fact(NVD, "unaffected", None)], None),
])
def test_source_results(spark, rows, want):
    assert applicability.source_results(spark.createDataFrame(rows, FACTS), ["k"]).first()["result"] == want


RANK = ("authority", "structuredness", "scope", "specificity", "directness", "freshness", "corroboration")


@pytest.mark.parametrize("a, b, want", [
    ((0, 0, 0, 1, 0, 0, 0), (3, 2, 3, 0, 2, 2, 2), "affected_wins"), ((3, 0, 0, 2, 0, 0, 0), (1, 0, 0, 4, 0, 0, 0), "affected_wins"), ((3, 0, 0, 2, 0, 0, 0), (1, 0, 0, 4, 2, 0, 0), "unaffected_wins"),
    ((1, 0, 0, 2, 1, 0, 0), (3, 0, 0, 2, 0, 0, 0), "unaffected_wins"), ((1, 1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1, 1), "conflict_review"), ((1, 1, 1, 1, 1, 1, 2), (1, 1, 1, 1, 1, 1, 1), "affected_wins"),
])
def test_evidence_winner(spark, a, b, want):
    side = "struct<rank: struct<" + ", ".join(f"{n}: int" for n in RANK) + ">, ordinal: int>"
    df = spark.createDataFrame([((a, 1), (b, 2))], f"a {side}, b {side}")
    assert df.select(applicability.evidence_winner(F.col("a"), F.col("b")).alias("w")).first()["w"] == want


def test_newest_override_decides(spark):
    base = spark.createDataFrame([(1, "base", 0, True, True), (2, "base", 0, True, True), (3, "base", 0, True, True)], "k int, origin string, at int, sure boolean, there boolean")
    over = spark.createDataFrame([(1, "old", 1, True, True), (1, "new", 2, False, True), (2, "only", 1, True, False), (9, "extra", 1, True, True)], base.schema)
    got = revisions.with_overrides(base, over, ["k"], F.col("sure"), [F.col("at")], F.col("there"))
    assert sorted((r["k"], r["origin"]) for r in got.collect()) == [(1, "base"), (3, "base"), (9, "extra")]


@pytest.mark.parametrize("event, details, want", [
    ("CVE Rejected", [], "rejected"), ("cve deleted ", [], "rejected"), ("CVE Withdrawn", [], "rejected"), ("CVE Unrejected", [], "active"), ("CVE Restored", [], "active"), ("Not CVE Rejected", [], None),
    ("CVE Status Change", [], None), ("CVE Status Change", [("x", "Rejected")], None), ("CVE Status Change", [("Status", ""), ("Vuln Status", "withdrawn")], "rejected"), ("CVE Status Change", [("Status", "Analyzed"), ("Status", "Rejected")], "active"),
    ("Modified Analysis", [("Status", "Rejected")], None),
])
def test_terminal_states(spark, event, details, want):
    row = spark.createDataFrame([(event, details)], "e string, d array<struct<type: string, newValue: string>>")
    change = F.struct(F.lit("CVE-2024-0001").alias("cveId"), F.col("e").alias("eventName"), F.lit("1").alias("cveChangeId"), F.lit("2024-01-01T00:00:00").alias("created"), F.col("d").alias("details"))
    assert records.changes(row.select(F.to_json(F.struct(change.alias("change"))).alias("value"))).first()["terminal"] == want


METHODS = [
    (("x", "tensorflow", "google", "tensorflow"), "reference_exact_product"), (("google", "tensor_flow", "google", "tensorflow"), "reference_separator_alias"), (("a", "tensor_flow", "google", "tensorflow"), None),
    (("mongodb", "mongo_go_driver", "mongodb", "go_driver"), "reference_owner_product_composition"), (("gimp", "gip", "gimp", "gnu_image_program"), "reference_acronym"), (("openbsd", "openssh_portable", "openbsd", "openssh"), "reference_product_variant"),
    (("angular", "angular", "angularjs", "angular_js_x"), None), (("acme_inc", "openv", "acme", "open_vpn"), "reference_prefix_abbreviation"),
]


@pytest.mark.parametrize("names, want", METHODS)
def test_reference_name_methods(spark, names, want):
    df = spark.createDataFrame([names], "o string, n string, v string, p string")
    o, n, v, p = (F.col(c) for c in "onvp")
    basis = mapping.vendor_basis(o, v, F.lit(False), F.lit(False), F.lit(None).cast("string"))
    assert df.select(mapping.reference_name_method(o, n, v, p, basis, F.lit(False)).alias("m")).first()["m"] == want


def test_parts(spark):
    df = spark.createDataFrame([(a, b) for a in ("a", "o", "h", "*", "unknown") for b in ("a", "o", "h", "*", "unknown")], "a string, b string")
    got = {(r["a"], r["b"]) for r in df.where(mapping.part_compatible(F.col("a"), F.col("b"))).collect()}
    same = {(x, x) for x in ("a", "o", "h", "*", "unknown")}
    both = {("h", "*"), ("o", "*"), ("a", "*"), ("a", "unknown"), ("*", "unknown")}
    assert got == same | both | {(b, a) for a, b in both}


def test_placeholders(spark):
    df = spark.createDataFrame([("n_a",), ("na",), ("null",), ("",), ("not_applicable",), ("x",)], "k string")
    assert [r["k"] for r in df.where(T.is_placeholder(F.col("k"))).collect()] == ["n_a", "na", "null", ""]
