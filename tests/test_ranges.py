from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdex.operators import conflicts, ranges

STATED = [
    # version, lessThan, lessThanOrEqual, versionType, product: class, lower, inclusive, upper, inclusive, exact, error
    (("1.0", "2.0", None, None, "x"), ("BOUNDED_RANGE", "1.0", True, "2.0", False, None, None)),
    (("0", "2.0", None, None, "x"), ("UNBOUNDED_RANGE", None, None, "2.0", False, None, None)),
    (("n/a", None, "3.1", None, "x"), ("UNBOUNDED_RANGE", None, None, "3.1", True, None, None)),
    (("unspecified", "n/a", None, None, "x"), ("UNSPECIFIED", None, None, None, None, None, None)),
    ((">=1.0, <2.0", None, None, None, "x"), ("BOUNDED_RANGE", "1.0", True, "2.0", False, None, None)),
    ((">1.0", "2.0", None, None, "x"), ("BOUNDED_RANGE", "1.0", False, "2.0", False, None, None)),
    (("<=3", "2.0", None, None, "x"), ("UNBOUNDED_RANGE", None, None, "2.0", False, None, None)),
    (("<=2.0", None, "2", None, "x"), ("UNBOUNDED_RANGE", None, None, "2.0", True, None, None)),
    (("<2", None, "2.0", None, "x"), ("UNBOUNDED_RANGE", None, None, "2", False, None, None)),
    (("=1.5", None, None, None, "x"), ("EXACT", None, None, None, None, "1.5", None)),
    (("=1.5", "2", None, None, "x"), ("UNPARSED", None, None, None, None, None, "exact_mixed_with_structured_upper")),
    (("==1", None, None, None, "x"), ("UNPARSED", None, None, None, None, None, "invalid_comparator_expression")),
    (("!=1", None, None, None, "x"), ("UNPARSED", None, None, None, None, None, "not_equal_requires_disjoint_segments")),
    ((">1 >2", None, None, None, "x"), ("UNPARSED", None, None, None, None, None, "multiple_lower_bounds")),
    (("<1;<2", None, None, None, "x"), ("UNPARSED", None, None, None, None, None, "multiple_upper_bounds")),
    ((">1 =2", None, None, None, "x"), ("UNPARSED", None, None, None, None, None, "exact_mixed_with_range")),
    (("1.0", "<=2.0", None, None, "x"), ("UNPARSED", None, None, None, None, None, "conflicting_comparator_in_less_than")),
    (("1.0", None, "<=", None, "x"), ("UNBOUNDED_RANGE", "1.0", True, None, None, None, None)),
    (("1.0", None, "<= 2 <", None, "x"), ("UNPARSED", None, None, None, None, None, "invalid_comparator_token_in_less_than_or_equal")),
    (("1.0", "2", "3", None, "x"), ("UNPARSED", None, None, None, None, None, "conflicting_cna_upper_bounds")),
    (("before <2", "2", None, None, "x"), ("UNPARSED", None, None, None, None, None, "invalid_comparator_token_in_cna_version")),
    (("All versions", None, None, None, "x"), ("EXPLICIT_ALL", None, None, None, None, None, None)),
    (("*", None, None, None, "x"), ("EXPLICIT_ALL", None, None, None, None, None, None)),
    (("*", "2", None, None, "x"), ("UNBOUNDED_RANGE", None, None, "2", False, None, None)),
    (("1.2.x", None, None, None, "x"), ("BRANCH_RANGE", None, None, None, None, "1.2.x", None)),
    (("-", None, None, None, "x"), ("NOT_APPLICABLE", None, None, None, None, None, None)),
    ((None, None, None, None, "x"), ("UNSPECIFIED", None, None, None, None, None, None)),
    (("deadbeef", None, None, None, "x"), ("EXACT", None, None, None, None, "deadbeef", None)),
]
FIELDS = ("version_class", "lower", "lower_inclusive", "upper", "upper_inclusive", "exact", "error")


def test_what_records_state(spark):
    df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(STATED)], "i int, v string, lt string, le string, t string, p string")
    found = ranges.compile_stated(df, F.col("v"), F.col("lt"), F.col("le"), F.col("t"), F.col("p"))
    for r in found.select("i", *[f"segment.{f}" for f in FIELDS]).collect():
        assert tuple(r)[1:] == STATED[r["i"]][1], STATED[r["i"]][0]


PLATFORM = [
    (("*", None, None, None, None), ("CPE_ANY_UNCORROBORATED", None, None, None, None, None)), (("-", None, None, None, None), ("NOT_APPLICABLE", None, None, None, None, None)), (("", None, None, None, None), ("UNSPECIFIED", None, None, None, None, None)),
    (("1.5", None, None, None, None), ("EXACT", None, None, None, None, "1.5")), (("*", "1", None, None, "2"), ("BOUNDED_RANGE", "1", True, "2", False, None)), (("*", None, "1", "2", None), ("BOUNDED_RANGE", "1", False, "2", True, None)),
    (("9", None, None, "2", None), ("UNBOUNDED_RANGE", None, None, "2", True, None)), (("*", "", "1", None, None), ("UNBOUNDED_RANGE", "1", True, None, None, None)),
]


def test_what_platform_names_state(spark):
    df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(PLATFORM)], "i int, v string, si string, se string, ei string, ee string")
    found = df.select("i", ranges.compile_cpe(*[F.col(c) for c in ("v", "si", "se", "ei", "ee")], F.lit("x")).alias("s"))
    for r in found.select("i", *[f"s.{f}" for f in FIELDS[:-1]]).collect():
        assert tuple(r)[1:] == PLATFORM[r["i"]][1], PLATFORM[r["i"]][0]


CHANGES = [
    (("1", "9", []), [("affected", "1", True, "9", False, None)]),
    (("1", "9", [("3", "unaffected"), ("5", "AFFECTED")]), [("affected", "1", True, "3", False, None), ("unaffected", "3", True, "5", False, None), ("affected", "5", True, "9", False, None)]),
    (("1", "9", [("1.0", "unaffected"), ("9", "affected")]), [("unaffected", "1", True, "9", False, None)]),
    (("0", "9", [("3", "odd")]), [("affected", None, None, "3", False, None), ("unknown", "3", True, "9", False, None)]),
    (("1", "9", [("5", "affected"), ("3", "unaffected")]), [("affected", None, None, None, None, "unordered_changes")]),
    (("4", "9", [("3", "unaffected")]), [("affected", None, None, None, None, "changes_below_initial_version")]),
    (("1", "9", [(" ", "unaffected")]), [("affected", None, None, None, None, "malformed_changes_transition")]),
    (("1", "9", [("3", None)]), [("affected", None, None, None, None, "malformed_changes_transition")]),
]


def test_changes_split_a_segment(spark):
    df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(CHANGES)], "i int, v string, lt string, c array<struct<at: string, status: string>>")
    none = F.lit(None).cast("string")
    found = ranges.with_changes(ranges.compile_stated(df, F.col("v"), F.col("lt"), none, none, F.lit("x"), F.col("c.at")), F.col("segment"), F.lit("affected"), F.col("c"))
    for r in found.select("i", "pieces").collect():
        assert [(p["status"], p["lower"], p["lower_inclusive"], p["upper"], p["upper_inclusive"], p["error"]) for p in r["pieces"]] == CHANGES[r["i"]][1], CHANGES[r["i"]][0]


EVALUATED = [
    # candidate, version, lessThan, lessThanOrEqual, product, coverage, first branch, last branch: truth, reason, relation
    (("1.5", "1.0", "2.0", None, "x", "partial", None, None), (True, "range_match", None)),
    (("2.0", "1.0", "2.0", None, "x", "partial", None, None), (False, "upper_bound_exceeded", None)),
    (("2.0.0", "1.0", None, "2", "x", "partial", None, None), (True, "range_match", None)),
    (("0.9", ">1", None, None, "x", "partial", None, None), (False, "lower_bound_not_met", None)),
    (("1", ">1", None, None, "x", "partial", None, None), (False, "lower_bound_not_met", None)),
    (("1.2.9", "1.2.x", None, None, "x", "partial", None, None), (True, "branch_prefix_match", "same_branch")),
    (("1.20", "1.2.x", None, None, "x", "partial", None, None), (False, "branch_prefix_mismatch", "lateral_incompatible")),
    (("1.19", "1.x", "1.20.7", None, "x", "partial", None, None), (True, "range_match", None)),
    (("2.1", "1.x", "1.20.7", None, "x", "partial", None, None), (False, "branch_prefix_mismatch", "lateral_incompatible")),
    (("7.0.9", "1", None, "7.0.x", "x", "partial", None, None), (True, "range_match", None)),
    (("1.5", "1.5.0", None, None, "x", "partial", None, None), (True, "exact_match", "same_branch")),
    (("1.6", "1.5", None, None, "x", "partial", None, None), (False, "exact_mismatch", "same_branch")),
    (("1", "*", None, None, "x", "partial", None, None), (True, "explicit_all", None)),
    (("1", "-", None, None, "x", "partial", None, None), (False, "version_not_applicable", None)),
    (("1", "==", None, None, "x", "partial", None, None), (None, "version_unparsed", None)),
    (("1", None, None, None, "x", "partial", None, None), (None, "version_unspecified", None)),
    (("1.0.2k", "1.0.2", "1.0.2z", None, "openssl", "partial", "1.0.2", "1.1.0"), (True, "range_match", "same_branch")),
    (("1.0.1k", "1.0.2", "1.0.2z", None, "openssl", "partial", "1.0.2", "1.1.0"), (None, "branch_below_coverage", "out_of_range_below")),
    (("1.0.1k", "1.0.2", "1.0.2z", None, "openssl", "complete", "1.0.2", "1.1.0"), (False, "lower_bound_not_met", "out_of_range_below")),
    (("3.0.7", "1.1.0", "1.1.0z", None, "openssl", "partial", "1.0.2", "1.1.0"), (False, "upper_bound_exceeded", "out_of_range_above")),
    (("3.0.7", "1.0.2", "1.0.2z", None, "openssl", "partial", "1.0.2", "1.1.0"), (None, "branch_lateral_uncovered", "lateral_incompatible")),
    (("3.0.7", "1.0.2", "1.0.2z", None, "openssl", "complete", "1.0.2", "1.1.0"), (False, "branch_outside_complete_coverage", "lateral_incompatible")),
    (("7.0.10-58", "6.0", "6.9.4-8", None, "imagemagick", "partial", None, None), (False, "upper_bound_exceeded", None)),
]


def test_versions_against_segments(spark):
    df = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(EVALUATED)], "i int, c string, v string, lt string, le string, p string, b string, f string, l string")
    compiled = ranges.compile_stated(df, F.col("v"), F.col("lt"), F.col("le"), F.lit(None).cast("string"), F.col("p"))
    for r in ranges.evaluate(compiled, F.col("c"), F.col("segment"), F.col("b"), F.col("f"), F.col("l")).select("i", "found").collect():
        assert tuple(r["found"]) == EVALUATED[r["i"]][1], EVALUATED[r["i"]][0]


SETS = [
    # left and right as (lower, inclusive, upper, inclusive)
    ([("1", True, "2", True)], [("1.0", True, "2.0", True)], "equal"),
    ([("1", True, "2", False), ("2", True, "3", True)], [("1", True, "3", True)], "equal"),
    ([("1", True, "2", False), ("2", False, "3", True)], [("1", True, "3", True)], "right_broader"),
    ([(None, None, "2", True)], [("1", True, "2", True)], "left_broader"),
    ([("1", False, "2", True)], [("1", True, "2", True)], "right_broader"),
    ([("1", True, "3", True)], [("2", True, "4", True)], "partial_overlap"),
    ([("1", True, "2", False)], [("2", True, "3", True)], "partial_overlap"),
    ([("1", True, "2", False)], [("2", False, "3", True)], "disjoint"),
    ([(None, None, None, None)], [("1", True, "2", True), (None, None, "0.5", False)], "left_broader"),
]


def test_sets_with_open_and_absent_ends(spark):
    from verdex.functions.versions import dotted_key

    def frame(side):
        rows = [(i, *r) for i, case in enumerate(SETS) for r in case[side]]
        df = spark.createDataFrame(rows, "i int, lo string, li boolean, up string, ui boolean")
        return df.select("i", ranges.lower_end(dotted_key(F.col("lo")), F.col("li")).alias("lower"), ranges.upper_end(dotted_key(F.col("up")), F.col("ui")).alias("upper"))

    got = {r["i"]: r["relation"] for r in ranges.range_relation(frame(0), frame(1), ["i"]).collect()}
    assert got == {i: case[2] for i, case in enumerate(SETS)}


def test_levels_of_identity(spark):
    stated = spark.createDataFrame([(1, "a", "acme", "tool"), (1, "b", "acme_inc", "gear"), (1, "c", "zed", "big_tool"), (1, "d", "zed", "nothing"), (2, "e", "acme", "tool")], "r int, item string, vendor string, product string")
    platforms = spark.createDataFrame([(1, "acme", "tool"), (1, "acme", "other"), (1, "gear_project", "acme_gear"), (1, "x", "zed_big_tool_kit")], "r int, vendor string, product string")
    got = {}
    for r in conflicts.identity_matches(stated, platforms, "r").collect():
        got.setdefault(r["item"], (r["level"], set()))[1].add(r["product"])
    assert got == {"a": ("exact", {"tool"}), "b": ("loose", {"acme_gear"}), "c": ("loose", {"zed_big_tool_kit"}), "d": ("none", {None}), "e": ("none", {None})}


@pytest.mark.parametrize("text, numeric", [("10.0.19042.1706", True), ("1.5.20-7", True), ("v2", True), ("20h2", False), ("sp1", False)])
def test_scales(spark, text, numeric):
    assert spark.createDataFrame([(text,)], "t string").select(conflicts.numeric_scale(F.col("t")).alias("n")).first()["n"] is numeric
