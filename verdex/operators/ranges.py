"""Version statements compiled to segments, a version against a segment, and sets of ranges against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V

#: What a statement compiles to; ends are as written, ``error`` says why one could not be read.
SEGMENT = ("kind", "version_class", "profile", "error", "lower", "lower_inclusive", "upper", "upper_inclusive", "exact", "branch_key", "breadth")
#: Classes that decide whatever the version, and the classes whose ends are compared.
BY_CLASS = {"EXPLICIT_ALL": ("TRUE", "explicit_all"), "CPE_ANY_UNCORROBORATED": ("UNKNOWN", "cpe_any_uncorroborated"), "UNSPECIFIED": ("UNKNOWN", "version_unspecified"), "UNPARSED": ("UNKNOWN", "version_unparsed"), "NOT_APPLICABLE": ("FALSE", "version_not_applicable")}
COMPARED = ("EXACT", "BOUNDED_RANGE", "UNBOUNDED_RANGE")
#: All reasons of :func:`evaluate`, by their truth.
REASONS = {
    "TRUE": ("explicit_all", "branch_prefix_match", "exact_match", "range_match"),
    "FALSE": ("version_not_applicable", "branch_prefix_mismatch", "exact_mismatch", "branch_outside_complete_coverage", "lower_bound_not_met", "upper_bound_exceeded"),
    "UNKNOWN": ("cpe_any_uncorroborated", "version_unspecified", "version_unparsed", "branch_parse_failed", "branch_below_coverage", "branch_lateral_uncovered"),
}
REASON_CODES = {reason: i for i, reason in enumerate(r for of in REASONS.values() for r in of)}
_ANY_SIGN = "[<>=!]"
_PART = r"(<=|>=|!=|=|<|>)\s*([^\s,;<>!=]+)"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def all_dotted(*values: Column) -> Column:
    """Whether there is a version among some texts, and each that is one has numbers between dots alone."""
    said = F.filter(F.array(*values), lambda v: v.isNotNull() & (F.trim(v) != "") & ~T.is_placeholder(T.ascii_key(v)))
    return (F.size(said) > 0) & F.forall(said, lambda v: F.trim(v).rlike(r"^[vV]?\d+(\.\d+)*$"))


def _segment(kind: Column, version_class: Column, profile: Column, error: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column, exact: Column, branch: Column, breadth: Column) -> Column:
    values = (kind, version_class, profile, error, lower, lower_inclusive, upper, upper_inclusive, exact, branch, breadth)
    return F.struct(*[v.alias(n) for n, v in zip(SEGMENT, values)])


def compile_cpe(version: Column, start_including: Column, start_excluding: Column, end_including: Column, end_excluding: Column, product_key: Column) -> Column:
    """The segment of a platform name's version and the range fields beside it.

    Range fields come before the name's version; without them ``*`` is any version that
    nothing corroborates, ``-`` no version, an empty text unspecified, and the rest exact.
    """
    raw = F.coalesce(version, F.lit(""))
    lower, upper = F.coalesce(_filled(start_including), start_excluding), F.coalesce(_filled(end_including), end_excluding)
    fields = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in (start_including, start_excluding, end_including, end_excluding)])
    ranged, low, high = fields > 0, _filled(lower).isNotNull(), _filled(upper).isNotNull()
    profile = V.profile_for(F.lit(""), product_key, all_dotted(raw, lower, upper))
    version_class = (
        F.when(ranged, F.when(low & high, "BOUNDED_RANGE").otherwise("UNBOUNDED_RANGE"))
        .when(raw == "*", "CPE_ANY_UNCORROBORATED")
        .when(F.lower(raw).isin("-", "n/a"), "NOT_APPLICABLE")
        .when(raw == "", "UNSPECIFIED")
        .otherwise("EXACT")
    )
    exact = F.when(~ranged & (version_class == "EXACT"), raw)
    breadth = F.when(ranged, F.when(low & high, "bounded").otherwise("unbounded")).when(version_class.isin("CPE_ANY_UNCORROBORATED", "UNSPECIFIED"), "unbounded").otherwise("bounded")
    return _segment(
        V.version_kind(raw), version_class, profile, _null(), F.when(ranged, lower), F.when(ranged & low, start_including.isNotNull()), F.when(ranged, upper), F.when(ranged & high, end_including.isNotNull()),
        exact, V.branch_key(F.coalesce(exact, F.when(ranged, F.coalesce(_filled(lower), upper))), profile), breadth,
    )


def _upper_field(said: Column, sign: str, name: str) -> tuple[Column, Column]:
    """A structured upper end without the sign that some sources repeat in it, and what is wrong with it."""
    signed = said.rlike(_ANY_SIGN)
    whole = r"^(<=|>=|!=|<|>|=)\s*([^<>=!]+)$"
    operator, operand = F.regexp_extract(said, whole, 1), F.trim(F.regexp_extract(said, whole, 2))
    error = F.when(signed & (operator == ""), f"invalid_comparator_token_in_{name}").when(signed & (operator != sign), f"conflicting_comparator_in_{name}").when(signed & (operand == ""), f"empty_{name}")
    return F.when(signed, operand).otherwise(said), error


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters and projections take as it is: through a generator the optimizer writes no expression into another."""
    return df.withColumn(name, F.explode(F.array(value)))


def _without(df: DataFrame, prefix: str = "_r_") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def compile_stated(df: DataFrame, version: Column, less_than: Column, less_than_or_equal: Column, version_type: Column, product_key: Column, changed_at: Column | None = None, out: str = "segment") -> DataFrame:
    """``df`` with ``out``, the segment of a version that a record states, with the upper ends and the version type beside it.

    First match: an upper end or a version that can't be read; all versions; an expression
    of comparators, cut by the structured upper end where that is lower; a lower end (none
    for 0 and for placeholders) with a structured upper end; a branch; no version; an
    unspecified one; one version. What can't be read is class UNPARSED with its ``error``.
    Steps are columns of their own, so that no expression is written out twice.
    """
    c = lambda name: F.col(f"_r_{name}")
    step = lambda df, **columns: df.withColumns({f"_r_{k}": v for k, v in columns.items()})
    first = lambda ops, name: F.get(F.filter(c("parts"), lambda p: p["op"].isin(*ops)), F.lit(0))[name]
    count = lambda *ops: F.size(F.filter(c("parts"), lambda p: p["op"].isin(*ops)))
    df = step(df, raw=F.coalesce(version, F.lit("")), type=T.ascii_key(F.coalesce(version_type, F.lit(""))), product=product_key, ranged=less_than.isNotNull() | less_than_or_equal.isNotNull(), at=F.coalesce(changed_at, F.array().cast("array<string>")) if changed_at is not None else F.array().cast("array<string>"))
    for name, value, sign in (("less_than", less_than, "<"), ("less_than_or_equal", less_than_or_equal, "<=")):
        df = step(df, said=F.when(~T.is_placeholder(T.ascii_key(value)), F.trim(value)))
        end, wrong = _upper_field(c("said"), sign, name)
        df = step(df, **{name: end, f"{name}_error": wrong})
    df = step(df, kind=V.version_kind(c("raw")), low=F.lower(F.trim(c("raw"))), empty=T.is_placeholder(T.ascii_key(c("raw"))), stated=F.coalesce(c("less_than"), c("less_than_or_equal")), stated_in=F.when(c("less_than").isNotNull(), False).when(c("less_than_or_equal").isNotNull(), True))
    df = step(df, every=c("low").isin("all", "all versions", "*") & ~c("ranged"), expression=c("kind") == "range_expression")
    parts = F.transform(F.regexp_extract_all(c("raw"), F.lit(f"({_PART})"), 1), lambda p: F.struct(F.regexp_extract(p, _PART, 1).alias("op"), F.regexp_extract(p, _PART, 2).alias("to")))
    df = step(df, parts=F.when(c("expression"), parts).otherwise(F.slice(parts, F.lit(1), F.lit(0))))
    df = step(df, lower=first((">", ">="), "to"), lower_op=first((">", ">="), "op"), inline=first(("<", "<="), "to"), inline_in=first(("<", "<="), "op") == "<=", equal=first(("=",), "to"))
    late_equal = F.exists(F.slice(c("parts"), F.lit(2), F.greatest(F.size(c("parts")) - 1, F.lit(0))), lambda p: p["op"] == "=")
    unread = (
        F.when(~c("raw").rlike(rf"^[\s,;]*({_PART}([\s,;]+|$))+$"), "invalid_comparator_expression")
        .when(count("!=") > 0, "not_equal_requires_disjoint_segments")
        .when(count(">", ">=") > 1, "multiple_lower_bounds")
        .when(count("<", "<=") > 1, "multiple_upper_bounds")
        .when(late_equal, "exact_mixed_with_range")
        .when(c("equal").isNotNull() & c("stated").isNotNull(), "exact_mixed_with_structured_upper")
    )
    error = (
        F.when(c("less_than_error").isNotNull(), c("less_than_error"))
        .when(c("less_than_or_equal_error").isNotNull(), c("less_than_or_equal_error"))
        .when(c("less_than").isNotNull() & c("less_than_or_equal").isNotNull() & (c("less_than") != c("less_than_or_equal")), "conflicting_cna_upper_bounds")
        .when(c("stated").isNotNull() & ~c("expression") & ~c("empty") & c("raw").rlike(_ANY_SIGN), "invalid_comparator_token_in_cna_version")
        .when(c("expression"), unread)
    )
    df = step(df, error=error, between=V.profile_for(c("type"), c("product"), all_dotted(c("lower"), c("inline"), c("stated"))))
    df = step(df, order=V.compare_by(F.when(c("expression"), c("inline")), F.when(c("expression"), c("stated")), c("between")))
    keeps = c("stated").isNull() | (c("order") < 0)
    takes = c("inline").isNull() | (c("order") > 0)
    cut = F.when(keeps, c("inline")).when(takes, c("stated")).otherwise(c("inline"))
    cut_in = F.when(keeps, F.when(c("inline").isNotNull(), c("inline_in"))).when(takes, c("stated_in")).otherwise(c("inline_in") & c("stated_in"))
    ranged = c("ranged") & ~c("every")
    alone = ~(c("every") | c("expression") | c("ranged"))
    df = step(
        df, ok=c("error").isNull(), alone=alone, from_=F.when(c("expression"), c("lower")).when(ranged & (c("low") != "0") & ~c("empty"), c("raw")), to=F.when(c("expression"), cut).when(ranged, c("stated")), to_in=F.when(c("expression"), cut_in).when(ranged, c("stated_in")),
        exact=F.when(c("expression"), c("equal")).when(alone & ~c("kind").isin("not_applicable", "missing"), c("raw")),
    )
    df = step(df, bounded=c("from_").isNotNull() & c("to").isNotNull())
    width = F.when(c("bounded"), "BOUNDED_RANGE").otherwise("UNBOUNDED_RANGE")
    version_class = (
        F.when(~c("ok"), "UNPARSED")
        .when(c("every"), "EXPLICIT_ALL")
        .when(c("expression"), F.when(c("equal").isNotNull(), "EXACT").otherwise(width))
        .when(c("ranged"), F.when(c("from_").isNull() & c("to").isNull(), "UNSPECIFIED").otherwise(width))
        .when(c("kind") == "branch_wildcard", "BRANCH_RANGE")
        .when(c("kind") == "not_applicable", "NOT_APPLICABLE")
        .when(c("kind") == "missing", "UNSPECIFIED")
        .otherwise("EXACT")
    )
    said = F.concat(F.when(c("expression"), F.array(c("from_"), c("to"), c("exact"))).when(c("ranged"), F.array(c("from_"), c("to"))).otherwise(F.array(c("raw"))), c("at"))
    df = step(df, class_=version_class, said=F.filter(said, lambda v: v.isNotNull() & (F.trim(v) != "") & ~T.is_placeholder(T.ascii_key(v))))
    df = step(df, profile=V.profile_for(c("type"), c("product"), (F.size(c("said")) > 0) & F.forall(c("said"), lambda v: F.trim(v).rlike(r"^[vV]?\d+(\.\d+)*$"))))
    wildcard = c("alone") & (c("kind") == "branch_wildcard")
    branch = F.when(wildcard, F.regexp_extract(F.trim(c("raw")), r"^(.*)\.[xX*]$", 1)).otherwise(V.branch_key(F.coalesce(c("exact"), c("from_"), c("to")), c("profile")))
    breadth = F.when(~c("ok") | c("exact").isNotNull() | c("bounded") | (c("alone") & (c("kind") == "not_applicable")), "bounded").otherwise("unbounded")
    from_in = F.when(c("from_").isNotNull(), F.when(c("expression"), c("lower_op") == ">=").otherwise(True))
    ok = lambda value: F.when(c("ok"), value)
    segment = _segment(c("kind"), c("class_"), c("profile"), c("error"), ok(c("from_")), ok(from_in), ok(c("to")), ok(F.when(c("to").isNotNull(), c("to_in"))), ok(c("exact")), ok(branch), breadth)
    return _without(_settled(df, out, segment))


def with_changes(df: DataFrame, segment: Column, status: Column, changes: Column, out: str = "pieces") -> DataFrame:
    """``df`` with ``out``, an array<struct<status, lower, lower_inclusive, upper, upper_inclusive, exact, error>>: a segment split where its status changes.

    ``changes`` is an array<struct<at, status>> in ascending order. Those at or beyond the
    upper end say nothing; one at the lower end gives the first status. Changes out of
    order, below the lower end or without version or status leave one unreadable segment.
    """
    c = lambda name: F.col(f"_r_{name}")
    step = lambda df, **columns: df.withColumns({f"_r_{k}": v for k, v in columns.items()})
    clean = lambda s: F.when(F.lower(F.trim(s)).isin("affected", "unaffected", "unknown"), F.lower(F.trim(s))).otherwise("unknown")
    df = step(df, seg=segment, status=status, steps=F.coalesce(changes, F.array().cast("array<struct<at: string, status: string>>")))
    seg, steps = c("seg"), c("steps")
    df = step(df, start=F.coalesce(seg["lower"], seg["exact"]), start_in=F.when(seg["lower"].isNotNull(), seg["lower_inclusive"]).when(seg["exact"].isNotNull(), True), n=F.size(steps))
    df = step(df, places=V.point_keys(F.concat(F.array(c("start"), seg["upper"]), F.transform(steps, lambda s: F.trim(s["at"]))), F.when(c("n") > 0, seg["profile"])))
    df = step(df, low=F.get(c("places"), F.lit(0)), high=F.get(c("places"), F.lit(1)), keyed=F.transform(steps, lambda s, i: F.struct(F.trim(s["at"]).alias("at"), clean(s["status"]).alias("status"), F.get(c("places"), i + 2).alias("key"))))
    malformed = F.exists(steps, lambda s: s["at"].isNull() | (F.trim(s["at"]) == "") | s["status"].isNull())
    unordered = F.exists(F.sequence(F.lit(1), F.greatest(c("n") - 1, F.lit(1))), lambda i: (i < c("n")) & (F.get(c("keyed"), i - 1)["key"] >= F.get(c("keyed"), i)["key"]))
    df = step(df, first=F.get(c("keyed"), F.lit(0)))
    df = step(df, error=F.when(malformed, "malformed_changes_transition").when(unordered, "unordered_changes").when(c("start").isNotNull() & (c("first")["key"] < c("low")), "changes_below_initial_version"), at_start=F.coalesce(c("start").isNotNull() & (c("first")["key"] == c("low")), F.lit(False)))
    beyond = lambda s: F.coalesce((s["key"] > c("high")) | ((s["key"] == c("high")) & ~seg["upper_inclusive"]), F.lit(False))
    df = step(df, state=F.when(c("at_start"), c("first")["status"]).otherwise(c("status")), kept=F.filter(c("keyed"), lambda s, i: ~(c("at_start") & (i == 0)) & ~beyond(s)))
    df = step(df, m=F.size(c("kept")))

    def piece(status: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column, exact: Column, error: Column) -> Column:
        return F.struct(status.alias("status"), lower.alias("lower"), lower_inclusive.alias("lower_inclusive"), upper.alias("upper"), upper_inclusive.alias("upper_inclusive"), exact.alias("exact"), error.alias("error"))

    whole = lambda status, error: F.array(piece(status, seg["lower"], seg["lower_inclusive"], seg["upper"], seg["upper_inclusive"], seg["exact"], error))
    kept, m = c("kept"), c("m")
    cut = F.transform(F.sequence(F.lit(0), m), lambda i: piece(
        F.when(i == 0, c("state")).otherwise(F.get(kept, i - 1)["status"]), F.when(i == 0, c("start")).otherwise(F.get(kept, i - 1)["at"]), F.when(i == 0, c("start_in")).otherwise(True),
        F.when(i == m, seg["upper"]).otherwise(F.get(kept, i)["at"]), F.when(i == m, seg["upper_inclusive"]).otherwise(False), _null(), _null(),
    ))
    unread = F.array(piece(c("status"), _null(), _null("boolean"), _null(), _null("boolean"), _null(), c("error")))
    return _without(_settled(df, out, F.when(c("n") == 0, whole(c("status"), seg["error"])).when(c("error").isNotNull(), unread).when(m == 0, whole(c("state"), _null())).otherwise(cut)))


def _named(value: Column) -> Column:
    return F.when(~T.is_placeholder(T.ascii_key(value)), value)


def _prefix(bound: Column) -> Column:
    return _filled(F.regexp_extract(F.trim(bound), r"^(\d+(?:\.\d+)*)\.[xX*]$", 1))


def _under(version: Column, prefix: Column) -> Column:
    return (version == prefix) | version.startswith(F.concat(prefix, F.lit(".")))


def evaluate(df: DataFrame, candidate: Column, segment: Column, branch_coverage: Column, first_branch: Column, last_branch: Column, out: str = "found") -> DataFrame:
    """``df`` with ``out``, a struct<truth, reason, relation>: a version against a segment, in three values.

    ``first_branch`` and ``last_branch`` are the least and the greatest branch that the
    segment's claim names. A version of another branch is outside where the claim covers
    its branches completely, or lies above them all; else it is unknown.
    """
    c = lambda name: F.col(f"_r_{name}")
    step = lambda df, **columns: df.withColumns({f"_r_{k}": v for k, v in columns.items()})
    df = step(df, v=candidate, seg=segment, complete=F.coalesce(branch_coverage == "complete", F.lit(False)))
    seg = c("seg")
    df = step(df, lower=_named(seg["lower"]), upper=_named(seg["upper"]), exact=seg["exact"], mine=V.branch_key(c("v"), seg["profile"]))
    df = step(df, lower_prefix=_prefix(c("lower")), upper_prefix=_prefix(c("upper")), exact_prefix=_prefix(c("exact")))
    points = F.array(c("v"), c("exact"), F.when(c("lower_prefix").isNull(), c("lower")), F.when(c("upper_prefix").isNull(), c("upper")))
    # Where the class alone decides, or no end is given, no key is made.
    asked = seg["version_class"].isin(*COMPARED)
    df = step(df, keys=V.point_keys(points, F.when(asked, seg["profile"])))
    key = [F.get(c("keys"), F.lit(i)) for i in range(4)]
    other = F.coalesce(c("mine") != seg["branch_key"], F.lit(False))
    df = step(df, beneath=other & F.coalesce(c("mine") < first_branch, F.lit(False)), above=other & F.coalesce((c("mine") > last_branch) & (seg["branch_key"] == last_branch), F.lit(False)), other=other)
    df = step(df, lateral=c("other") & ~c("beneath") & ~c("above"))
    under = lambda p: _under(c("v"), p)
    off = F.coalesce(~under(c("lower_prefix")), F.lit(False)) | F.coalesce(~under(c("upper_prefix")), F.lit(False))
    too_low = F.coalesce((key[0] < key[2]) | ((key[0] == key[2]) & ~seg["lower_inclusive"]), F.lit(False))
    too_high = F.coalesce((key[0] > key[3]) | ((key[0] == key[3]) & ~seg["upper_inclusive"]), F.lit(False))
    relation = F.when(c("beneath"), "out_of_range_below").when(c("above"), "out_of_range_above").when(c("mine").isNotNull(), "same_branch")
    cls = seg["version_class"]
    cases: list[tuple[Column, str, str, Column | str | None]] = [(cls == name, truth, reason, None) for name, (truth, reason) in BY_CLASS.items()]
    branch = cls == "BRANCH_RANGE"
    cases += [
        (branch & c("exact_prefix").isNull(), "UNKNOWN", "branch_parse_failed", None),
        (branch & under(c("exact_prefix")), "TRUE", "branch_prefix_match", "same_branch"),
        (branch, "FALSE", "branch_prefix_mismatch", "lateral_incompatible"),
        (c("exact").isNotNull() & (key[0] == key[1]), "TRUE", "exact_match", "same_branch"),
        (c("exact").isNotNull(), "FALSE", "exact_mismatch", "same_branch"),
        (c("beneath") & ~c("complete"), "UNKNOWN", "branch_below_coverage", "out_of_range_below"),
        (c("lateral") & ~c("complete"), "UNKNOWN", "branch_lateral_uncovered", "lateral_incompatible"),
        (c("lateral"), "FALSE", "branch_outside_complete_coverage", "lateral_incompatible"),
        (off, "FALSE", "branch_prefix_mismatch", "lateral_incompatible"),
        (too_low, "FALSE", "lower_bound_not_met", relation),
        (too_high, "FALSE", "upper_bound_exceeded", relation),
        (F.lit(True), "TRUE", "range_match", relation),
    ]
    truths = {"TRUE": F.lit(True), "FALSE": F.lit(False), "UNKNOWN": _null("boolean")}
    said = lambda truth, reason, where: F.struct(truths[truth].alias("truth"), F.lit(reason).alias("reason"), (where if isinstance(where, Column) else F.lit(where).cast("string")).alias("relation"))
    verdict = reduce(lambda chain, case: chain.when(case[0], said(*case[1:])) if chain is not None else F.when(case[0], said(*case[1:])), cases, None)
    return _without(_settled(df, out, verdict))


# -- the same of very many pairs: all that one side alone decides is made for its distinct values ---------------------------


def asked_versions(versions: DataFrame, version: str, out: str) -> DataFrame:
    """``versions`` with ``out``, what :func:`reason_code` asks of a candidate: its branch, its key under each profile and its key in the order that takes any text."""
    v = F.col(version)
    strict = F.array(*[V.strict_key(v, p) for p in V.PROFILES if p != "opaque"])
    return _settled(versions, out, F.struct(v.alias("text"), V.branch_key(v, F.lit("openssl")).alias("branch"), strict.alias("strict"), V.fallback_key(v).alias("total")))


def asked_segments(segments: DataFrame, segment: str, out: str) -> DataFrame:
    """``segments`` with ``out``, what :func:`reason_code` asks of a segment: what decides it, and the keys of its exact version and its ends."""
    seg, code = F.col(segment), REASON_CODES
    cls, profile = seg["version_class"], seg["profile"]
    c = lambda name: F.col(f"_r_{name}")
    step = lambda df, **columns: df.withColumns({f"_r_{k}": v for k, v in columns.items()})
    df = step(segments, lower=_named(seg["lower"]), upper=_named(seg["upper"]), branch=F.coalesce(cls == "BRANCH_RANGE", F.lit(False)))
    df = step(df, lower_prefix=_prefix(c("lower")), upper_prefix=_prefix(c("upper")), exact_prefix=_prefix(seg["exact"]))
    df = step(df, points=F.when(cls.isin(*COMPARED) & profile.isNotNull(), F.array(seg["exact"], F.when(c("lower_prefix").isNull(), c("lower")), F.when(c("upper_prefix").isNull(), c("upper")))))
    fixed = reduce(lambda chain, kv: chain.when(cls == kv[0], code[kv[1][1]]), BY_CLASS.items(), F.when(c("branch") & c("exact_prefix").isNull(), code["branch_parse_failed"]))
    place = reduce(lambda chain, kv: chain.when(profile == kv[1], kv[0]), enumerate(p for p in V.PROFILES if p != "opaque"), F.when(F.lit(False), -1)).otherwise(-1)
    df = step(df, strict=V.profile_keys(c("points"), profile), total=V.total_keys(c("points")))
    odd = F.exists(F.arrays_zip(c("points").alias("v"), c("strict").alias("k")), lambda x: x["v"].isNotNull() & x["k"].isNull())
    strict = F.when(c("strict").isNotNull() & ~F.coalesce(odd, F.lit(True)), c("strict"))
    return _without(_settled(df, out, F.struct(
        F.coalesce(fixed, F.lit(-1)).alias("fixed"), c("branch").alias("wild"), seg["exact"].isNotNull().alias("exact"), seg["branch_key"].alias("branch"), (profile == "openssl").alias("branched"), place.alias("profile"),
        c("exact_prefix").alias("exact_prefix"), c("lower_prefix").alias("lower_prefix"), c("upper_prefix").alias("upper_prefix"), strict.alias("strict"), c("total").alias("total"),
        F.coalesce(~seg["lower_inclusive"], F.lit(False)).alias("lower_open"), F.coalesce(~seg["upper_inclusive"], F.lit(False)).alias("upper_open"),
    )))


def reason_code(df: DataFrame, asked: Column, seg: Column, complete: Column, first_branch: Column, last_branch: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the number in REASON_CODES of the reason that :func:`evaluate` gives; no key is made and nothing leaves the JVM."""
    c = lambda name: F.col(f"_r_{name}")
    no = lambda cond: F.coalesce(cond, F.lit(False))
    mine, own = F.get(asked["strict"], seg["profile"]), F.when(seg["branched"], asked["branch"])
    df = df.withColumns({"_r_mine": mine, "_r_strict": seg["strict"].isNotNull() & mine.isNotNull(), "_r_branch": own})
    df = df.withColumns({"_r_key": F.when(c("strict"), c("mine")).otherwise(asked["total"]), "_r_ends": F.when(c("strict"), seg["strict"]).otherwise(seg["total"]), "_r_other": no(c("branch") != seg["branch"])})
    df = df.withColumns({"_r_beneath": c("other") & no(c("branch") < first_branch), "_r_above": c("other") & no((c("branch") > last_branch) & (seg["branch"] == last_branch))})
    end = lambda i: F.get(c("ends"), F.lit(i))
    lateral = c("other") & ~c("beneath") & ~c("above")
    off = no(~_under(asked["text"], seg["lower_prefix"])) | no(~_under(asked["text"], seg["upper_prefix"]))
    code = lambda reason: F.lit(REASON_CODES[reason])
    found = (
        F.when(seg["fixed"] >= 0, seg["fixed"])
        .when(seg["wild"], F.when(_under(asked["text"], seg["exact_prefix"]), code("branch_prefix_match")).otherwise(code("branch_prefix_mismatch")))
        .when(seg["exact"], F.when(no(c("key") == end(0)), code("exact_match")).otherwise(code("exact_mismatch")))
        .when(c("beneath") & ~complete, code("branch_below_coverage"))
        .when(lateral & ~complete, code("branch_lateral_uncovered"))
        .when(lateral, code("branch_outside_complete_coverage"))
        .when(off, code("branch_prefix_mismatch"))
        .when(no((c("key") < end(1)) | ((c("key") == end(1)) & seg["lower_open"])), code("lower_bound_not_met"))
        .when(no((c("key") > end(2)) | ((c("key") == end(2)) & seg["upper_open"])), code("upper_bound_exceeded"))
        .otherwise(code("range_match"))
    )
    return _without(df.withColumn(out, found))


# -- sets of ranges whose ends may be open, closed or absent ----------------------------------------------------------------


def lower_end(key: Column, inclusive: Column) -> Column:
    """A lower end that compares in order: none first, then by key, a closed one before an open one."""
    return F.when(key.isNull(), F.struct(F.lit(0).alias("rank"), _null("array<bigint>").alias("key"), F.lit(0).alias("side"))).otherwise(F.struct(F.lit(1).alias("rank"), key.alias("key"), F.when(inclusive, 0).otherwise(1).alias("side")))


def upper_end(key: Column, inclusive: Column) -> Column:
    """An upper end that compares in order: by key, an open one before a closed one, none last."""
    return F.when(key.isNull(), F.struct(F.lit(2).alias("rank"), _null("array<bigint>").alias("key"), F.lit(0).alias("side"))).otherwise(F.struct(F.lit(1).alias("rank"), key.alias("key"), F.when(inclusive, 1).otherwise(0).alias("side")))


def _apart(lower: Column, upper: Column) -> Column:
    """Whether a range that begins at ``lower`` leaves a gap after one that ends at ``upper``; two open ends at one version do."""
    return (lower["rank"] == 1) & (upper["rank"] == 1) & ((lower["key"] > upper["key"]) | ((lower["key"] == upper["key"]) & (lower["side"] == 1) & (upper["side"] == 0)))


def merge_ranges(df: DataFrame, keys: list[str], lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Ranges of a key, given by their ends, as the fewest that hold the same versions; touching ones become one."""
    ordered = Window.partitionBy(*keys).orderBy(lower, upper)
    before = F.max(upper).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | _apart(F.col(lower), F.col("_before")), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min(lower).alias(lower), F.max(upper).alias(upper), F.count(F.lit(1)).alias("parts")).drop("_island")


def range_relation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How the ranges of a key on the left relate to those on the right, for keys that both have.

    equal, right_broader, left_broader, partial_overlap or disjoint; the ends are columns
    lower and upper. Merged ranges of one side never meet each other, so a range lies in
    the other side if one of that side's holds it.
    """
    a = merge_ranges(left, keys).select(*keys, F.col("lower").alias("al"), F.col("upper").alias("au"))
    b = merge_ranges(right, keys).select(*keys, F.col("lower").alias("bl"), F.col("upper").alias("bu"))
    # No version order is asked of the join; a key's merged ranges are few.
    pairs = a.join(b, keys)
    a_in, b_in = F.expr("bl <= al and bu >= au"), F.expr("al <= bl and au >= bu")
    first_upper, second_lower = F.when(F.expr("al <= bl"), F.col("au")).otherwise(F.col("bu")), F.greatest("al", "bl")
    n = pairs.groupBy(*keys).agg(
        F.count_distinct(F.struct("al", "au")).alias("na"), F.count_distinct(F.struct("bl", "bu")).alias("nb"), F.count_distinct(F.when(a_in, F.struct("al", "au"))).alias("ia"), F.count_distinct(F.when(b_in, F.struct("bl", "bu"))).alias("ib"), F.bool_or(~_apart(second_lower, first_upper)).alias("meet")
    )
    inside_a, inside_b = F.col("na") == F.col("ia"), F.col("nb") == F.col("ib")
    relation = F.when(inside_a & inside_b, "equal").when(inside_a, "right_broader").when(inside_b, "left_broader").when(F.col("meet"), "partial_overlap").otherwise("disjoint")
    return n.select(*keys, relation.alias("relation"))
