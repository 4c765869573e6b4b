"""A batch of questions (product, version) against stored assertions: one plan, whatever the number of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tri import tri_and
from ..plans.skew import hot_keys, on_distinct, salted_join
from .applicability import TOLD, conditions, decided, scope, scope_axis, told
from .ranges import REASON_CODES, asked_segments, asked_versions, evaluate, reason_code

#: Roles of a platform name in its condition that let an assertion hold, and those that leave it open.
ROLES_TRUE = ("DIRECT_UPSTREAM", "DIRECT_ALTERNATIVE_PRODUCT", "DOWNSTREAM_DISTRIBUTION", "DOWNSTREAM_PACKAGE")
ROLES_OPEN = ("UNRESOLVED", "BUNDLED_COMPONENT")


def role_truth(role: Column) -> Column:
    return F.when(role.isNull() | role.isin(*ROLES_TRUE), True).when(role.isin(*ROLES_OPEN), F.lit(None).cast("boolean")).otherwise(False)


def branch_span(assertions: DataFrame, group: list[str], branch: str = "segment.branch_key") -> DataFrame:
    """The least and the greatest branch that each claim group names, beside assertions that name one: one aggregate and a join back."""
    named = assertions.where(F.col(branch).isNotNull())
    span = named.groupBy(*group).agg(F.min(branch).alias("first_branch"), F.max(branch).alias("last_branch"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    return assertions.alias("a").join(span.alias("s"), same, "left").select("a.*", "first_branch", "last_branch")


def evaluated(requests: DataFrame, assertions: DataFrame, axes: list[str], broad: bool = False) -> DataFrame:
    """Every assertion about a request's product with its parts in three values.

    ``requests(request, product, version, <axis>_state, <axis>_value)`` and
    ``assertions(product, subject, claim_group, is_default, segment, branch_coverage,
    first_branch, last_branch, cpe_match_role, configuration, <axis>_state, <axis>_values,
    source_family, polarity, reconciliation, max_result_state, identity_provisional)``.
    """
    asked = requests.select("request", "product", F.col("version").alias("asked_version"), *[F.col(f"{a}_{x}").alias(f"asked_{a}_{x}") for a in axes for x in ("state", "value")])
    met = asked.join(assertions, "product")
    found = evaluate(met, F.col("asked_version"), F.col("segment"), F.col("branch_coverage"), F.col("first_branch"), F.col("last_branch"), "found")
    each = {a: scope_axis(F.col(f"asked_{a}_state"), F.col(f"asked_{a}_value"), F.col(f"{a}_state"), F.col(f"{a}_values"), broad) for a in axes}
    inside = scope(each)[0] if each else F.lit(True)
    out = found.withColumn("role", role_truth(F.col("cpe_match_role"))).withColumn("scope", inside).withColumn("version", F.col("found.truth")).withColumn("version_reason", F.col("found.reason"))
    return out.withColumn("predicate", tri_and(F.col("role"), F.col("scope"), F.col("configuration"), F.col("version")))


def closed(found: DataFrame, group: list[str]) -> DataFrame:
    """Without the defaults of groups that an explicit assertion answers; those beside an explicit unknown become unknown."""
    facts = found.where("not is_default").groupBy(*group).agg(F.bool_or(F.coalesce("predicate", F.lit(False))).alias("_answered"), F.bool_or(F.col("predicate").isNull()).alias("_open"))
    out = found.join(facts, group, "left").where(~(F.col("is_default") & F.coalesce("_answered", F.lit(False))))
    weak = F.col("is_default") & F.coalesce("predicate", F.lit(False)) & F.coalesce("_open", F.lit(False))
    out = out.withColumn("_weak", weak).withColumn("predicate", F.when(~F.col("_weak"), F.col("predicate"))).withColumn("version_reason", F.when(F.col("_weak"), "explicit_coverage_unknown").otherwise(F.col("version_reason")))
    return out.drop("_answered", "_open", "_weak")


#: What the facts of an assertion depend on beside its three-valued parts; None is any other value.
_SOURCES, _POLARITIES, _TRUTHS = ("nvd_cpe", "cna_structured", "llm_description", None), ("affected", "unaffected", "unknown", None), (True, False, None)
#: A version's truth, and the one falsehood that is told apart.
_VERSIONS = ((True, "in"), (False, "out"), (None, "open"), (False, "version_not_applicable"))
#: The number of the reason of a default beside an explicit unknown.
_COVERAGE = len(REASON_CODES)
_REASONS = [*REASON_CODES, "explicit_coverage_unknown"]
#: Reasons of a side without model evidence lie so many bits higher.
_FIRM = 32


def _digit(c: Column, values: tuple) -> Column:
    """The place of a value in ``values``, None as any other."""
    found = F.lit(values.index(None))
    for i, v in enumerate(values):
        if v is not None:
            found = F.when(F.coalesce(c == v, F.lit(False)), i).otherwise(found)
    return found


_DIGITS = (("role", 3), ("configuration", 3), ("source", 4), ("polarity", 4), ("review", 2), ("capped", 2), ("provisional", 2), ("scope", 3), ("version", 4))


def _bit_names() -> list[str]:
    return [*conditions(), "holds", "unclear"]


def _facts_table(like: DataFrame) -> DataFrame:
    """(code, facts, weak): for every combination of what an assertion's facts depend on, the conditions it meets as bits; ``weak`` if it counts as unknown.

    A few thousand rows, whatever the tables. The conditions are those of :func:`conditions`.
    """
    size, at = 1, {}
    for name, n in reversed(_DIGITS):
        at[name] = (size, n)
        size *= n
    c, digit = F.col, lambda name: F.floor(F.col("code") / at[name][0]).cast("int") % at[name][1]
    pick = lambda values, name, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), digit(name))
    df = like.sparkSession.range(size).withColumnRenamed("id", "code").select(
        "code", pick(_TRUTHS, "role", "boolean").alias("role"), pick(_TRUTHS, "configuration", "boolean").alias("configuration"), pick(_SOURCES, "source", "string").alias("source_family"), pick(_POLARITIES, "polarity", "string").alias("polarity"),
        pick(("none", "conflict_review"), "review", "string").alias("reconciliation"), pick(("affected", "potentially_affected"), "capped", "string").alias("max_result_state"), (digit("provisional") == 1).alias("identity_provisional"),
        pick(_TRUTHS, "scope", "boolean").alias("scope"), pick([v for v, _ in _VERSIONS], "version", "boolean").alias("version"), pick([r for _, r in _VERSIONS], "version", "string").alias("version_reason"),
    )
    df = df.withColumn("predicate", tri_and(c("role"), c("scope"), c("configuration"), c("version")))

    def bits() -> Column:
        asked = {**conditions(), "holds": F.coalesce("predicate", F.lit(False)), "unclear": F.col("predicate").isNull()}
        return sum((F.shiftleft(v.cast("bigint"), i) for i, v in enumerate(asked.values())), F.lit(0).cast("bigint"))

    facts = df.withColumn("facts", bits())
    return facts.withColumns({"predicate": F.lit(None).cast("boolean"), "version_reason": F.lit(_REASONS[_COVERAGE])}).withColumn("weak", bits()).select("code", "facts", "weak")


def answers(requests: DataFrame, assertions: DataFrame, subjects: DataFrame, axes: list[str], broad: bool = False) -> DataFrame:
    """(request, subject, state, reasons) for each subject with an assertion about a request's product.

    ``subjects(subject, enrichment, provisional, history_action, history_basis)``.

    The result of :func:`evaluated`, :func:`closed` and ``finalize``, made for very many pairs
    of request and assertion: keys of versions are made once for each distinct version and
    segment; a pair is then a few comparisons, and the conditions it meets are looked up as
    bits. Pairs are joined by product and aggregated where they are made, by claim group,
    then by subject; they are not shuffled, unless a request names several products or a
    product is hot.
    """
    c, coded = F.col, F.coalesce
    names = _bit_names()
    bit = {n: i for i, n in enumerate(names)}
    zero = F.lit(0).cast("bigint")
    has = lambda facts, name: F.shiftright(facts, bit[name]).bitwiseAND(F.lit(1).cast("bigint"))
    shifted = lambda value, by: F.call_function("shiftleft", value, by)
    mask = lambda facts, name, reason: shifted(has(facts, f"all_{name}"), reason).bitwiseOR(shifted(has(facts, f"firm_{name}"), reason + _FIRM))

    code = F.lit(0)
    for (_, n), digit in zip(_DIGITS, (
        _digit(role_truth(c("cpe_match_role")), _TRUTHS), _digit(c("configuration"), _TRUTHS), _digit(c("source_family"), _SOURCES), _digit(c("polarity"), _POLARITIES),
        coded(c("reconciliation") == "conflict_review", F.lit(False)).cast("int"), coded(c("max_result_state") == "potentially_affected", F.lit(False)).cast("int"), coded("identity_provisional", F.lit(False)).cast("int"),
    )):
        code = code * n + digit
    said = assertions.select("product", "subject", "claim_group", "is_default", "segment", coded(c("branch_coverage") == "complete", F.lit(False)).alias("_complete"), code.alias("_code"), *[f"{a}_{x}" for a in axes for x in ("state", "values")])
    said = on_distinct(said, {"segment": c("segment")}, lambda df: asked_segments(df, "segment", "_segment"), "_segment", F.xxhash64("product", "subject", "claim_group")).drop("segment")
    said = branch_span(said, ["product", "subject", "claim_group"], "_segment.branch")
    asked = requests.select("request", "product", c("version").alias("asked_version"), *[c(f"{a}_{x}").alias(f"asked_{a}_{x}") for a in axes for x in ("state", "value")])
    asked = on_distinct(asked, {"version": c("asked_version")}, lambda df: asked_versions(df, "version", "_asked"), "_asked", c("request")).drop("asked_version")

    met = salted_join(asked, said, "product", hot_keys(requests, "product", requests.count()), c("request"))
    each = {a: scope_axis(c(f"asked_{a}_state"), c(f"asked_{a}_value"), c(f"{a}_state"), c(f"{a}_values"), broad) for a in axes}
    met = met.withColumn("_scope", scope(each)[0] if each else F.lit(True))
    met = reason_code(met, c("_asked"), c("_segment"), c("_complete"), c("first_branch"), c("last_branch"), "_reason")
    first_false, first_open = REASON_CODES["version_not_applicable"], REASON_CODES["cpe_any_uncorroborated"]
    version = F.when(c("_reason") < first_false, 0).when(c("_reason") == first_false, 3).when(c("_reason") < first_open, 1).otherwise(2)
    met = met.select("product", "request", "subject", "claim_group", "is_default", "_reason", ((c("_code") * 3 + _digit(c("_scope"), _TRUTHS)) * 4 + version).cast("bigint").alias("code"))
    met = met.join(F.broadcast(_facts_table(requests)), "code")
    # Explicit assertions; defaults that hold, as they are and weakened; other defaults.
    kind = F.when(~c("is_default"), 0).when(c("is_default") & (has(c("facts"), "holds") == 1), 1).otherwise(2)
    met = met.select("product", "request", "subject", "claim_group", "facts", "weak", kind.alias("_kind"), *[mask(c("facts"), name, c("_reason")).alias(name) for name in TOLD])
    part = lambda k, name: F.bit_or(F.when(c("_kind") == k, c(name)).otherwise(zero))
    sums = {f"{k}_{name}": part(k, name) for k, of in ((0, ("facts", *TOLD)), (1, ("facts", "weak", "yes", "no")), (2, ("facts", *TOLD))) for name in of}
    # A request of one product meets its assertions where that product is: then no pair leaves its task.
    several = requests.groupBy("request").agg((F.min("product") != F.max("product")).alias("several")).where("several").limit(1).count() > 0
    by = ["request", "subject"] if several else ["product", "request", "subject"]
    groups = met.groupBy(*by, "claim_group").agg(*[v.alias(n) for n, v in sums.items()])
    groups = groups.withColumns({"_answered": has(c("0_facts"), "holds") == 1, "_open": has(c("0_facts"), "unclear") == 1})
    beside = lambda name, plain, weak=zero: c(f"0_{name}").bitwiseOR(F.when(c("_answered"), zero).otherwise(c(f"2_{name}").bitwiseOR(F.when(c("_open"), weak).otherwise(plain))))
    closed_groups = groups.select(
        *by, beside("facts", c("1_facts"), c("1_weak")).alias("facts"), beside("yes", c("1_yes")).alias("yes"), beside("no", c("1_no")).alias("no"),
        beside("open", zero, mask(c("1_weak"), "open", F.lit(_COVERAGE))).alias("open"), beside("range", zero).alias("range"),
    )
    g = closed_groups.groupBy(*by).agg(*[F.bit_or(n).alias(n) for n in ("facts", *TOLD)])
    g = g.join(subjects, "subject", "left").select("request", "subject", "enrichment", "provisional", "history_action", "history_basis", *TOLD, *[(has(c("facts"), n) == 1).alias(f"_f_{n}") for n in names[:-2]])
    # A request or subject without a name has no assertion that could be told to be its own.
    g = g.withColumn("_f_n", c("_f_n") & c("request").isNotNull() & c("subject").isNotNull())
    g = decided(g.withColumnsRenamed({n: f"_told_{n}" for n in TOLD}).withColumnsRenamed({f"_f_{n}": n for n in names[:-2]}))
    side = lambda name: F.when(c("firm"), F.shiftright(c(f"_told_{name}"), _FIRM)).otherwise(c(f"_told_{name}"))
    bits = F.when(c("verdict.side") == TOLD[0], side(TOLD[0]))
    for name in TOLD[1:]:
        bits = bits.when(c("verdict.side") == name, side(name))
    g = g.select("request", "subject", "verdict", bits.alias("_why"))
    spelled = F.array_compact(F.array(*[F.when(F.shiftright(c("_why"), _REASONS.index(r)).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(r)) for r in sorted(_REASONS)]))
    return g.select("request", "subject", "verdict.state", told(c("verdict"), dict.fromkeys(TOLD, spelled)).alias("reasons"))
