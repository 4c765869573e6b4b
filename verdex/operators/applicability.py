"""From assertions about a subject to its state: scopes, defaults, evidence, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tri import tri_and
from ..plans.skew import first_values

#: The states of a subject.
STATES = ("affected", "potentially_affected", "not_affected_asserted", "not_affected_out_of_range", "not_applicable", "conflict_review", "product_only_observation", "insufficient_data")
#: How much a source, a class of version range and a role weigh.
AUTHORITY = {"cna_structured": 3, "manual_review": 3, "osv": 2, "ghsa": 2, "nvd_cpe": 1, "advisory_text": 1, "llm_description": 0, "rule_ner": 0}
STRUCTUREDNESS = {"cna_structured": 2, "manual_review": 2, "osv": 2, "ghsa": 2, "nvd_cpe": 2, "advisory_text": 0, "llm_description": 1, "rule_ner": 1}
VERSION_SPECIFICITY = {"EXACT": 4, "BOUNDED_RANGE": 3, "BRANCH_RANGE": 3, "UNBOUNDED_RANGE": 2, "EXPLICIT_ALL": 1}
DIRECTNESS = {"DIRECT_UPSTREAM": 2, "DIRECT_ALTERNATIVE_PRODUCT": 1}


def scope_axis(query_state: Column, query_value: Column, stated: Column, values: Column, broad: bool = False) -> Column:
    """One axis of a scope: does what is asked for fall into what is stated?

    States are ANY, EXACT, SET, NOT_APPLICABLE and UNKNOWN; ``values`` is the array of keys
    that EXACT or SET states, ``query_value`` a key. A stated ANY takes all; NOT_APPLICABLE
    takes its like and refuses what is exact; what is stated exactly refuses NOT_APPLICABLE,
    and leaves ANY unknown unless ``broad``. All else is unknown.
    """
    unknown = F.lit(None).cast("boolean")
    inside = F.when(query_state == "EXACT", F.coalesce(F.array_contains(values, query_value), F.lit(False))).when(query_state == "NOT_APPLICABLE", False)
    inside = inside.when(query_state == "ANY", True) if broad else inside
    apart = F.when(query_state == "NOT_APPLICABLE", True).when(query_state.isin("ANY", "UNKNOWN"), unknown).otherwise(False)
    return F.when(stated == "ANY", True).when(stated == "NOT_APPLICABLE", apart).when(stated.isin("EXACT", "SET"), inside).otherwise(unknown)


def scope(axes: dict[str, Column]) -> tuple[Column, Column]:
    """All axes together, and the names of those that are unknown."""
    names = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in axes.items()]))
    return tri_and(*axes.values()), names


def apply_default_closure(df: DataFrame, group: list[str], is_default: Column, truth: Column) -> DataFrame:
    """Drop or weaken a group's default assertions by its explicit ones.

    An explicit TRUE removes the defaults; an explicit unknown turns a default TRUE into
    unknown. Group facts come from one aggregate and a join, so that a hot group is
    neither sorted nor held in one task.
    """
    marked = df.withColumn("_default", is_default).withColumn("_truth", truth)
    facts = marked.where("not _default").groupBy(*group).agg(F.bool_or(F.coalesce("_truth", F.lit(False))).alias("_explicit_true"), F.bool_or(F.col("_truth").isNull()).alias("_explicit_unknown"))
    out = marked.join(facts, group, "left")
    out = out.where(~(F.col("_default") & F.coalesce("_explicit_true", F.lit(False))))
    closed = F.when(F.col("_default") & F.col("_truth") & F.coalesce("_explicit_unknown", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.col("_truth"))
    return out.withColumn("truth", closed).drop("_default", "_truth", "_explicit_true", "_explicit_unknown")


def _no(c: Column) -> Column:
    """Certainly false."""
    return F.coalesce(~c, F.lit(False))


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))


def _source_conditions(name: str, here: Column) -> dict[str, Column]:
    """What to look for among one source's assertions, for its result to follow."""
    relevant = here & ~_no(F.col("role")) & ~_no(F.col("scope")) & ~_no(F.col("configuration"))
    holds = F.coalesce(F.col("predicate"), F.lit(False))
    return {
        f"{name}_yes": relevant & holds & (F.col("polarity") == "affected"),
        f"{name}_no": relevant & holds & (F.col("polarity") == "unaffected"),
        f"{name}_open": relevant & F.col("predicate").isNull() & F.col("polarity").isin("affected", "unknown"),
        f"{name}_any": relevant,
        f"{name}_in": relevant & ~_no(F.col("version")),
    }


def _source_result(name: str) -> Column:
    yes, no, unclear, some, inside = (F.col(f"{name}_{x}") for x in ("yes", "no", "open", "any", "in"))
    return F.when(yes & no, "conflict").when(yes, "affected").when(no, "unaffected").when(unclear, "unknown").when(some & ~inside, "out_of_range")


def source_results(assertions: DataFrame, keys: list[str], source: str = "source_family") -> DataFrame:
    """The result of each source of a subject: conflict, affected, unaffected, unknown, out_of_range, or NULL where it says nothing.

    ``assertions`` has polarity and the three-valued role, scope, configuration, version and
    predicate. What role, scope or configuration rule out is not looked at; an unknown
    predicate counts unless its assertion is one of not being affected.
    """
    facts = assertions.groupBy(*keys, source).agg(*[_any(c).alias(n) for n, c in _source_conditions("s", F.lit(True)).items()])
    return facts.select(*keys, source, _source_result("s").alias("result"))


#: Reasons of a side's assertions that are told, and the conditions they are told under.
TOLD = ("yes", "no", "open", "range")


def conditions() -> dict[str, Column]:
    """What :func:`decided` asks of a subject's assertions, as conditions on one: ``all_`` over all, ``firm_`` over all but model evidence."""
    col = F.col
    holds, unknown = F.coalesce(col("predicate"), F.lit(False)), col("predicate").isNull()
    ruled_out = _no(col("scope")) | _no(col("configuration"))
    out_of_range = _no(col("version")) & ~ruled_out
    model = F.coalesce(col("source_family") == "llm_description", F.lit(False))
    provisional = F.coalesce(col("identity_provisional"), F.lit(False))
    found = {
        "n": F.lit(True),
        "review": (col("reconciliation") == "conflict_review") & ~_no(col("predicate")),
        **_source_conditions("nvd", F.coalesce(col("source_family") == "nvd_cpe", F.lit(False))),
        **_source_conditions("cna", F.coalesce(col("source_family") == "cna_structured", F.lit(False))),
    }
    for side, here in (("all", F.lit(True)), ("firm", ~model)):
        yes = here & holds & (col("polarity") == "affected")
        found |= {
            f"{side}_yes": yes, f"{side}_no": here & holds & (col("polarity") == "unaffected"), f"{side}_open": here & unknown & col("polarity").isin("affected", "unknown"),
            f"{side}_weak": yes & ((col("max_result_state") == "potentially_affected") | provisional), f"{side}_alias": yes & provisional,
            f"{side}_ruled": here & ruled_out, f"{side}_range": here & out_of_range, f"{side}_rest": here & ~ruled_out & ~out_of_range,
            f"{side}_range_other": here & out_of_range & (F.coalesce(col("version_reason"), F.lit("")) != "version_not_applicable"),
        }
    return {name: F.coalesce(c, F.lit(False)) for name, c in found.items()}


def finalize(assertions: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, reasons): the state of each subject and why, sorted.

    ``assertions`` are the columns of :func:`source_results` with source_family,
    version_reason, reconciliation, max_result_state and identity_provisional; ``subjects``
    has one row of keys, enrichment, provisional, history_action and history_basis.

    Reasons come from a fixed vocabulary, so their sets are small.
    """
    asked = conditions()
    facts = {n: F.bool_or(c) for n, c in asked.items()}
    facts |= {f"{side}_{name}_why": F.array_sort(F.collect_set(F.when(asked[f"{side}_{name}"], F.col("version_reason")))) for side in ("all", "firm") for name in TOLD}
    g = decided(subjects.join(assertions.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()]), keys, "left"))
    return g.select(*keys, "verdict.state", told(F.col("verdict"), {name: F.when(F.col("firm"), F.col(f"firm_{name}_why")).otherwise(F.col(f"all_{name}_why")) for name in TOLD}).alias("reasons"))


def told(verdict: Column, why: dict[str, Column]) -> Column:
    """The reasons of a verdict: those of the side that it names, sorted, with what it adds; else what it says itself."""
    side = reduce(lambda chain, name: chain.when(verdict["side"] == name, why[name]), TOLD[1:], F.when(verdict["side"] == TOLD[0], why[TOLD[0]]))
    return F.when(verdict["side"].isNull(), verdict["said"]).when(F.size(verdict["said"]) > 0, F.array_sort(F.array_distinct(F.concat(side, verdict["said"])))).otherwise(side)


def decided(g: DataFrame) -> DataFrame:
    """``g`` with ``firm`` and ``verdict``, a struct<state, side, said>: where ``side`` is given, its reasons are those of the verdict.

    ``g`` has the columns of a subject and of :func:`conditions`, whether any assertion meets them.

    One ordered cascade: a rejected record; no assertion; an assertion under review; a
    structured source at odds with itself; the two structured sources at odds, unless the
    change history decides; then, without model evidence where a structured source decides,
    what holds for and against, what is unknown, and what rules the subject out.
    """
    col = F.col
    g = g.withColumn("nvd", _source_result("nvd")).withColumn("cna", _source_result("cna"))
    results = ("affected", "unaffected", "out_of_range")
    g = g.withColumn("firm", F.coalesce(col("nvd").isin(*results) | col("cna").isin(*results), F.lit(False)))
    pick = lambda name: F.when(col("firm"), col(f"firm_{name}")).otherwise(col(f"all_{name}"))
    verdict = lambda state, side, said: F.struct(F.lit(state).alias("state"), F.lit(side).cast("string").alias("side"), said.cast("array<string>").alias("said"))
    said = lambda state, *why: verdict(state, None, F.array(*[w if isinstance(w, Column) else F.lit(w) for w in why]))
    by = lambda state, side, more=None: verdict(state, side, F.array() if more is None else more)
    at_odds = col("nvd").isin(*results) & col("cna").isin(*results) & ((col("nvd") == "affected") != (col("cna") == "affected"))
    basis = F.coalesce(col("history_basis"), F.lit(""))
    newest = lambda result: at_odds & (col("history_action") == "prefer_latest_cpe") & (col("nvd") == result)
    alias = F.when(pick("alias"), F.array(F.lit("identity_alias_provisional"))).otherwise(F.array().cast("array<string>"))
    ranged = pick("range") & ~pick("rest")
    found = (
        F.when(col("enrichment") == "rejected", said("insufficient_data", "rejected_upstream"))
        .when(~F.coalesce(col("n"), F.lit(False)), said("product_only_observation", "no_active_assertion"))
        .when(col("review"), said("conflict_review", "authoritative_source_conflict"))
        .when((col("nvd") == "conflict") | (col("cna") == "conflict"), said("conflict_review", "source_family_internal_conflict"))
        .when(newest("affected"), said("affected", "history_latest_cpe_affected", basis))
        .when(newest("unaffected"), said("not_affected_asserted", "history_latest_cpe_unaffected", basis))
        .when(newest("out_of_range"), said("not_affected_out_of_range", "history_latest_cpe_out_of_range", basis))
        .when(at_odds & (col("history_action") == "accept_added_range"), said("affected", "history_added_range_accepted", basis))
        .when(at_odds, said("conflict_review", "nvd_cna_result_conflict"))
        .when(pick("yes") & pick("no"), said("conflict_review", "active_polarity_conflict"))
        .when(pick("no"), by("not_affected_asserted", "no"))
        .when(pick("yes") & (F.coalesce(col("provisional"), F.lit(False)) | pick("weak")), by("potentially_affected", "yes", alias))
        .when(pick("yes"), by("affected", "yes"))
        .when(pick("open"), by("potentially_affected", "open"))
        .when(ranged & ~pick("range_other"), by("not_applicable", "range"))
        .when(ranged, by("not_affected_out_of_range", "range"))
        .when(pick("ruled"), said("not_applicable", "scope_or_configuration_false"))
        .when(col("enrichment") == "unenriched", said("insufficient_data", "nvd_unenriched"))
        .otherwise(said("product_only_observation", "no_positive_assertion"))
    )
    return g.withColumn("verdict", found)


def evidence_rank(source: Column, version_class: Column, role: Column, scope_specificity: Column, freshness: Column, corroboration: Column) -> Column:
    """What an assertion weighs, as a struct that compares in order: authority, structuredness, scope, specificity, directness, freshness, corroboration."""
    table = lambda of, key: F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.coalesce(key, F.lit(""))], F.lit(0))
    held = lambda c, most: F.greatest(F.lit(0), F.least(F.coalesce(c, F.lit(0)), F.lit(most)))
    return F.struct(
        table(AUTHORITY, source).alias("authority"), table(STRUCTUREDNESS, source).alias("structuredness"), held(scope_specificity, 3).alias("scope"), table(VERSION_SPECIFICITY, version_class).alias("specificity"),
        table(DIRECTNESS, role).alias("directness"), held(freshness, 2).alias("freshness"), held(corroboration, 2).alias("corroboration"),
    )


def preferred(df: DataFrame, keys: list[str], polarity: str, rank: str, ordinal: str) -> DataFrame:
    """The best affected and the best unaffected assertion of each key, as their ranks and ordinals: greatest rank, then least ordinal."""
    row = F.struct(F.col(rank).alias("rank"), F.col(ordinal).alias("ordinal"))
    best = F.struct(F.col(rank), (-F.col(ordinal)).alias("_first"))
    pick = lambda p: F.max_by(F.when(F.col(polarity) == p, row), F.when(F.col(polarity) == p, best))
    return df.groupBy(*keys).agg(pick("affected").alias("affected"), pick("unaffected").alias("unaffected"))


def outweighs(a: Column, b: Column) -> Column:
    """Whether one rank wins over another: some specificity over none, then direct over indirect, then the whole rank.

    The two overrides look at nothing between: a lower specificity that isn't none does not
    lose by it. So the relation is no total order; it is only ever asked of two ranks.
    """
    return (
        F.when((a["specificity"] > 0) & (b["specificity"] == 0), True)
        .when((a["specificity"] == 0) & (b["specificity"] > 0), False)
        .when((a["directness"] == 2) & (b["directness"] == 0), True)
        .when((a["directness"] == 0) & (b["directness"] == 2), False)
        .otherwise(a > b)
    )


def evidence_winner(affected: Column, unaffected: Column) -> Column:
    """Which side's best assertion holds by :func:`outweighs`; review where neither does."""
    a, b = affected["rank"], unaffected["rank"]
    return (
        F.when(affected.isNull() & unaffected.isNull(), F.lit(None))
        .when(unaffected.isNull(), "affected_only")
        .when(affected.isNull(), "unaffected_only")
        .when(outweighs(a, b), "affected_wins")
        .when(outweighs(b, a), "unaffected_wins")
        .otherwise("conflict_review")
    )


def corroboration(df: DataFrame, keys: list[str], fingerprint: list[str], source: str, examples: int = 16) -> DataFrame:
    """Assertions that say the same: how many, from how many sources, and the first few sources, if any are asked for."""
    group = [*keys, *fingerprint]
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("assertions"), F.count_distinct(source).alias("sources"))
    return counted.join(first_values(df, group, source, examples, "examples"), group, "left") if examples else counted


def node_truth(operator: Column, negate: Column, falses: Column, unknowns: Column, trues: Column) -> Column:
    """An AND/OR node over counts of its children's values."""
    unknown = F.lit(None).cast("boolean")
    plain = F.when(operator == "AND", F.when(falses > 0, False).when(unknowns > 0, unknown).when(trues > 0, True)).otherwise(F.when(trues > 0, True).when(unknowns > 0, unknown).when(falses > 0, False))
    return F.when(F.coalesce(negate, F.lit(False)), ~plain).otherwise(plain)


def evaluate_tree(nodes: DataFrame, leaves: DataFrame, depth: int, key: str = "tree_id") -> DataFrame:
    """Truth of the root of each tree.

    ``nodes(tree_id, node, parent, level, operator, negate)`` with the root at level 0 and
    ``leaves(tree_id, parent, truth)``; one aggregate a level from the deepest up.
    """
    values = leaves.select(key, F.col("parent"), "truth")
    for level in range(depth, -1, -1):
        here = nodes.where(F.col("level") == level)
        count = lambda cond: F.count(F.when(cond, 1))
        t = F.col("truth")
        counts = values.groupBy(key, F.col("parent").alias("node")).agg(count(~t).alias("_f"), count(t.isNull()).alias("_u"), count(t).alias("_t"))
        solved = here.join(counts, [key, "node"], "left").withColumn("truth", node_truth(F.col("operator"), F.col("negate"), F.coalesce("_f", F.lit(0)), F.coalesce("_u", F.lit(0)), F.coalesce("_t", F.lit(0))))
        values = values.join(here.select(key, F.col("node").alias("parent")), [key, "parent"], "left_anti").unionByName(solved.select(key, "parent", "truth"))
    return solved.select(key, "node", "truth")
