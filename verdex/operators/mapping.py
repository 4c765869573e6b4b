"""Repositories and products: candidates by tier, claims, and what is left unmapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def best_candidate(candidates: DataFrame, keys: list[str], priority: Column, evidence: Column, method: str) -> DataFrame:
    """The best candidate of each pair by priority, then evidence, then method; evidence of that method is summed."""
    best = candidates.groupBy(*keys).agg(F.max_by(method, F.struct(priority, evidence, F.col(method))).alias("best_method"), F.count(F.lit(1)).alias("candidates"))
    same = candidates.join(best, keys).where(F.col(method) == F.col("best_method"))
    return same.groupBy(*keys, "best_method", "candidates").agg(F.sum(evidence).alias("evidence"))


def single_claims(claims: DataFrame, product: str, claimant: str, order: list[Column]) -> DataFrame:
    """(product, claimant, claimants, status): the claimant at the top if it is alone there, else a tie that takes all out."""
    ranked = claims.withColumn("_rank", F.rank().over(Window.partitionBy(product).orderBy(*order)))
    top = ranked.groupBy(product).agg(F.count(F.when(F.col("_rank") == 1, 1)).alias("_top"), F.min(F.when(F.col("_rank") == 1, F.col(claimant))).alias(claimant), F.count(F.lit(1)).alias("claimants"))
    return top.select(product, F.when(F.col("_top") == 1, F.col(claimant)).alias(claimant), "claimants", F.when(F.col("_top") == 1, "accepted").otherwise("tie").alias("status"))


def funnel(stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(stage, survivors, dropped): distinct keys that reach each stage, and those of the one before that don't."""
    out, before = None, None
    for i, (name, df) in enumerate(stages):
        here = df.select(key).where(F.col(key).isNotNull()).distinct()
        lost = F.lit(0).cast("long") if before is None else None
        n = here.agg(F.count(F.lit(1)).alias("survivors"))
        if before is None:
            row = n.withColumn("dropped", lost)
        else:
            gone = before.join(here, key, "left_anti").agg(F.lit(None).cast("long").alias("survivors"), F.count(F.lit(1)).alias("dropped"))
            row = n.withColumn("dropped", F.lit(None).cast("long")).unionByName(gone).agg(F.max("survivors").alias("survivors"), F.max("dropped").alias("dropped"))
        row = row.select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "survivors", "dropped")
        out = row if out is None else out.unionByName(row)
        before = here
    return out


def vendor_basis(owner: Column, vendor: Column, clustered: Column, product_alias: Column, curated: Column) -> Column:
    """How two vendor keys are known to be one, strongest first; NULL if they are not.

    ``clustered`` and ``product_alias`` say whether the pair lies in one strict cluster, or
    is an alias for this product; ``curated`` is the basis of a curated rule for it, or NULL.
    """
    x, y = T.separator_key(owner), T.separator_key(vendor)
    core_x, core_y = T.separator_key(T.strip_organisation(owner)), T.separator_key(T.strip_organisation(vendor))
    return F.when((owner != "") & (vendor != ""), (
        F.when(owner == vendor, "vendor_exact")
        .when(x == y, "vendor_separator_variant")
        .when(clustered, "strict_vendor_cluster")
        .when(product_alias, "product_alias_vendor")
        .when(curated.isNotNull(), F.concat(F.lit("curated_vendor_alias:"), curated))
        .when((F.char_length(core_x) >= 4) & (core_x == core_y), "vendor_organisation_suffix_variant")
    ))


def reference_name_method(owner: Column, name: Column, vendor: Column, product: Column, basis: Column, curated_pair: Column) -> Column:
    """How a repository that a record refers to agrees with a product of that record, strongest first; NULL if it does not.

    All names are keys; ``basis`` is :func:`vendor_basis`, ``curated_pair`` whether the
    repository is listed as an alias of the product. An exact product name is enough, as
    the record itself names the repository; weaker forms need the vendors to agree.
    """
    o, n, v, p = (T.separator_key(c) for c in (owner, name, vendor, product))
    known = basis.isNotNull()
    lead = F.when(n.endswith(p) & (p != ""), F.substring(n, F.lit(1), F.char_length(n) - F.char_length(p)))
    composed = (lead != "") & ((lead == o) | (lead == v) | T.prefix_abbreviation(lead, o) | T.prefix_abbreviation(lead, v))
    variant = T.separator_key(T.without_variant_words(name))
    return (
        F.when(curated_pair, "reference_curated_product_alias")
        .when(name == product, "reference_exact_product")
        .when((n == p) & ((owner == vendor) | (o == v) | known), "reference_separator_alias")
        .when(composed, "reference_owner_product_composition")
        .when(T.acronym_match(name, product) & known, "reference_acronym")
        .when((variant == p) & (n != p) & known, "reference_product_variant")
        .when(T.prefix_abbreviation(name, product) & known, "reference_prefix_abbreviation")
    )


def part_compatible(a: Column, b: Column) -> Column:
    """Whether products of two kinds may be one: a application, o operating system, h hardware, ``*`` any, unknown.

    Hardware and systems meet only their like or any; an application meets any and unknown.
    """
    one = lambda value: (a == value) | (b == value)
    both_in = lambda *values: a.isin(*values) & b.isin(*values)
    return (
        F.when(a == b, True)
        .when(one("h"), both_in("h", "*"))
        .when(one("o"), both_in("o", "*"))
        .when(one("unknown") | one("*"), both_in("a", "unknown", "*"))
        .otherwise(False)
    )


def compatible_parts(part: Column) -> Column:
    """The kinds that are :func:`part_compatible` with one."""
    kinds = lambda *values: F.array(*[F.lit(v) for v in values])
    return F.when(part == "*", kinds("*", "a", "h", "o", "unknown")).when(part.isin("h", "o"), F.array(part, F.lit("*"))).when(part.isin("a", "unknown"), kinds("*", "a", "unknown")).otherwise(F.array(part))
