"""What a record's sources claim: how far it is enriched, the scope and the role of a platform name, and lower ends that one source lends another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V

#: Vendors and products that are distributions, and vendors whose names are nothing but packages.
DISTRIBUTION_VENDORS = ("almalinux", "alpinelinux", "amazon", "canonical", "centos", "debian", "fedora", "gentoo", "mageia", "opensuse", "oracle", "redhat", "rocky", "suse", "ubuntu")
DISTRIBUTION_PRODUCTS = (
    "almalinux", "alpine_linux", "amazon_linux", "centos", "debian_linux", "enterprise_linux", "enterprise_linux_desktop", "enterprise_linux_server", "enterprise_linux_workstation", "fedora", "linux", "linux_enterprise_server",
    "opensuse", "oracle_linux", "red_hat_enterprise_linux", "rocky_linux", "sles", "suse_linux_enterprise_server", "ubuntu_linux",
)
PACKAGE_VENDORS = ("almalinux", "alpinelinux", "centos", "debian", "fedora", "gentoo", "mageia", "opensuse", "rocky", "ubuntu")
#: States that count as a hit under each policy.
POSITIVE_STATES = {"strict": ("affected",), "inclusive": ("affected", "potentially_affected", "conflict_review")}
AXES = ("part", "edition", "update", "language", "sw_edition", "target_sw", "target_hw", "other")


def enrichment_class(status: Column, has_platforms: Column, has_products: Column) -> Column:
    """rejected, else nvd_enriched with platform names, else cna_only with stated products, else unenriched."""
    return F.when(F.lower(status) == "rejected", "rejected").when(has_platforms, "nvd_enriched").when(has_products, "cna_only").otherwise("unenriched")


def marker_axis(raw: Column) -> Column:
    """struct<state, values> of one field of a platform name: ``*`` any, ``-`` not applicable, empty unknown, else exact."""
    none = F.array().cast("array<string>")
    axis = lambda state, values: F.struct(F.lit(state).alias("state"), values.alias("values"))
    return F.when(raw == "*", axis("ANY", none)).when(raw == "-", axis("NOT_APPLICABLE", none)).when(raw == "", axis("UNKNOWN", none)).otherwise(axis("EXACT", F.array(raw)))


def set_axis(values: Column) -> Column:
    """struct<state, values> of several stated values, sorted, each once: unknown for none, any if ``*`` is among them."""
    some = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))
    none = F.array().cast("array<string>")
    axis = lambda state, values: F.struct(F.lit(state).alias("state"), values.alias("values"))
    return (
        F.when(F.size(some) == 0, axis("UNKNOWN", none))
        .when(F.array_contains(some, "*"), axis("ANY", none))
        .when((F.size(some) == 1) & (F.get(some, F.lit(0)) == "-"), axis("NOT_APPLICABLE", none))
        .when(F.size(some) == 1, axis("EXACT", some))
        .otherwise(axis("SET", some))
    )


def cpe_axes(fields: dict[str, Column], role: Column) -> dict[str, Column]:
    """The scope that a platform name states: its eight fields, and the distribution or component that its role makes it."""
    name = F.array(F.concat(T.ascii_key(fields["vendor"]), F.lit(":"), T.ascii_key(fields["product"])))
    none = F.struct(F.lit("ANY").alias("state"), F.array().cast("array<string>").alias("values"))
    named = F.struct(F.lit("EXACT").alias("state"), name.alias("values"))
    out = {a: marker_axis(fields[a]) for a in AXES if a in fields}
    return out | {"distribution": F.when(role.isin("DOWNSTREAM_DISTRIBUTION", "DOWNSTREAM_PACKAGE"), named).otherwise(none), "component": F.when(role == "BUNDLED_COMPONENT", named).otherwise(none)}


def match_role(vulnerable: Column, part: Column, vendor_key: Column, product_key: Column, stated: Column) -> Column:
    """The role of a platform name in its condition; ``stated`` is whether the record's own source names the same product."""
    return (
        F.when(~vulnerable & (part == "h"), "REQUIRED_HARDWARE")
        .when(~vulnerable, "REQUIRED_PLATFORM")
        .when(vendor_key.isin(*DISTRIBUTION_VENDORS) & product_key.isin(*DISTRIBUTION_PRODUCTS), "DOWNSTREAM_DISTRIBUTION")
        .when(stated, "DIRECT_UPSTREAM")
        .when(vendor_key.isin(*PACKAGE_VENDORS), "DOWNSTREAM_PACKAGE")
        .otherwise("UNRESOLVED")
    )


def with_roles(matches: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """``matches(keys, vulnerable, part, vendor_key, product_key)`` with ``role``, by an equi-join with the products that ``stated`` names."""
    named = stated.select(*keys, "vendor_key", "product_key").distinct().withColumn("_stated", F.lit(True))
    out = matches.join(named, [*keys, "vendor_key", "product_key"], "left")
    return out.withColumn("role", match_role(F.col("vulnerable"), F.col("part"), F.col("vendor_key"), F.col("product_key"), F.coalesce("_stated", F.lit(False)))).drop("_stated")


def positive(state: Column, policy: str = "strict") -> Column:
    """Whether a state counts as a hit: affected alone, or all that may be."""
    return state.isin(*POSITIVE_STATES[policy])


def lend_lower_ends(stated: DataFrame, platforms: DataFrame, keys: list[str], profile: str = "dotted") -> DataFrame:
    """``stated(keys, upper, upper_inclusive, ...)``, ranges from 0 on, with the ``lower`` and ``lower_inclusive`` that platform ranges lend them.

    Where a product of a record has two upper ends or more that are all said to begin at 0,
    these are parallel lines whose starts are missing. A range then takes the lower end of
    the platform ranges that end where it does, if that is one and below, and none of these
    is open. Ends are equal as versions: equi-joins on their keys.
    """
    key = lambda c: V.strict_key(F.col(c), profile)
    s = stated.withColumn("_up", key("upper"))
    lines = s.groupBy(*keys).agg(F.count_distinct("_up").alias("_lines"))
    p = platforms.where("upper is not null").select(*keys, key("upper").alias("_up"), "upper_inclusive", F.col("lower").alias("_lower"), F.col("lower_inclusive").alias("_in"), F.when(F.col("lower").isNotNull(), key("lower")).alias("_low"))
    below = F.col("_low") < F.col("_up")
    lent = p.groupBy(*keys, "_up", "upper_inclusive").agg(
        F.bool_or(F.col("_lower").isNull()).alias("_open"), F.count_distinct(F.when(below, F.struct("_lower", "_in"))).alias("_n"), F.min(F.when(below, F.struct(F.col("_lower").alias("lower"), F.col("_in").alias("inclusive")))).alias("_lent")
    )
    out = s.join(lines, keys).join(lent, [*keys, "_up", "upper_inclusive"], "left")
    take = (F.col("_lines") >= 2) & (F.col("_n") == 1) & ~F.col("_open")
    return out.withColumn("lower", F.when(take, F.col("_lent.lower"))).withColumn("lower_inclusive", F.when(take, F.col("_lent.inclusive"))).drop("_up", "_lines", "_open", "_n", "_lent")
