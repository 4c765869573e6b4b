"""What a record states of its products against what its platform names state: identities and version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import range_relation

#: Levels of agreement, best first; verdicts on ranges, worst first; words that say nothing of a product.
LEVELS = ("exact", "product_only", "vendor_only", "loose", "none")
VERDICTS = ("scheme_mismatch", "disjoint", "partial_overlap", "cna_broader", "cpe_broader", "equal")
HARD_VERDICTS = ("disjoint", "partial_overlap", "scheme_mismatch")
STOP_WORDS = ("co", "corp", "corporation", "foundation", "gmbh", "group", "inc", "labs", "limited", "llc", "ltd", "open", "project", "software", "solutions", "source", "systems", "technologies", "technology")
_NAMES = {"left_broader": "cna_broader", "right_broader": "cpe_broader"}


def name_words(*names: Column) -> Column:
    """The words of names that tell something."""
    words = F.flatten(F.array(*[F.split(F.lower(F.coalesce(n, F.lit(""))), "[^0-9a-z]+") for n in names]))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def identity_matches(stated: DataFrame, platforms: DataFrame, subject: str) -> DataFrame:
    """(subject, item, level, vendor, product): of each stated product the platforms at its best level; one row of NULLs for none.

    ``stated(subject, item, vendor, product)`` and ``platforms(subject, vendor, product)``
    hold keys. Levels are equi-joins: both names, the product, the vendor, and a shared
    word where one side's words are all among the other's.
    """
    a = stated.select(subject, "item", F.col("vendor").alias("va"), F.col("product").alias("pa"), name_words(F.col("vendor"), F.col("product")).alias("wa"))
    b = platforms.select(subject, F.col("vendor").alias("vb"), F.col("product").alias("pb"), name_words(F.col("vendor"), F.col("product")).alias("wb"))
    wanted = [subject, "item", "vb", "pb"]
    by_product = a.join(b.withColumnRenamed("pb", "pa").withColumn("pb", F.col("pa")), [subject, "pa"]).withColumn("level", F.when(F.col("va") == F.col("vb"), 0).otherwise(1))
    by_vendor = a.join(b.withColumnRenamed("vb", "va").withColumn("vb", F.col("va")), [subject, "va"]).withColumn("level", F.lit(2))
    inside = (F.size(F.array_except("wa", "wb")) == 0) | (F.size(F.array_except("wb", "wa")) == 0)
    by_word = a.withColumn("word", F.explode("wa")).join(b.withColumn("word", F.explode("wb")), [subject, "word"]).where(inside).withColumn("level", F.lit(3))
    found = by_product.select(*wanted, "level").unionByName(by_vendor.select(*wanted, "level")).unionByName(by_word.select(*wanted, "level"))
    found = found.groupBy(*wanted).agg(F.min("level").alias("level"))
    best = found.groupBy(subject, "item").agg(F.min("level").alias("level"))
    names = F.array(*map(F.lit, LEVELS))
    out = stated.select(subject, "item").join(best.join(found, [subject, "item", "level"]), [subject, "item"], "left")
    return out.select(subject, "item", F.element_at(names, F.coalesce("level", F.lit(4)) + 1).alias("level"), F.col("vb").alias("vendor"), F.col("pb").alias("product"))


def conflict_axes(level: Column) -> tuple[Column, Column]:
    """Whether vendor and product are at odds at a level: the one that did not match is."""
    return level.isin("product_only", "loose", "none"), level.isin("vendor_only", "loose", "none")


def conflict_class(vendor: Column, product: Column) -> Column:
    return F.when(vendor & product, "vendor_and_product").when(vendor, "vendor_only").when(product, "product_only").otherwise("none")


def numeric_scale(bound: Column) -> Column:
    """Whether a version counts releases by numbers; ``20h2`` does not."""
    return F.lower(bound).rlike(r"^v?\d+([._+-].*)?$")


def _scales(ranges: DataFrame, keys: list[str], side: str) -> DataFrame:
    shown = F.filter(F.array("lower_text", "upper_text"), lambda x: x.isNotNull())
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    return ranges.groupBy(*keys).agg(some(F.exists(shown, numeric_scale)).alias(f"{side}_numeric"), some(F.exists(shown, lambda x: ~numeric_scale(x))).alias(f"{side}_token"))


def pair_verdicts(stated: DataFrame, stated_ranges: DataFrame, platform_ranges: DataFrame, matches: DataFrame, subject: str) -> DataFrame:
    """(subject, item, level, verdict, undecidable): each stated product's ranges against those of the platforms it matches.

    ``stated`` has inverted (its default is affected, so that what it lists is not what is)
    and blocker (why a statement of its can't be read, the commonest, or NULL);
    ``stated_ranges(subject, item, lower, upper, lower_text, upper_text)`` and
    ``platform_ranges(subject, vendor, product, blocker, ...)`` have ends by
    :func:`ranges.lower_end` and :func:`ranges.upper_end`, NULL in rows that are blockers.
    One unreadable statement makes a product undecidable: what is left would look narrower.
    """
    keys = [subject, "item"]
    levels = matches.groupBy(*keys).agg(F.first("level").alias("level"))
    met = matches.where("level <> 'none'").select(*keys, "vendor", "product").join(platform_ranges, [subject, "vendor", "product"])
    theirs = met.where("lower is not null")
    blocked = met.where("blocker is not null").groupBy(*keys, "blocker").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max_by("blocker", F.struct("n", "blocker")).alias("platform_blocker"))
    counts = stated_ranges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stated")), theirs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_platform"))
    relation = range_relation(stated_ranges.select(*keys, "lower", "upper"), theirs.select(*keys, "lower", "upper"), keys)
    rows = stated.select(*keys, "inverted", "blocker").join(levels, keys)
    for other in (blocked, *counts, relation, _scales(stated_ranges, keys, "a"), _scales(theirs, keys, "b")):
        rows = rows.join(other, keys, "left")
    reason = (
        F.when(F.col("level") == "none", None)
        .when(F.col("inverted"), "cna_inverted_default_status")
        .when(F.col("blocker").isNotNull(), F.concat(F.lit("cna_"), F.col("blocker")))
        .when(F.col("n_stated").isNull(), "cna_no_affected_versions")
        .when(F.col("platform_blocker").isNotNull(), F.concat(F.lit("cpe_"), F.col("platform_blocker")))
        .when(F.col("n_platform").isNull(), "cpe_no_version_axis")
    )
    said = (F.col("a_numeric") | F.col("a_token")) & (F.col("b_numeric") | F.col("b_token"))
    shared = (F.col("a_numeric") & F.col("b_numeric")) | (F.col("a_token") & F.col("b_token"))
    verdict = F.when((F.col("relation") == "disjoint") & said & ~shared, "scheme_mismatch").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("relation")], F.col("relation")))
    rows = rows.withColumn("undecidable", reason)
    return rows.select(*keys, "level", F.when(F.col("level") == "none", None).when(F.col("undecidable").isNotNull(), "undecidable").otherwise(verdict).alias("verdict"), "undecidable")


def record_summary(pairs: DataFrame, subject: str) -> DataFrame:
    """One row a record: its worst level, which names are at odds, its worst verdict on ranges, and whether any could not be decided."""
    rank = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c)
    vendor, product = conflict_axes(F.col("level"))
    g = pairs.groupBy(subject).agg(
        F.max(rank(LEVELS, F.col("level"))).alias("_level"), F.bool_or(vendor).alias("vendor_conflict"), F.bool_or(product).alias("product_conflict"),
        F.min(F.when(F.col("verdict").isin(*VERDICTS), rank(VERDICTS, F.col("verdict")))).alias("_verdict"), F.bool_or(F.col("undecidable").isNotNull()).alias("undecidable"),
    )
    at = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) - 1).cast("int"))
    out = g.withColumn("level", at(LEVELS, "_level")).withColumn("verdict", at(VERDICTS, "_verdict"))
    return out.select(subject, "level", conflict_class(F.col("vendor_conflict"), F.col("product_conflict")).alias("identity_conflict"), "verdict", F.coalesce(F.col("verdict") != "equal", F.lit(False)).alias("version_conflict"), F.coalesce(F.col("verdict").isin(*HARD_VERDICTS), F.lit(False)).alias("hard_conflict"), "undecidable")
