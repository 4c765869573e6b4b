"""Repositories bound to products and so to records: candidates, what carries them on, and the tables that answer by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.skew import hot_keys, salted_join
from ..plans.staging import staged
from .mapping import compatible_parts, part_compatible

#: Words that make a repository an artifact of its own, languages, and product names that many vendors use.
ARTIFACT_WORDS = (
    "driver", "drivers", "binding", "bindings", "sdk", "plugin", "plugins", "module", "modules", "operator", "operators", "shell", "cli", "agent", "proxy", "connector", "adapter", "wrapper", "extension", "extensions",
    "library", "libraries", "lib", "tool", "tools", "toolkit", "docs", "examples", "samples", "demo", "app", "apps", "mobile", "desktop", "theme", "themes", "wordpress", "wp", "frontend", "backend",
)
LANGUAGE_WORDS = ("c", "cpp", "cxx", "go", "golang", "java", "javascript", "js", "typescript", "ts", "python", "py", "ruby", "rb", "php", "rust", "dotnet", "net", "node", "nodejs", "android", "ios")
GENERIC_PRODUCTS = (
    "app", "application", "client", "core", "driver", "firmware", "framework", "library", "linux", "manager", "module", "plugin", "server", "service", "software", "system", "tool", "web",
    "reader", "android", "commerce", "java", "connect", "notes", "echo", "fabric", "discovery", "terminal",
)
BASIS_RANK = {"vendor_exact": 6, "vendor_separator_variant": 5, "strict_vendor_cluster": 5, "product_alias_vendor": 5, "vendor_organisation_suffix_variant": 4}


_DRIVERS = ("driver", "drivers", "binding", "bindings", "sdk")


def _words_among(key: Column, words: tuple[str, ...]) -> Column:
    """Which of at most 63 words are tokens of a key, as bits."""
    places = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, 1 << i)])
    return F.aggregate(T.tokens(key), F.lit(0).cast("bigint"), lambda bits, t: bits.bitwiseOR(F.coalesce(F.try_element_at(places, t).cast("bigint"), F.lit(0).cast("bigint"))))


def word_bits(key: Column) -> Column:
    """The words of a name that :func:`artifact_conflict` looks at, as a struct<artifact, language> of bits."""
    return F.struct(_words_among(key, ARTIFACT_WORDS).alias("artifact"), _words_among(key, LANGUAGE_WORDS).alias("language"))


def conflict_of_bits(name: Column, product: Column) -> Column:
    """:func:`artifact_conflict` of two names given by their :func:`word_bits`."""
    mine, theirs, spoken, other = name["artifact"], product["artifact"], name["language"], product["language"]
    drivers = F.lit(sum(1 << i for i, w in enumerate(ARTIFACT_WORDS) if w in _DRIVERS)).cast("bigint")
    return (
        F.when((mine != 0) & (theirs != 0) & (mine != theirs), "artifact_role_mismatch")
        .when((mine != 0) & (theirs == 0), "repo_is_distinct_artifact")
        .when((mine.bitwiseOR(theirs).bitwiseAND(drivers) != 0) & (spoken != 0) & (other != 0) & (spoken.bitwiseAND(other) == 0), "artifact_language_mismatch")
    )


def artifact_conflict(name: Column, product: Column) -> Column:
    """Why a repository of this name is no product of that one, or NULL: other artifacts, an artifact of its own, another language's driver."""
    return conflict_of_bits(word_bits(name), word_bits(product))


def exact_pairs(repositories: DataFrame, products: DataFrame) -> DataFrame:
    """(repo_key, product_id, method): repositories whose owner and name are a product's vendor and name."""
    met = repositories.join(products, (F.col("owner_key") == F.col("vendor_key")) & (F.col("name_key") == F.col("product_key")))
    return met.select("repo_key", "product_id", F.lit("exact_pair").alias("method"))


def cluster_expansion(candidates: DataFrame, members: DataFrame, evidence: DataFrame, blocked: DataFrame, products: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repo_key, product_id, anchor_id, cluster_id, reason), distinct: the strict cluster's other products of each candidate; ``reason`` is why one is refused, else NULL.

    ``members(cluster_id, product_id)`` are those of strict clusters, ``evidence(repo_key,
    product_id)`` direct references, ``blocked(a, b)`` pairs that are never one, a < b. A
    repository must refer to some member itself.

    The pairs are as many as the clusters are large, squared; so all that one side decides
    is made before they are, both sides have no row twice, and pairs are neither shuffled
    nor compared with each other. Large clusters are dealt to several tasks. Only products
    and repositories that are listed with several kinds or names can give a row twice;
    theirs alone are made distinct afterwards.
    """
    members = members.distinct()
    seen = evidence.join(members, "product_id").select("repo_key", "cluster_id").distinct()
    anchors = candidates.join(members, "product_id").join(seen, ["repo_key", "cluster_id"], "left_semi").select("repo_key", "cluster_id", F.col("product_id").alias("anchor_id")).distinct()
    several = lambda key, rows, what: rows.groupBy(key).agg(F.collect_set(what).alias("_all")).select(key, F.explode("_all").alias("_is"), (F.size("_all") > 1).alias("odd"))
    # A null kind meets none, though structs that hold it are equal.
    kinds = staged(several("product_id", products, F.struct("part", word_bits(F.col("product_key")).alias("words"))), "kinds")
    names = several("repo_key", repositories, F.struct(word_bits(F.col("name_key")).alias("words")))
    parts = kinds.select(F.col("product_id").alias("anchor_id"), F.explode(compatible_parts(F.col("_is.part"))).alias("part")).where("part is not null").distinct()
    # Blocked pairs within a cluster, both ways round, as a list beside the anchor.
    inside = blocked.where("a < b").select("a", "b").join(members.withColumnRenamed("product_id", "a"), "a").join(members.withColumnRenamed("product_id", "b"), ["cluster_id", "b"]).select("cluster_id", "a", "b")
    both = inside.select("cluster_id", F.col("a").alias("anchor_id"), F.col("b").alias("other")).union(inside.select("cluster_id", "b", "a"))
    refused = both.groupBy("cluster_id", "anchor_id").agg(F.collect_set("other").alias("refused"))
    anchors = anchors.join(parts, "anchor_id").join(names, "repo_key").join(refused, ["cluster_id", "anchor_id"], "left")
    anchors = staged(anchors.select("repo_key", "anchor_id", F.struct("cluster_id", "part").alias("_group"), "refused", F.col("_is.words").alias("name_words"), F.col("odd").alias("odd_name")), "anchors")
    targets = staged(members.join(kinds, "product_id").select("product_id", F.struct("cluster_id", "_is.part").alias("_group"), F.col("_is.words").alias("words"), F.col("odd").alias("odd_product")), "targets")
    hot = hot_keys(anchors, "_group", anchors.count())

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        met = salted_join(left.drop("odd_name"), right.drop("odd_product"), "_group", hot, F.struct("repo_key", "anchor_id"))
        met = met.where((F.col("product_id") != F.col("anchor_id")) & ~F.coalesce(F.array_contains("refused", F.col("product_id")), F.lit(False)))
        return met.select("repo_key", "product_id", "anchor_id", "_group.cluster_id", conflict_of_bits(F.col("name_words"), F.col("words")).alias("reason"))

    plain, single = anchors.where("not odd_name"), targets.where("not odd_product")
    out = pairs(plain, single)
    if anchors.where("odd_name").limit(1).count() or targets.where("odd_product").limit(1).count():
        out = out.union(pairs(anchors.where("odd_name"), targets).union(pairs(plain, targets.where("odd_product"))).distinct())
    return out


def product_key_bridge(candidates: DataFrame, products: DataFrame, repositories: DataFrame, evidence: DataFrame, bases: DataFrame) -> DataFrame:
    """(repo_key, product_id, anchor_id, basis): products that a repository takes on for a vendor known to be one with its own.

    A product name of four letters or more that candidates of one repository alone hold
    is carried to its other products, unless another repository is referred to for them.
    The best anchor wins: by the vendors' basis, then priority, then evidence.
    ``candidates(repo_key, product_id, priority, evidence, independent)``; ``bases(vendor_a,
    vendor_b, product_key, basis)`` are the known pairs of vendors, both ways round. A
    generic product name needs a curated or stored pair.
    """
    held = candidates.join(products, "product_id").select("repo_key", "product_key", F.col("product_id").alias("anchor_id"), F.col("vendor_key").alias("anchor_vendor"), F.col("part").alias("anchor_part"), "priority", "evidence", "independent")
    sole = held.groupBy("product_key").agg(F.count_distinct("repo_key").alias("n")).where("n = 1").where(F.char_length("product_key") >= 4).select("product_key")
    anchors = held.join(sole, "product_key").where("independent")
    others = products.select("product_id", "product_key", "vendor_key", "part")
    met = anchors.join(others, "product_key").join(candidates.select("repo_key", "product_id"), ["repo_key", "product_id"], "left_anti")
    rivals = evidence.select(F.col("repo_key").alias("rival"), "product_id").distinct()
    rivals = met.select("repo_key", "product_id").distinct().join(rivals, "product_id").where("rival <> repo_key").select("repo_key", "product_id").distinct()
    met = met.join(rivals, ["repo_key", "product_id"], "left_anti").where(part_compatible(F.col("anchor_part"), F.col("part")))
    met = met.join(repositories.select("repo_key", "name_key", "owner_key"), "repo_key").where(artifact_conflict(F.col("name_key"), F.col("product_key")).isNull())
    sources = met.select("*", F.explode(F.array_distinct(F.array("anchor_vendor", "owner_key"))).alias("vendor_a"))
    same = sources.where(F.col("vendor_a") == F.col("vendor_key")).withColumn("basis", F.lit("vendor_exact"))
    known = sources.join(bases.withColumnRenamed("vendor_b", "vendor_key"), ["vendor_a", "vendor_key", "product_key"]).select(*same.columns)
    rank = F.when(F.col("basis").startswith("curated_vendor_alias:"), 7).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in BASIS_RANK.items() for x in kv])[F.col("basis")], F.lit(0)))
    firm = ~F.col("product_key").isin(*GENERIC_PRODUCTS) | F.col("basis").startswith("curated_vendor_alias:") | F.col("basis").isin("strict_vendor_cluster", "product_alias_vendor")
    # The best basis of an anchor must itself be firm: a weaker firm one does not stand in for it.
    best = same.unionByName(known).withColumn("rank", rank).groupBy("repo_key", "product_id", "product_key", "anchor_id", "priority", "evidence").agg(F.max(F.struct("rank", "basis")).alias("top"))
    best = best.withColumn("basis", F.col("top.basis")).where(firm)
    order = F.struct("top.rank", "priority", "evidence", "basis", "anchor_id")
    return best.groupBy("repo_key", "product_id").agg(F.max_by(F.struct("anchor_id", "basis"), order).alias("x")).select("repo_key", "product_id", "x.anchor_id", "x.basis")


def repo_view(bindings: DataFrame) -> DataFrame:
    """One row a repository and record: whether all and any of its products need review, and how many lead there."""
    return bindings.groupBy("repo_key", "cve_id").agg(F.min("review").alias("all_review"), F.max("review").alias("any_review"), F.max("provisional").alias("any_provisional"), F.count_distinct("product_id").alias("paths"))


def version_summary(bindings: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a binding: its version ranges, those affected, and whether one of these has an end; without one every version is a candidate."""
    facts = ranges.groupBy("cve_id", "product_id").agg(
        F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("polarity") == "affected").alias("affected_ranges"), F.max(((F.col("polarity") == "affected") & F.coalesce("lower", "upper", "exact").isNotNull()).cast("int")).alias("bounded")
    )
    out = bindings.select("repo_key", "cve_id", "product_id").distinct().join(facts, ["cve_id", "product_id"], "left")
    zero = F.lit(0).cast("long")
    return out.select("repo_key", "cve_id", "product_id", F.coalesce("ranges", zero).alias("ranges"), F.coalesce("affected_ranges", zero).alias("affected_ranges"), F.coalesce("bounded", F.lit(0)).alias("bounded"))


def range_text(exact: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """A range as people write it: ``=1``, ``*``, ``1 <= v < 2``."""
    left = F.when(lower.isNull(), "").otherwise(F.concat(lower, F.when(lower_inclusive, " <= ").otherwise(" < ")))
    right = F.when(upper.isNull(), "").otherwise(F.concat(F.when(upper_inclusive, " <= ").otherwise(" < "), upper))
    return F.when(F.coalesce(exact, F.lit("")) != "", F.concat(F.lit("="), exact)).when(lower.isNull() & upper.isNull(), "*").otherwise(F.concat(left, F.lit("v"), right))


def with_ranges(bindings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bindings with the sorted distinct texts of their affected ranges; a record's ranges of one product are few."""
    shown = ranges.where("polarity = 'affected'").select("cve_id", "product_id", range_text(F.col("exact"), F.col("lower"), F.col("lower_inclusive"), F.col("upper"), F.col("upper_inclusive")).alias("text"))
    texts = shown.distinct().groupBy("cve_id", "product_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    return bindings.join(texts, ["cve_id", "product_id"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def find_repositories(requested: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, repo_key): the known key of each asked ``owner@name``, itself before one that is equal when normalized, then the least."""
    parts = F.split("asked", "@")
    asked = requested.where(F.size(parts) == 2).select("asked", T.ascii_key(F.get(parts, F.lit(0))).alias("owner_key"), T.ascii_key(F.get(parts, F.lit(1))).alias("name_key"))
    same = asked.join(known.select("repo_key"), F.col("asked") == F.col("repo_key")).select("asked", "repo_key")
    alike = asked.join(known.select("repo_key", "owner_key", "name_key"), ["owner_key", "name_key"]).select("asked", "repo_key")
    return same.union(alike).groupBy("asked").agg(F.min_by("repo_key", F.struct((F.col("asked") != F.col("repo_key")).alias("other"), F.col("repo_key"))).alias("repo_key"))


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group in order, and how many it has; ``rank`` counts from 1."""
    ordered = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(ordered)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*group))).where(F.col("rank") <= most)


def record_order(cve_id: Column) -> list[Column]:
    """Year and number of a record's name, as numbers."""
    return [F.split_part(cve_id, F.lit("-"), F.lit(2)).try_cast("int"), F.split_part(cve_id, F.lit("-"), F.lit(3)).try_cast("bigint")]
