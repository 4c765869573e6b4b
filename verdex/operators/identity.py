"""Names that may be one thing: alias edges by shared keys, near spellings, and a resolver in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.skew import first_values


def bucket_pairs(nodes: DataFrame, node: str, bucket: list[str], guard: int = 64) -> DataFrame:
    """Unordered pairs of nodes that share a bucket; fails where :func:`large_buckets` has any, as no bucket is left out."""
    whole = nodes.dropna(subset=bucket)
    sizes = whole.groupBy(*bucket).agg(F.count_distinct(node).alias("_n")).where("_n > 1")
    refusal = F.concat(F.lit("bucket exceeds safety limit: key="), F.to_json(F.struct(*bucket)), F.lit(", members="), F.col("_n").cast("string"), F.lit(f", limit={guard}"))
    sizes = sizes.where(F.when(F.col("_n") > guard, F.raise_error(refusal).cast("boolean")).otherwise(F.lit(True)))
    small = nodes.select(node, *bucket).distinct().join(sizes.select(*bucket), bucket, "left_semi")
    a, b = small.withColumnRenamed(node, "a"), small.withColumnRenamed(node, "b")
    return a.join(b, bucket).where("a < b")


def large_buckets(nodes: DataFrame, node: str, bucket: list[str], guard: int = 64) -> DataFrame:
    """Buckets that a build must refuse to expand."""
    return nodes.groupBy(*bucket).agg(F.count_distinct(node).alias("members")).where(f"members > {guard}")


def separator_aliases(names: DataFrame, name: str) -> DataFrame:
    """(a, b, key): spellings that differ in case and separators alone; digits must agree too."""
    keyed = names.select(F.col(name).alias("name")).distinct().withColumn("key", T.ascii_key(F.col("name")))
    keyed = keyed.where(~T.is_placeholder(F.col("key"))).withColumn("separator", T.separator_key(F.col("key"))).withColumn("digits", T.digit_signature(F.col("key")))
    return bucket_pairs(keyed, "name", ["separator", "digits"]).select("a", "b", F.col("separator").alias("key"))


def one_edit_pairs(words: DataFrame, word: str, least: int = 5) -> DataFrame:
    """(a, b) with a < b: distinct words of ``least`` letters one edit apart.

    Two such words share a string that one deletion at most makes of each, so an
    equi-join over deletion signatures finds them all; the distance is then checked.
    """
    keyed = words.select(F.col(word).alias("word")).where(F.char_length(word) >= least).distinct()
    signed = keyed.select("word", F.explode(T.deletion_signatures(F.col("word"))).alias("signature"))
    a, b = signed.withColumnRenamed("word", "a"), signed.withColumnRenamed("word", "b")
    return a.join(b, "signature").where("a < b").select("a", "b").distinct().where(T.one_edit_apart(F.col("a"), F.col("b")))


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two keys that are one slip apart: 0.88 and up to 0.12 for shared letters, less 0.07 where only one is ASCII."""
    ascii_only = lambda c: c.rlike(r"^[\x00-\x7F]*$")
    x, y = T.separator_key(a), T.separator_key(b)
    return F.lit(0.88) + 0.06 * T.bigram_jaccard(x, y) + 0.06 * T.lcs_ratio(x, y) - F.when(ascii_only(a) != ascii_only(b), 0.07).otherwise(0.0)


def with_margin(scored: DataFrame, keys: list[str], candidate: str, score: str = "score", margin: float = 0.025, band: float = 0.15, most: int = 256) -> DataFrame:
    """Candidates within ``band`` of the best, at most ``most``, and whether the best leads by ``margin``."""
    ordered = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(candidate))
    out = scored.withColumn("rank", F.row_number().over(ordered)).withColumn("_next", F.lead(score).over(ordered)).withColumn("_best", F.max(score).over(Window.partitionBy(*keys)))
    out = out.where((F.col(score) >= F.col("_best") - band) & (F.col("rank") <= most))
    ambiguous = F.coalesce(F.col("_best") - F.max(F.when(F.col("rank") == 1, F.col("_next"))).over(Window.partitionBy(*keys)) < margin, F.lit(False))
    return out.withColumn("ambiguous", ambiguous).drop("_next", "_best")


def resolve(queries: DataFrame, catalogue: DataFrame, query: str = "name", entry: str = "name") -> DataFrame:
    """(query, entry, tier): matches of each query in its first tier that has any.

    Tiers: 0 the spelling itself, 1 the normalized key, 2 the key without separators,
    3 the words in any order, 4 one slip in the key. All tiers are equi-joins.
    """
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("key", T.ascii_key(F.col("query")))
    c = catalogue.select(F.col(entry).alias("entry")).distinct().withColumn("entry_key", T.ascii_key(F.col("entry")))
    by = lambda tier, a, b: q.select("query", "key", a.alias("_k")).join(c.select("entry", "entry_key", b.alias("_k")), "_k").select("query", "entry", F.lit(tier).alias("tier"), "key", "entry_key")
    key, other = F.col("key"), F.col("entry_key")
    plain = by(0, F.col("query"), F.col("entry")).unionByName(by(1, key, other)).unionByName(by(2, T.separator_key(key), T.separator_key(other))).unionByName(by(3, T.token_bag(key), T.token_bag(other)))
    a = q.where(F.char_length("key") >= 5).select("query", "key", F.explode(T.deletion_signatures(key)).alias("_k"))
    b = c.where(F.char_length("entry_key") >= 5).select("entry", "entry_key", F.explode(T.deletion_signatures(other)).alias("_k"))
    near = a.join(b, "_k").select("query", "entry", F.lit(4).alias("tier"), "key", "entry_key").distinct().where(T.edit_kind(key, other).isNotNull())
    found = plain.unionByName(near).groupBy("query", "entry").agg(F.min("tier").alias("tier"))
    first = found.groupBy("query").agg(F.min("tier").alias("tier"))
    return found.join(first, ["query", "tier"]).select("query", "entry", "tier")


def match_level(left: DataFrame, right: DataFrame, subject: str) -> DataFrame:
    """Best agreement of two lists of (vendor, product) by subject: exact, product_only, vendor_only, loose, none.

    Loose: the words of one product are among those of the other.
    """
    a = left.select(subject, F.col("vendor").alias("va"), F.col("product").alias("pa"))
    b = right.select(subject, F.col("vendor").alias("vb"), F.col("product").alias("pb"))
    words_a, words_b = T.tokens(F.col("pa")), T.tokens(F.col("pb"))
    inside = (F.size(F.array_except(words_a, words_b)) == 0) | (F.size(F.array_except(words_b, words_a)) == 0)
    level = F.when((F.col("va") == F.col("vb")) & (F.col("pa") == F.col("pb")), 0).when(F.col("pa") == F.col("pb"), 1).when(F.col("va") == F.col("vb"), 2).when(inside, 3).otherwise(4)
    best = a.join(b, subject).groupBy(subject).agg(F.min(level).alias("_level"))
    names = F.array(*[F.lit(x) for x in ("exact", "product_only", "vendor_only", "loose", "none")])
    return best.select(subject, F.element_at(names, F.col("_level") + 1).alias("level"))


def cooccurring(df: DataFrame, keys: list[str], item: str, examples: int = 8) -> DataFrame:
    """Pairs of different items met under one key: how many keys, and the first few of them, if any are asked for."""
    one = df.select(*keys, item).distinct()
    a, b = one.withColumnRenamed(item, "left_item"), one.withColumnRenamed(item, "right_item")
    pairs = a.join(b, keys).where("left_item < right_item")
    pair = ["left_item", "right_item"]
    counted = pairs.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(first_values(pairs, pair, keys[0], examples, "examples"), pair, "left") if examples else counted


def merged_edges(evidence: DataFrame, pair: list[str], rank: str, status: str, strict: str, proof: str, most: int = 32) -> DataFrame:
    """One edge of each pair from all evidence: a rejection stays, else the best rank's status; strict if any is; at most ``most`` proofs."""
    merged = evidence.groupBy(*pair).agg(
        F.when(F.bool_or(F.col(status) == "rejected"), "rejected").otherwise(F.min_by(status, F.struct(rank, status))).alias("status"),
        F.min(rank).alias("rank"),
        F.bool_or(strict).alias("strict"),
        F.count(F.lit(1)).alias("evidence_count"),
    )
    return merged.join(first_values(evidence, pair, proof, most, "evidence"), pair, "left") if most else merged


def root_candidates(nodes: DataFrame) -> DataFrame:
    """(node, target, alias_class): keys whose legal or organisational root, or whose initials, are another key of the same scope and part.

    ``nodes(node, scope, part, key)``; equi-joins on the derived key. They are only ever
    candidates for review. Generic keys and initials tie nothing.
    """
    key = F.col("key")
    plain = nodes.where(~T.is_generic(key))
    derived = F.array(
        F.struct(F.lit("A2_LEGAL_SUFFIX").alias("alias_class"), T.strip_ending(key, T.LEGAL_ENDINGS).alias("to")), F.struct(F.lit("A3_ORG_SUFFIX").alias("alias_class"), T.strip_ending(key, T.GROUP_ENDINGS).alias("to")),
        F.struct(F.lit("B1_ACRONYM").alias("alias_class"), F.when(~T.acronym(key).isin(*T.SOFT_GENERIC, *T.HARD_GENERIC), T.acronym(key)).alias("to")),
    )
    wanted = plain.select("node", "scope", "part", "key", F.explode(derived).alias("d")).select("node", "scope", "part", "key", "d.*").where("to is not null and to <> '' and to <> key")
    return wanted.join(nodes.select("scope", "part", F.col("key").alias("to"), F.col("node").alias("target")), ["scope", "part", "to"]).select("node", "target", "alias_class")


def rewrite_aliases(nodes: DataFrame, guard: int = 64) -> DataFrame:
    """(a, b): nodes of one vendor and part whose product keys are one when rewritten."""
    keyed = nodes.select("node", "vendor", "part", T.rewritten_product(F.col("vendor"), F.col("product")).alias("rewritten"))
    return bucket_pairs(keyed, "node", ["vendor", "rewritten", "part"], guard).select("a", "b")


#: How much a pair's origin, or else the confidence in it, counts.
ORIGIN_PRIORITY = {"manual_registry": 100, "identity_hard_distinct": 90, "product_relation": 80}
CONFIDENCE_PRIORITY = {"algorithm_accepted": 70, "bounded_heuristic": 60, "inclusive_provisional": 55, "inclusive_candidate": 50, "review_candidate": 10}


def pair_priority(origin: Column, confidence: Column) -> Column:
    table = lambda of, c: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[c]
    return F.coalesce(table(ORIGIN_PRIORITY, origin), table(CONFIDENCE_PRIORITY, confidence), F.lit(20))


def classified_pairs(cases: DataFrame, arrival: str) -> DataFrame:
    """One case of each axis and unordered pair: of the highest priority, the first to arrive; nodes paired with themselves are none.

    ``cases(axis, left, right, class_code, origin, confidence, <arrival>)``.
    """
    ordered = cases.where("left <> right").withColumn("a", F.least("left", "right")).withColumn("b", F.greatest("left", "right")).withColumn("priority", pair_priority(F.col("origin"), F.col("confidence")))
    row = F.struct("class_code", "origin", "confidence", "priority")
    return ordered.groupBy("axis", "a", "b").agg(F.max_by(row, F.struct("priority", (-F.col(arrival)).alias("first"))).alias("x")).select("axis", "a", "b", "x.*")
