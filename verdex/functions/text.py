"""Keys and similarities of names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Texts that name nothing; they are compared as keys, and the signs among them have none.
PLACEHOLDERS = ("", "*", "-", "n/a", "na", "none", "null", "unknown", "unspecified")
#: Trailing words, and runs of words, that say what kind of organisation it is.
ORGANISATION_SUFFIXES = ("project", "projects", "foundation", "inc", "incorporated", "corporation", "corp", "company", "co", "ltd", "limited", "llc", "gmbh", "org", "organization", "organisation", "team", "group")
ORGANISATION_SEQUENCES = ("software_foundation", "open_source_project")
#: Words of a repository's name that say which form of the product it holds.
VARIANT_WORDS = ("portable", "source", "src")

#: Endings of legal and of organisational names, and names too common to tie anything to.
LEGAL_ENDINGS = ("inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "gmbh", "plc", "bv")
GROUP_ENDINGS = ("project", "software", "systems", "networks", "security", "labs", "foundation", "group", "org", "team")
SOFT_GENERIC = ("core", "cms", "iot", "security", "nas", "agent", "server", "client")
HARD_GENERIC = ("cve", "poc", "advisories", "advisory", "vulnerabilities", "vulnerability")

_NOT_WORD = re.compile(r"[^\w]+")


def normalize_key_text(value: str | None) -> str | None:
    if value is None:
        return None
    return _NOT_WORD.sub("_", unicodedata.normalize("NFKC", value).casefold().strip()).strip("_")


@F.pandas_udf(StringType())
def _normalize_key(values: pd.Series) -> pd.Series:
    return values.map(normalize_key_text, na_action="ignore")


def normalize_key(name: Column) -> Column:
    """NFKC, case fold, runs of non-word characters to one underscore, none at the ends.

    ASCII names, nearly all, stay in the JVM; only others pass through Python.
    """
    native = F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]+", "_"), F.lit("_"))
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), native).otherwise(_normalize_key(F.when(~name.rlike(r"^[\x00-\x7F]*$"), name)))


def ascii_key(name: Column) -> Column:
    """:func:`normalize_key` for names known to be ASCII."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]+", "_"), F.lit("_"))


def is_placeholder(key: Column) -> Column:
    return key.isin(*sorted({normalize_key_text(x) for x in PLACEHOLDERS}))


def separator_key(key: Column) -> Column:
    """The key without separators: equal for spellings that differ only there."""
    return F.regexp_replace(key, "_", "")


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, "_"), lambda t: t != "")


def token_bag(key: Column) -> Column:
    return F.array_join(F.array_sort(tokens(key)), "_")


def acronym(key: Column) -> Column:
    """First letters of the words; empty for one word."""
    t = tokens(key)
    return F.when(F.size(t) > 1, F.array_join(F.transform(t, lambda x: F.left(x, F.lit(1))), "")).otherwise("")


def digit_signature(key: Column) -> Column:
    """The numbers in a key, sorted as strings."""
    return F.array_join(F.array_sort(F.regexp_extract_all(key, F.lit(r"(\d+)"), 1)), ",")


def strip_organisation(key: Column) -> Column:
    """Without a leading article and all trailing words of organisation; empty where there are no others.

    Words that a brand may consist of, as software, go only as part of a fixed run.
    """
    led = F.regexp_replace(F.concat(F.lit("_"), key), "^_the(?=_|$)", "")
    return F.ltrim(F.regexp_replace(led, "(_(" + "|".join(ORGANISATION_SEQUENCES + ORGANISATION_SUFFIXES) + "))+$", ""), F.lit("_"))


def strip_ending(key: Column, endings: tuple[str, ...]) -> Column:
    """Without its last word if that is one of ``endings`` and not the only one."""
    return F.regexp_replace(key, "_(" + "|".join(endings) + ")$", "")


def is_generic(key: Column) -> Column:
    """Whether a key holds a word that ties nothing, or is a name that many things have."""
    return F.arrays_overlap(tokens(key), F.array(*map(F.lit, HARD_GENERIC))) | key.isin(*SOFT_GENERIC)


def self_brand(vendor: Column, product: Column) -> Column:
    """How a product is named for its vendor: exact, separator, legal_root, org_root, or NULL."""
    root = lambda endings: strip_ending(vendor, endings)
    same = lambda r: (r != vendor) & (r != "") & (separator_key(r) == separator_key(product))
    return F.when(vendor == product, "exact").when(separator_key(vendor) == separator_key(product), "separator").when(same(root(LEGAL_ENDINGS)), "legal_root").when(same(root(GROUP_ENDINGS)), "org_root")


def rewritten_product(vendor: Column, product: Column) -> Column:
    """The one vendor whose product names carry words that only say which edition they are."""
    plain = F.regexp_replace(F.regexp_replace(product, "^windows_10_version_", "windows_10_"), "^windows_11_version_", "windows_11_")
    return F.when(vendor == "microsoft", F.regexp_replace(plain, "(_edition_server_core_installation|_server_core_installation)$", "")).otherwise(product)


def content_signature(*columns: Column) -> Column:
    """SHA-256 of values in a fixed order, NULL apart from empty: rows that are equal have one."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def without_variant_words(key: Column) -> Column:
    return F.array_join(F.filter(tokens(key), lambda t: ~t.isin(*VARIANT_WORDS)), "_")


def acronym_match(a: Column, b: Column) -> Column:
    """Whether one key's letters, two to eight, are the initials of the other's words."""
    x, y = separator_key(a), separator_key(b)
    of = lambda short, key: F.char_length(short).between(2, 8) & (short == acronym(key))
    return (x != "") & (y != "") & (x != y) & (of(x, b) | of(y, a))


def derived_keys(key: Column) -> Column:
    """(kind, value) of each key under which a name may be met."""
    kinds = {"exact": key, "separator": separator_key(key), "bag": token_bag(key), "acronym": acronym(key), "organisation": strip_organisation(key), "digits": digit_signature(key)}
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]), lambda x: x["value"] != "")


def bigrams(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Share of common two-letter pieces; 1 for equal texts, empty ones too."""
    x, y = bigrams(a), bigrams(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion or replacement turns a into b."""
    return F.levenshtein(a, b, 1) == 1


def swapped_neighbours(a: Column, b: Column) -> Column:
    """Whether exchanging two neighbouring letters turns a into b."""
    n = F.char_length(a)
    off = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(off, F.lit(0)), F.get(off, F.lit(1))
    return (n == F.char_length(b)) & (F.size(off) == 2) & (j == i + 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))) & (F.substring(a, j, F.lit(1)) == F.substring(b, i, F.lit(1)))


def edit_kind(a: Column, b: Column) -> Column:
    return F.when(a == b, "same").when(one_edit_apart(a, b), "edit").when(F.coalesce(swapped_neighbours(a, b), F.lit(False)), "swap")


@F.pandas_udf(DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest common subsequence's share of the longer text; 1 for two empty texts."""

    def ratio(x: str, y: str) -> float:
        if not x and not y:
            return 1.0
        row = [0] * (len(y) + 1)
        for c in x:
            left = 0
            for j, d in enumerate(y, 1):
                row[j], left = (left + 1 if c == d else max(row[j], row[j - 1])), row[j]
        return row[-1] / max(len(x), len(y))

    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def deletion_signatures(key: Column) -> Column:
    """The key and the key without each one of its letters: keys one edit apart share one."""
    n = F.char_length(key)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.concat(F.array(key), cut))


def prefix_abbreviation(a: Column, b: Column) -> Column:
    """Whether one key's letters begin the other's: four of them at least, and three fifths of the longer."""
    x, y = separator_key(a), separator_key(b)
    begins = lambda short, long: long.startswith(short) & (F.char_length(short) >= 4) & (F.char_length(short) * 10 >= F.char_length(long) * 6)
    return (x != "") & (y != "") & (x != y) & (begins(x, y) | begins(y, x))


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def grounded_start(text: Column, value: Column) -> Column:
    """0-based start of value in text, as it stands or else whatever its case; NULL if it is not there."""
    exact = F.position(value, text)
    folded = F.position(F.lower(value), F.lower(text))
    return F.when(value == "", None).when(exact > 0, exact - 1).when(folded > 0, folded - 1)
