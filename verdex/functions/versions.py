"""Version order as sortable columns, version syntax, and range evaluation in three values."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .tri import tri_and

PROFILES = ("dotted", "semver", "openssl", "imagemagick", "deb", "opaque")
_DOTTED = r"^[vV]*\d+(\.\d+)*$"


def _strip_zeros(parts: Column) -> Column:
    """Without zeros at the end, so that 1.0 equals 1 and prefix order is padded order."""
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(parts, F.lit(1), last)


def dotted_key(version: Column) -> Column:
    """array<bigint> that sorts as numbers between dots; NULL where the version isn't of that form."""
    version = F.trim(version)
    numbers = F.transform(F.split(F.regexp_replace(version, "^[vV]+", ""), r"\."), lambda x: x.try_cast("bigint"))
    return F.when(version.rlike(_DOTTED) & ~F.exists(numbers, lambda x: x.isNull()), _strip_zeros(numbers))


# -- strict profiles and the total order, for the forms that plain expressions don't cover ----------------------------


_WHOLE = r"(0|[1-9]\d*)"
_SEMVER = re.compile(rf"[vV]?{_WHOLE}(?:\.{_WHOLE})?(?:\.{_WHOLE})?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?")


def _semver(v: str):
    m = _SEMVER.fullmatch(v)
    if not m:
        return None
    key = [int(x or 0) for x in m.groups()[:3]]
    if m[4] is None:
        return [*key, 2]
    for part in m[4].casefold().split("."):
        key += [0, int(part)] if part.isdigit() else [1, *(ord(c) for c in part), -1]
    return [*key, -1]


def _deb(v: str):
    """Epoch, upstream version and revision; in each, signs and numbers in turn, a tilde before the end and letters before other signs."""
    epoch, colon, rest = v.partition(":")
    if not colon:
        epoch, rest = "0", v
    upstream, _, revision = rest.rpartition("-") if "-" in rest else (rest, "", "0")
    if not epoch.isdigit() or not upstream:
        return None

    def part(text: str) -> list[int]:
        out: list[int] = []
        for signs, digits in re.findall(r"([^0-9]*)([0-9]*)", text)[:-1] or [("", "")]:
            out += [-1 if c == "~" else ord(c) if c.isalpha() else ord(c) + 256 for c in signs]
            out += [0, int(digits or 0)]
        return [*out, 0]

    return [int(epoch), *part(upstream), *part(revision)]


#: What a word after the numbers does to a version's place, before (-) or after the bare one; other words count 5.
BEFORE_RELEASE = {"dev": -60, "snapshot": -50, "alpha": -40, "a": -40, "beta": -30, "b": -30, "milestone": -25, "candidate": -20, "pre": -15, "preview": -15, "rc": -10}
AFTER_RELEASE = {"post": 10, "patch": 10, "p": 10, "pl": 10, "rev": 10, "revision": 10, "build": 10}
NO_CHANGE = {"community", "enterprise", "final", "for", "ga", "incubating", "release", "stable"}
_PLACES = {**dict.fromkeys(NO_CHANGE, 0), **BEFORE_RELEASE, **AFTER_RELEASE}


def _total(v: str) -> list[int]:
    """A key for any text: its first run of numbers, the place of the word after them, the numbers after that word, or the words of a text without numbers.

    Numbers are shifted by one and end with 0, so that a shorter run comes before a longer
    one; zeros at a run's end are left out, as they say nothing.
    """
    found = re.findall(r"\d+|[^\W\d_]+", unicodedata.normalize("NFKC", v).strip().casefold())
    start = next((i for i, x in enumerate(found) if x.isdigit()), len(found))
    word = next((i for i in range(start, len(found)) if not found[i].isdigit()), len(found))

    def run(numbers: list[str]) -> list[int]:
        values = [int(x) for x in numbers]
        while values and not values[-1]:
            values.pop()
        return [*(x + 1 for x in values), 0]

    key = run(found[start:word])
    key.append(_PLACES.get(found[word], 5) if word < len(found) else 0)
    key += run([x for x in found[word + 1 :] if x.isdigit()])
    for x in found if start == len(found) else ():
        key += [*(ord(c) for c in x), 0]
    return key


_PARSERS = {"semver": _semver, "deb": _deb, "total": _total}


def _key_udf(profile: str):
    parse = _PARSERS[profile]

    @F.pandas_udf(ArrayType(LongType()))
    def key(versions: pd.Series) -> pd.Series:
        return versions.map(lambda v: None if v is None else _bounded(parse(v.strip())), na_action="ignore")

    return key


def _bounded(key):
    return None if key is None else [min(x, 2**62) for x in key]


def openssl_key(version: Column) -> Column:
    """Three numbers and the rank of the letters after them: none, one by its place, z and others as 26 and their sum, others one by one."""
    v = F.lower(F.trim(version))
    letters = F.regexp_extract(v, r"^\d+\.\d+\.\d+([a-z]*)$", 1)
    codes = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 96).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    rank = F.when(letters == "", F.array(zero)).when((F.size(codes) > 1) & (F.get(codes, F.lit(0)) == 26), F.array(F.aggregate(codes, zero, lambda a, b: a + b))).otherwise(codes)
    numbers = F.transform(F.split(F.regexp_extract(v, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.try_cast("bigint"))
    return F.when(v.rlike(r"^\d+\.\d+\.\d+[a-z]*$") & ~F.exists(numbers, lambda x: x.isNull()), F.concat(numbers, rank))


def imagemagick_key(version: Column) -> Column:
    """Numbers between dots, underscores and dashes, zeros at the end left out."""
    v = F.regexp_replace(F.trim(version), r"\.+$", "")
    numbers = F.transform(F.split(v, "[._-]"), lambda x: x.try_cast("bigint"))
    return F.when(v.rlike(r"^\d+([._-]\d+)*$") & ~F.exists(numbers, lambda x: x.isNull()), _strip_zeros(numbers))


_NATIVE = {"dotted": dotted_key, "openssl": openssl_key, "imagemagick": imagemagick_key}


def strict_key(version: Column, profile: str) -> Column:
    """Sort key of a version under a profile; NULL where it is not of the profile's form."""
    if profile == "opaque":
        return F.lit(None).cast("array<bigint>")
    return _NATIVE[profile](version) if profile in _NATIVE else _key_udf(profile)(version)


def fallback_key(version: Column) -> Column:
    """Sort key in the order that takes any text."""
    return _key_udf("total")(version)


def compare(a: Column, b: Column, profile: str = "dotted") -> Column:
    """-1, 0 or 1: under the profile if both versions are of its form, else in the order that takes any text.

    Python sees only the pairs that the profile does not decide.
    """
    x, y = strict_key(a, profile), strict_key(b, profile)
    strict = x.isNotNull() & y.isNotNull()
    u, v = (fallback_key(F.when(~strict, c)) for c in (a, b))
    return F.when(strict, _sign(x, y)).otherwise(_sign(u, v))


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _all_keys(values: pd.Series, profiles: pd.Series) -> pd.Series:
    def keys(texts, profile):
        if texts is None or profile is None:
            return None
        parse = _PARSERS.get(profile)
        strict = [None if t is None else parse(t.strip()) for t in texts] if parse else []
        if not strict or any(k is None and t is not None for k, t in zip(strict, texts)):
            strict = [None if t is None else _total(t) for t in texts]
        return [_bounded(k) for k in strict]

    return pd.Series([keys(t, p) for t, p in zip(values, profiles)], dtype=object)


def point_keys(values: Column, profile: Column) -> Column:
    """Sort keys of an array of versions that are to be compared with each other; NULL for NULL ones.

    All are of the row's profile if each has its form, else all are of the order that takes
    any text. Python sees only arrays that no JVM-side profile decides.
    """
    native = F.lit(None).cast("array<array<bigint>>")
    for name, of in _NATIVE.items():
        native = F.when(profile == name, F.transform(values, of)).otherwise(native)
    decided = native.isNotNull() & ~F.exists(F.arrays_zip(values.alias("v"), native.alias("k")), lambda x: x["v"].isNotNull() & x["k"].isNull())
    decided = F.coalesce(decided, F.lit(False))
    return F.when(decided, native).otherwise(_all_keys(F.when(~decided, values), F.when(~decided, profile)))


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _keys_by(values: pd.Series, profiles: pd.Series) -> pd.Series:
    one = lambda t, p: None if t is None else _bounded(_PARSERS[p](t.strip()))
    return pd.Series([None if texts is None else [one(t, p) for t in texts] for texts, p in zip(values, profiles)], dtype=object)


def profile_keys(values: Column, profile: Column) -> Column:
    """Sort keys of an array of versions under a profile, NULL for those not of its form; NULL for a profile without one."""
    python = profile.isin("semver", "deb")
    keys = F.when(python, _keys_by(F.when(python, values), F.when(python, profile)))
    for name, of in _NATIVE.items():
        keys = keys.when(profile == name, F.transform(values, of))
    return keys


def total_keys(values: Column) -> Column:
    """Sort keys of an array of versions in the order that takes any text."""
    return _keys_by(values, F.lit("total"))


def compare_by(a: Column, b: Column, profile: Column) -> Column:
    """-1, 0 or 1 under each row's own profile; NULL where either is."""
    keys = point_keys(F.array(a, b), F.when(a.isNotNull() & b.isNotNull(), profile))
    return _sign(F.get(keys, F.lit(0)), F.get(keys, F.lit(1)))


def _sign(x: Column, y: Column) -> Column:
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def version_kind(version: Column) -> Column:
    """What a version text is, first match: missing, not_applicable, any_token, all_token, range_expression, branch_wildcard, exact, source_control, opaque."""
    v = F.trim(version)
    low = F.lower(v)
    return (
        F.when(v.isNull() | (v == ""), "missing")
        .when(low.isin("-", "n/a"), "not_applicable")
        .when(v == "*", "any_token")
        .when(low.isin("all", "all versions", "any version", "any versions"), "all_token")
        .when(v.rlike("^[<>=!]"), "range_expression")
        .when(v.rlike(r"^\d+(\.\d+)*\.[xX*]$"), "branch_wildcard")
        .when(v.rlike(r"^\d+$"), "exact")
        .when(low.rlike(r"^([0-9a-f]{7,64}|r\d+)$"), "source_control")
        .when(v.rlike(r"\s"), "opaque")
        .otherwise("exact")
    )


def profile_for(stated: Column, product_key: Column, all_dotted: Column) -> Column:
    """The profile to compare by: that of the stated version type, else the product's own, else dotted if all versions are."""
    return (
        F.when(stated.isin("semver", "semantic", "semantic_version"), "semver")
        .when(stated.isin("deb", "debian"), "deb")
        .when(stated.isin("dotted", "dotted_numeric"), "dotted")
        .when(product_key.contains("openssl"), "openssl")
        .when(product_key.contains("imagemagick") | (product_key == "image_magick"), "imagemagick")
        .when(all_dotted, "dotted")
        .otherwise("opaque")
    )


def branch_key(version: Column, profile: Column) -> Column:
    """The maintenance branch of a version, which only openssl has: two numbers from 3 on, three before."""
    v = F.trim(version)
    part = lambda i: F.regexp_extract(v, r"^(\d+)\.(\d+)\.(\d+)[A-Za-z]*$", i).try_cast("bigint")
    two = F.concat_ws(".", part(1), part(2))
    return F.when((profile == "openssl") & part(1).isNotNull(), F.when(part(1) >= 3, two).otherwise(F.concat_ws(".", two, part(3))))


def within(key: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """Whether a key lies in a range whose absent ends are open; NULL where the key or a stated end can't be compared."""
    above = F.when(lower.isNull(), True).otherwise((key > lower) | (lower_inclusive & (key == lower)))
    below = F.when(upper.isNull(), True).otherwise((key < upper) | (upper_inclusive & (key == upper)))
    return F.when(key.isNull(), F.lit(None).cast("boolean")).otherwise(tri_and(above, below))


def evaluate_segment(kind: Column, key: Column, exact: Column, lower: Column, lower_inclusive: Column, upper: Column, upper_inclusive: Column) -> Column:
    """A version against one segment: all versions, none, one exact version, a range, or text that says nothing."""
    return (
        F.when(kind == "all", True)
        .when(kind == "none", False)
        .when(kind.isin("unspecified", "unparsed"), F.lit(None).cast("boolean"))
        .when(kind == "exact", F.when(key.isNull() | exact.isNull(), F.lit(None).cast("boolean")).otherwise(key == exact))
        .otherwise(within(key, lower, lower_inclusive, upper, upper_inclusive))
    )


def release_series(tag: Column) -> Column:
    """The first two numbers of a release tag; empty where there are none."""
    return F.regexp_extract(tag, r"(\d+\.\d+)(?:[.\d]*)$", 1)


def version_core(tag: Column) -> Column:
    return F.regexp_extract(tag, r"(\d+(?:[._]\d+)+)", 1)
