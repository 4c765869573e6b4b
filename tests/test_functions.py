from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdex.functions import text as T
from verdex.functions import tri, urls, versions
from verdex.operators import intervals


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(value.alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["Foo-Bar  Inc.", " a__b ", "ÄPFEL Straße", "ﬁne ①", "日本 語", "", "--", None])
def test_normalize_key(spark, name):
    assert one(spark, T.normalize_key(F.col("n")), n=name) == T.normalize_key_text(name)


def test_names(spark):
    c = F.col("n")
    assert one(spark, T.acronym(c), n="gnu_image_program") == "gip"
    for name, core in {"the_acme_software_inc": "acme_software", "software": "software", "inc": "", "the": "", "apache_software_foundation": "apache", "x_open_source_project_team": "x", "open_source": "open_source", "theos_group": "theos"}.items():
        assert one(spark, T.strip_organisation(c), n=name) == core, name
    pair = (F.col("a"), F.col("b"))
    for a, b, want in [("openv", "open_vpn", True), ("open_vpn", "openv", True), ("ope", "open", False), ("open", "openvpnx", False), ("open", "o_pen", False)]:
        assert one(spark, T.prefix_abbreviation(*pair), a=a, b=b) is want, (a, b)
    for a, b, want in [("gip", "gnu_image_program", True), ("gnu_image_program", "gip", True), ("g", "gnu", False), ("gi_p", "gnu_image_program", True)]:
        assert one(spark, T.acronym_match(*pair), a=a, b=b) is want, (a, b)
    assert one(spark, T.digit_signature(c), n="a10_b9") == "10,9"
    assert one(spark, T.edit_kind(F.col("a"), F.col("b")), a="openssl", b="opnessl") == "swap"
    assert one(spark, T.edit_kind(F.col("a"), F.col("b")), a="openssl", b="opensl") == "edit"
    assert one(spark, T.edit_kind(F.col("a"), F.col("b")), a="openssl", b="libssl") is None
    assert one(spark, T.lcs_ratio(F.col("a"), F.col("b")), a="abcd", b="acd") == pytest.approx(3 / 4)
    assert one(spark, T.lcs_ratio(F.col("a"), F.col("b")), a="ab", b="xxxxb") == pytest.approx(1 / 5)
    assert one(spark, T.bigram_jaccard(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, T.grounded_start(F.col("a"), F.col("b")), a="Fixed in FOO 1.2", b="foo") == 9


def test_kleene(spark):
    values = [True, False, None]
    rows = spark.createDataFrame([(i, v) for i, combo in enumerate(itertools.product(values, repeat=2)) for v in combo], "g int, v boolean")
    found = {r["g"]: (r["every"], r["some"]) for r in rows.groupBy("g").agg(tri.tri_all(F.col("v")).alias("every"), tri.tri_any(F.col("v")).alias("some")).collect()}
    for i, combo in enumerate(itertools.product(values, repeat=2)):
        every = False if False in combo else None if None in combo else True
        some = True if True in combo else None if None in combo else False
        assert found[i] == (every, some)


def test_version_orders(spark):
    def order(profile, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").withColumn("k", versions.strict_key(F.col("v"), profile))
        assert [r["v"] for r in df.orderBy("k").collect()] == list(texts), profile

    order("dotted", "1.2", "1.9", "1.10", "v2")
    order("semver", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0-rc.1", "1.0.0", "1.0.1")
    order("openssl", "1.0.2", "1.0.2a", "1.0.2ab", "1.0.2b", "1.0.2ba", "1.0.2z", "1.0.2za", "1.0.2zb", "1.1.0")
    order("imagemagick", "6.0.6", "6.0.6.2", "6.9.9-3", "6.9.10-2", "7.0.1-0", "7.0.10")
    order("deb", "1.0~rc1-1", "1.0-1", "1.0-1+b1", "1.0a-1", "1:0.5-1")
    order("total", "abc", "abc d", "1.0-dev", "1.0a2", "1.0 beta", "1.0rc1", "1_0", "1.0.x", "1.0-p1", "1.0-p2", "1.0.1", "2")


KINDS = {None: "missing", " ": "missing", "-": "not_applicable", "N/A": "not_applicable", "*": "any_token", "all": "all_token", "Any Versions": "all_token", "< 2": "range_expression", "!=3": "range_expression", "1.2.x": "branch_wildcard", "1.*": "branch_wildcard",
         "1234567": "exact", "deadbeef": "source_control", "r42": "source_control", "1.2 beta": "opaque", "2024-01-31": "exact", "v1.2-rc1": "exact"}


@pytest.mark.parametrize("text", KINDS)
def test_version_kinds(spark, text):
    assert one(spark, versions.version_kind(F.col("v")), v=text) == KINDS[text]


def test_profiles_and_branches(spark):
    profile = versions.profile_for(F.col("t"), F.col("p"), F.col("d") == "y")
    for t, p, d, want in [("semver", "openssl", "y", "semver"), ("debian", "x", "n", "deb"), ("custom", "my_openssl_fork", "y", "openssl"), ("", "image_magick", "n", "imagemagick"), ("", "x", "y", "dotted"), (None, "x", "n", "opaque")]:
        assert one(spark, profile, t=t, p=p, d=d) == want
    branch = versions.branch_key(F.col("v"), F.col("p"))
    for v, p, want in [("1.0.2k", "openssl", "1.0.2"), ("3.0.7", "openssl", "3.0"), ("7.0.1-0", "imagemagick", None), ("1.0", "openssl", None), ("1.2.3", "dotted", None)]:
        assert one(spark, branch, v=v, p=p) == want


def test_equal_versions_and_fallback(spark):
    compare = lambda a, b: one(spark, versions.compare(F.col("a"), F.col("b")), a=a, b=b)
    assert compare("1.0", "1") == 0
    assert compare("1.0.0", "1.0.1") == -1
    assert compare("1.0rc1", "1.0") == -1
    assert compare("2.0-final", "1.9") == 1


def test_within_open_ends(spark):
    key = lambda c: versions.dotted_key(F.col(c))
    inside = versions.within(key("v"), key("lo"), F.lit(True), key("hi"), F.lit(False))
    assert one(spark, inside, v="1.2", lo="1.2", hi="2") is True
    assert one(spark, inside, v="2.0", lo="1.2", hi="2") is False
    assert one(spark, inside, v="0.1", lo=None, hi="2") is True
    assert one(spark, inside, v="banana", lo="1", hi="2") is None


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.repository(u), u="https://github.com/Own/Name.git") == "own@name"
    assert one(spark, urls.repository(u), u="https://github.com/topics/x") is None
    assert one(spark, urls.repository(u), u="https://example.com/a/b") is None
    for url, want in {"https://api.github.com/repos/Own/Name/issues/1": "own@name", "https://api.github.com/users/Own/Name": None, "https://raw.githubusercontent.com/Own/Name/main/a.c": "own@name", "http://www.github.com:443/Own/na%6De": "own@name", "https://github.com/own/na%20me": None, "https://github.com/Trending/x": None, "https://codeload.github.com/a/b.git": "a@b"}.items():
        assert one(spark, urls.repository(u), u=url) == want, url
    assert tuple(one(spark, urls.repository_keys(u), u="https://github.com/My-Org/A.b")) == ("my_org", "a_b")
    assert one(spark, urls.commit_id(u), u="https://github.com/a/b/commit/ABCDEF1234?x=1") == "abcdef1234"
    assert one(spark, urls.cve_ids(u), u="cve-2024-12345 and CVE-2024-12345, CVE-2023-1") == ["CVE-2024-12345"]
    assert one(spark, urls.cpe_parts(u), u=r"cpe:2.3:a:ve\:ndor:pro\\d:1.0:*:*:*:*:*:*:*")[1:4] == ["ve:ndor", "pro\\d", "1.0"]
    assert one(spark, urls.cpe_parts(u), u="cpe:2.3:a:x") is None


PROSE = [
    ("*cpe:2.3:a:v:p:*:*:*:*:*:*:*:* versions from (including) 1.0 up to (excluding) 2.0", (True, "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "1.0", None, None, "2.0", None)),
    ("cpe:2.3:a:v:p:*:*:*:*:*:*:*:* versions up to (including) 2.0", (False, "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", None, None, "2.0", None, None)),
    ("  OR *cpe:2.3:a:v:p:*:*:*:*:*:*:*:*  versions from (EXCLUDING) 1.0", (True, "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", None, "1.0", None, None, None)),
    ("*cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:* (and previous)", (True, "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", None, None, "1.2", None, None)),
    ("*cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:*", (True, "cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:*", None, None, None, None, None)),
    ("*cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:*,", (True, "cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:*", None, None, None, None, None)),
    ("*cpe:2.3:a:v:p:*:*:*:*:*:*:*:* versions prior to 3", (None, None, None, None, None, None, "unsupported_version_phrase")),
    ("*cpe:2.3:a:v:p", (None, None, None, None, None, None, "invalid_cpe_line")),
]


def test_prose_of_changes(spark):
    text = "Record truncated\n" + "\r\n".join(line for line, _ in PROSE)
    df = spark.createDataFrame([(1, text), (2, None), (3, "no name")], "i int, t string")
    assert [tuple(x) for x in urls.prose_matches(df, F.col("t")).drop("i", "t").collect()] == [want for _, want in PROSE]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), min_size=1, max_size=12))
def test_merge_is_the_union(spark, spans):
    rows = [(1, lo, lo + n) for lo, n in spans]
    df = spark.createDataFrame(rows, "k int, lo int, hi int")
    merged = sorted((r["lo"], r["hi"]) for r in intervals.merge_intervals(df, ["k"], "lo", "hi").collect())
    points = {p / 2 for _, lo, hi in rows for p in range(2 * lo, 2 * hi + 1)}
    assert {p / 2 for lo, hi in merged for p in range(2 * lo, 2 * hi + 1)} == points
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
    row = spark.createDataFrame([([(lo, hi) for _, lo, hi in rows],)], "x array<struct<lower: int, upper: int>>")
    assert [tuple(x) for x in row.select(intervals.fold_intervals(F.col("x")).alias("y")).first()["y"]] == merged
