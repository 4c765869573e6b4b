"""Repositories and commits in URLs, and platform names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_key

#: Hosts whose paths name repositories, and first path parts that name no repository owner.
HOSTS = ("github.com", "www.github.com", "api.github.com", "raw.githubusercontent.com", "codeload.github.com")
NOT_OWNERS = (
    "about", "advisories", "apps", "collections", "contact", "customer-stories", "enterprise", "events", "explore", "features", "gist", "git-guides", "issues", "marketplace", "new", "notifications", "orgs", "pricing", "pulls",
    "search", "security", "settings", "site", "sponsors", "topics", "trending", "users",
)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def _owner_and_name(url: Column) -> tuple[Column, Column, Column]:
    """Owner and name as written, and whether they name a repository of one of HOSTS; the host with an API has them one part later."""
    parts = F.transform(path_parts(F.trim(url)), lambda x: F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")))
    api = host(F.trim(url)) == "api.github.com"
    owner, name = (F.when(api, F.get(parts, F.lit(i + 1))).otherwise(F.get(parts, F.lit(i))) for i in (0, 1))
    name = F.regexp_replace(name, r"\.git$", "")
    word = r"^[A-Za-z0-9_.-]+$"
    good = host(F.trim(url)).isin(*HOSTS) & (~api | (F.lower(F.get(parts, F.lit(0))) == "repos")) & owner.rlike(word) & name.rlike(word) & ~F.lower(owner).isin(*NOT_OWNERS)
    return owner, name, F.coalesce(good, F.lit(False))


def repository(url: Column) -> Column:
    """owner@name in lower case of a repository URL; NULL for others."""
    owner, name, good = _owner_and_name(url)
    return F.when(good, F.concat(F.lower(owner), F.lit("@"), F.lower(name)))


def repository_keys(url: Column) -> Column:
    """struct<owner_key, name_key> of a repository URL; NULL for others."""
    owner, name, good = _owner_and_name(url)
    return F.when(good, F.struct(ascii_key(owner).alias("owner_key"), ascii_key(name).alias("name_key")))


def commit_id(url: Column) -> Column:
    """The hash of a commit URL, in lower case; NULL for others."""
    found = F.lower(F.regexp_extract(path(url), r"/(?:commit|commits)/([0-9a-fA-F]{7,40})(?:$|[/.])", 1))
    return F.when(found != "", found)


def cpe_parts(cpe: Column) -> Column:
    """The eleven components of a CPE 2.3 name, unescaped; NULL if there are not eleven.

    Colons behind a backslash belong to their component.
    """
    body = F.regexp_extract(cpe, r"^cpe:2\.3:(.*)$", 1)
    found = F.regexp_extract_all(F.concat(body, F.lit(":")), F.lit(r"((?:\\.|[^:\\])*):"), 1)
    return F.when((F.size(found) == 11) & F.get(found, F.lit(0)).isin("a", "o", "h", "*", "-"), F.transform(found, lambda x: F.regexp_replace(x, r"\\(.)", "$1")))


_LINE = r"(?i)(\*)?(cpe:2\.3:\S+?)(?=\s+versions\b|\s+\(and previous\)|\s*$)"
_FROM = r"(?i)versions\s+from\s+\((including|excluding)\)\s+(\S+)"
_UPTO = r"(?i)versions\s+up\s+to\s+\((including|excluding)\)\s+(\S+)"
_BETWEEN = r"(?i)versions\s+from\s+\((including|excluding)\)\s+(\S+)\s+up\s+to\s+\((including|excluding)\)\s+(\S+)"


def prose_lines(text: Column) -> Column:
    """The lines of a change's text that name platforms."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c]"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: F.lower(x).contains("cpe:2.3:"))


def prose_matches(df: DataFrame, text: Column) -> DataFrame:
    """``df`` once for each line of ``text`` that names a platform, with vulnerable, criteria, start_including, start_excluding, end_including, end_excluding and problem.

    A star before a name marks it as vulnerable; after it come a range, one end, or that
    earlier versions are meant too, which makes the name's own version the upper end. A line
    whose name or range can't be read has a ``problem`` and nothing else.
    """
    c = lambda name: F.col(f"_p_{name}")
    step = lambda df, **columns: df.withColumns({f"_p_{k}": v for k, v in columns.items()})
    found = df.withColumn("_p_line", F.explode(prose_lines(text)))
    found = step(found, name=F.regexp_extract(c("line"), _LINE, 2), star=F.regexp_extract(c("line"), _LINE, 1) == "*", tail=F.regexp_replace(c("line"), r"(?i)^.*?cpe:2\.3:\S+?(?=\s+versions\b|\s+\(and previous\)|\s*$)", ""))
    found = step(found, read=c("name") != "", name=F.regexp_replace(c("name"), "[,.;]+$", ""), low=F.lower(c("tail")))
    found = step(found, fields=F.split(c("name"), r"(?<!\\):"), ranged=F.regexp_extract(c("tail"), _BETWEEN, 1), upto=F.regexp_extract(c("tail"), _UPTO, 1), since=F.regexp_extract(c("tail"), _FROM, 1))
    between, upto, since = c("ranged") != "", c("upto") != "", c("since") != ""
    found = step(found, version=F.get(c("fields"), F.lit(5)))
    found = step(found, earlier=~between & ~upto & ~since & c("low").contains("(and previous)") & ~c("version").isin("", "*", "-"))
    problem = (
        F.when(~c("read"), "unparsed_cpe_line")
        .when((F.size(c("fields")) != 13) | ~F.lower(c("name")).startswith("cpe:2.3:"), "invalid_cpe_line")
        .when(~between & ~upto & ~since & ~c("earlier") & c("low").contains("versions"), "unsupported_version_phrase")
    )
    found = step(
        found, problem=problem, low_kind=F.when(between, F.lower(c("ranged"))).when(~upto & since, F.lower(c("since"))), low_end=F.when(between, F.regexp_extract(c("tail"), _BETWEEN, 2)).when(~upto & since, F.regexp_extract(c("tail"), _FROM, 2)),
        high_kind=F.when(between, F.lower(F.regexp_extract(c("tail"), _BETWEEN, 3))).when(upto, F.lower(c("upto"))).when(c("earlier"), "including"),
        high_end=F.when(between, F.regexp_extract(c("tail"), _BETWEEN, 4)).when(upto, F.regexp_extract(c("tail"), _UPTO, 2)).when(c("earlier"), F.regexp_replace(c("version"), r"\\(.)", "$1")),
    )
    ok = c("problem").isNull()
    any_version = F.concat_ws(":", F.slice(c("fields"), F.lit(1), F.lit(5)), F.lit("*"), F.slice(c("fields"), F.lit(7), F.lit(7)))
    end = lambda kind, value, which: F.when(ok & (c(kind) == which), c(value))
    out = found.withColumns({
        "vulnerable": F.when(ok, c("star")), "criteria": F.when(ok, F.when(c("earlier"), any_version).otherwise(c("name"))), "start_including": end("low_kind", "low_end", "including"), "start_excluding": end("low_kind", "low_end", "excluding"),
        "end_including": end("high_kind", "high_end", "including"), "end_excluding": end("high_kind", "high_end", "excluding"), "problem": c("problem"),
    })
    return out.drop(*[x for x in out.columns if x.startswith("_p_")])


def cve_ids(text: Column) -> Column:
    """Distinct identifiers in a text, upper case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(CVE-\d{4}-\d{4,})\b"), 1), F.upper))
