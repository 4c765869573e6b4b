"""Readers of nested JSON records and change logs, and writers with quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

IDENTIFIER = r"^CVE-\d{4}-\d{4,}$"


def lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Lines of text files, plain or gz, as (value, source_file); blank lines are skipped."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("source_file"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of documents whose top level holds an array ``vulnerabilities``, one JSON line each."""
    read = spark.read.option("multiLine", True).option("primitivesAsString", True).schema("vulnerabilities array<string>").json(path)
    return read.select(F.explode("vulnerabilities").alias("value"), F.col("_metadata.file_path").alias("source_file"))


def records(found: DataFrame) -> DataFrame:
    """``lines`` parsed: id, record, times in microseconds, digest, and ``error`` for what is no record.

    A record may stand under ``cve``; its id under id, cveId or cve_id; ids are upper case.
    Fields of another type become null. A time without zone is UTC.
    """
    body = F.coalesce(F.get_json_object("value", "$.cve"), F.col("value"))
    parsed = found.withColumn("record", F.from_json(body, schemas.RECORD)).withColumn("_object", F.col("value").rlike(r"^\s*\{"))
    r = F.col("record")
    key = F.upper(F.trim(F.coalesce(r["id"], r["cveId"], r["cve_id"])))
    error = F.when(~F.col("_object") | F.expr("try_parse_json(value) is null"), "invalid_json").when(key.isNull(), "missing_id").when(~key.rlike(IDENTIFIER), "invalid_id")
    return parsed.select(
        key.alias("cve_id"), "record", timestamp_micros(r["lastModified"]).alias("modified_us"), r["vulnStatus"].alias("status"), F.sha2("value", 256).alias("digest"), error.alias("error"), "value", "source_file"
    )


#: Statuses and events that take a record out, and events that bring it back.
REJECTED_STATUSES = ("reject", "rejected", "withdrawn")
REJECTING_EVENTS = ("cve rejected", "cve deleted", "cve withdrawn")
RESTORING_EVENTS = ("cve unrejected", "cve restored")


def timestamp_micros(text: Column) -> Column:
    """Microseconds of an ISO time; NULL where it is none. The session's zone is to be UTC."""
    return F.unix_micros(F.try_to_timestamp(text))


def changes(found: DataFrame) -> DataFrame:
    """Change-log lines: one row a change id, with what they did to terminal state.

    A rejection, deletion or withdrawal, or its reversal, settles the state by its event
    name; a status change does by its first detail of a status that has a new value; the
    details of other events say nothing of it.
    """
    body = F.coalesce(F.get_json_object("value", "$.change"), F.col("value"))
    c = F.from_json(body, schemas.CHANGE)
    parsed = found.select(c.alias("change")).select("change.*").where("cveId is not null and cveChangeId is not null").dropDuplicates(["cveChangeId"])
    name = F.lower(F.trim("eventName"))
    stated = F.filter("details", lambda d: F.lower(F.trim(d["type"])).contains("status") & (F.trim(F.coalesce(d["newValue"], F.lit(""))) != ""))
    status = F.lower(F.trim(F.get(stated, F.lit(0))["newValue"]))
    by_status = F.when(status.isin(*REJECTED_STATUSES), "rejected").when(status.isNotNull(), "active")
    terminal = F.when(name.isin(*REJECTING_EVENTS), "rejected").when(name.isin(*RESTORING_EVENTS), "active").when(name == "cve status change", by_status)
    return parsed.select(F.upper("cveId").alias("cve_id"), F.col("cveChangeId").alias("change_id"), timestamp_micros(F.col("created")).alias("created_us"), "eventName", "details", terminal.alias("terminal"))


def descriptions(found: DataFrame) -> DataFrame:
    """(cve_id, lang, text, description_id): each text of a record once."""
    each = found.select("cve_id", F.explode("record.descriptions").alias("d")).where("d.value is not null")
    return each.select("cve_id", F.col("d.lang").alias("lang"), F.col("d.value").alias("text"), F.sha2(F.concat_ws("\x1f", "d.lang", "d.value"), 256).alias("description_id")).dropDuplicates(["cve_id", "description_id"])


def primary_description(array: Column) -> Column:
    """English, else a variety of English, else the first."""
    of = lambda cond: F.get(F.filter(array, cond), F.lit(0))["value"]
    return F.coalesce(of(lambda d: d["lang"] == "en"), of(lambda d: d["lang"].startswith("en-")), F.get(array, F.lit(0))["value"])


def affected(found: DataFrame) -> DataFrame:
    """One row a stated product: source, item fields, and its place."""
    sections = found.select("cve_id", F.posexplode("record.affected").alias("section", "a"))
    items = sections.select("cve_id", "section", F.col("a.source").alias("source"), F.posexplode("a.affectedData").alias("item", "x"))
    return items.select("cve_id", "section", "item", "source", "x.*")


def version_entries(items: DataFrame) -> DataFrame:
    """Stated versions as segments: exact, range or all, with status and inclusive ends; changes split them.

    An item without versions gets its default status over all versions; a lower end of 0
    or * is open. Unknown statuses are ``unknown``.
    """
    v = F.col("v")
    clean = lambda s: F.when(F.lower(F.trim(s)).isin("affected", "unaffected"), F.lower(F.trim(s))).otherwise("unknown")
    each = items.select("cve_id", "section", "item", "vendor", "product", "defaultStatus", F.posexplode_outer("versions").alias("entry", "v"))
    upper = F.coalesce(v["lessThanOrEqual"], v["lessThan"])
    steps = F.concat(F.array(F.struct(v["version"].alias("at"), v["status"].alias("status"))), F.coalesce(v["changes"], F.array().cast("array<struct<at: string, status: string>>")))
    split = each.withColumn("step", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.struct(i.alias("no"), F.get(steps, i).alias("x"), F.get(steps, i + 1)["at"].alias("to")))))
    next_at, start = F.col("step.to"), F.col("step.x.at")
    ranged = upper.isNotNull() | next_at.isNotNull()
    kind = F.when(v.isNull(), F.when(F.col("defaultStatus").isNull(), "unspecified").otherwise("all")).when(ranged, "range").when(start == "*", "all").otherwise("exact")
    return split.select(
        "cve_id", "section", "item", "entry", F.col("step.no").alias("segment"), "vendor", "product", kind.alias("kind"),
        F.when(v.isNull(), clean(F.col("defaultStatus"))).otherwise(clean(F.col("step.x.status"))).alias("status"),
        F.when(kind == "exact", start).alias("exact"), F.when(ranged & ~start.isin("0", "*", ""), start).alias("lower"), F.lit(True).alias("lower_inclusive"),
        F.coalesce(next_at, upper).alias("upper"), (next_at.isNull() & v["lessThanOrEqual"].isNotNull()).alias("upper_inclusive"), v.isNull().alias("is_default"),
    )


def configuration_leaves(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and leaves of the records' condition trees, flattened level by level without recursion.

    An operator that is neither AND nor OR counts as OR, a missing negation as none; a
    configuration is the root of its tree. What lies deeper than the schema reads counts as
    one leaf of unknown truth, so that no condition is decided without it.
    """
    empty = F.array().cast(f"array<{schemas.CPE_MATCH}>")
    level = found.select(F.col("cve_id"), F.posexplode("record.configurations").alias("tree", "n")).select("cve_id", "tree", F.col("tree").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), "n")
    nodes, leaves = None, None
    for depth in range(schemas.NODE_DEPTH + 1):
        n = F.col("n")
        own = level.select("cve_id", "tree", "node", "parent", F.lit(depth).alias("level"), F.when(F.upper(n["operator"]) == "AND", "AND").otherwise("OR").alias("operator"), F.coalesce(n["negate"], F.lit(False)).alias("negate"))
        matches = F.concat(F.coalesce(n["cpeMatch"], empty), F.coalesce(n["cpe_match"], empty))
        here = level.select("cve_id", "tree", F.col("node").alias("parent"), F.posexplode(matches).alias("leaf", "m")).select("cve_id", "tree", "parent", "leaf", "m.*")
        if depth == schemas.NODE_DEPTH:
            unread = level.where(F.coalesce(F.size(n["nodes"]), F.lit(0)) + F.coalesce(F.size(n["children"]), F.lit(0)) > 0)
            here = here.unionByName(unread.select("cve_id", "tree", F.col("node").alias("parent"), F.lit(-1).alias("leaf")), allowMissingColumns=True)
        nodes, leaves = (own, here) if nodes is None else (nodes.unionByName(own), leaves.unionByName(here))
        if depth < schemas.NODE_DEPTH:
            kind = f"array<{schemas._node(schemas.NODE_DEPTH - depth - 1)}>"
            below = F.concat(F.coalesce(n["nodes"], F.array().cast(kind)), F.coalesce(n["children"], F.array().cast(kind)))
            level = level.select("cve_id", "tree", F.col("node").alias("parent"), F.posexplode(below).alias("child", "n")).select("cve_id", "tree", F.concat_ws(".", "parent", "child").alias("node"), "parent", "n")
    return nodes, leaves


def reference_urls(found: DataFrame) -> DataFrame:
    return found.select("cve_id", F.explode("record.references").alias("r")).where("r.url is not null").select("cve_id", "r.url", "r.source", "r.tags").dropDuplicates(["cve_id", "url"])


def advisories(found: DataFrame) -> DataFrame:
    """(cve_id, advisory, repo, introduced, fixed): commit ranges of advisories that have versions and name an identifier."""
    a = found.select(F.from_json("value", schemas.ADVISORY).alias("a")).select("a.*")
    named = F.filter(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.rlike(IDENTIFIER))
    each = a.select(F.explode(named).alias("cve_id"), F.col("id").alias("advisory"), F.explode("affected").alias("x")).where("size(x.versions) > 0")
    ranges = each.select("cve_id", "advisory", F.explode("x.ranges").alias("r")).where("r.type = 'GIT'")
    event = lambda name: F.get(F.array_compact(F.transform("r.events", lambda e: F.try_element_at(e, F.lit(name)))), F.lit(0))
    return ranges.select("cve_id", "advisory", "r.repo", event("introduced").alias("introduced"), event("fixed").alias("fixed"))


def override_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Result files as rows with content hash and file time, and those that are not whole."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    parsed = raw.withColumn("doc", F.from_json("value", schemas.OVERRIDE)).withColumn("digest", F.sha2("value", 256))
    good = parsed.where("doc.repo is not null and doc.results is not null").dropDuplicates(["digest"])
    rows = good.select("digest", "mtime", F.explode("doc.results").alias("r")).select("digest", "mtime", F.col("r.repo").alias("repo_key"), F.col("r.cve").alias("cve_id"), "r.state", "r.tag_count", "r.evaluated_tags", "r.unknown_tags", "r.proposal")
    return rows, parsed.where("doc.repo is null or doc.results is null").select("file", "digest")


def write_decided(df: DataFrame, path: str, decision: str = "decision", kept: str = "current") -> None:
    """Kept rows as text lines under ``kept``, others with their reason under ``quarantine``."""
    df.where(F.col(decision) == kept).select("value").write.mode("overwrite").text(f"{path}/kept")
    df.where(F.col(decision) != kept).write.mode("overwrite").json(f"{path}/quarantine")


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines and as CSV, nested columns as JSON text in the latter."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """owner@repo lines, comments and case folded away, with the languages that their files' names state."""
    text = lines(spark, path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("key"), F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("language"))
    good = text.where(F.col("key").rlike(r"^[^@\s]+@[^@\s]+$"))
    return good.groupBy("key").agg(F.array_sort(F.collect_set("language")).alias("languages")).withColumn("owner", F.get(F.split("key", "@"), F.lit(0))).withColumn("name", F.get(F.split("key", "@"), F.lit(1)))


def invalid_extractions(df: DataFrame) -> DataFrame:
    """Rows that break the rules of extraction records, and how: bounds and their inclusivity are null together, ranges not empty."""
    half = lambda r, a, b: r[a].isNull() != r[b].isNull()
    bad_range = F.exists("bindings", lambda b: F.exists(b["version_ranges"], lambda r: half(r, "start", "start_inclusive") | half(r, "end", "end_inclusive")))
    no_range = F.exists("bindings", lambda b: b["version_ranges"].isNull() | (F.size(b["version_ranges"]) == 0))
    nameless = F.exists("bindings", lambda b: b["vendor"].isNull() | b["product"].isNull())
    reason = F.when(F.col("cve_id").isNull(), "missing_id").when(F.coalesce(no_range, F.lit(False)), "empty_ranges").when(F.coalesce(bad_range, F.lit(False)), "half_bound").when(F.coalesce(nameless, F.lit(False)), "missing_name")
    return df.withColumn("reason", reason).where("reason is not null")
