from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from verdex.operators import replay, revisions
from verdex.sources import records
from verdex.streaming import changes as stream


def record(cve, modified="2024-01-02T00:00:00", status="Analyzed", **more):
    return {"cve": {"id": cve, "lastModified": modified, "vulnStatus": status, **more}}


@pytest.fixture
def folder(tmp_path):
    rows = [
        record("CVE-2024-1001"), record("cve-2024-1002", status="Rejected"), record("CVE-2024-1003"), record("CVE-2024-1004"),
        record("CVE-2024-1001", "2024-03-01T00:00:00", descriptions=[{"lang": "de", "value": "x"}, {"lang": "en-GB", "value": "y"}]),
    ]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n\n[1]\n{\"cve\": {\"id\": \"oops\"}}\nnot json\n{}\n")
    return tmp_path


def test_records_errors_and_winner(spark, folder):
    found = records.records(records.lines(spark, str(folder / "*.gz")))
    assert sorted((r["error"] or "") for r in found.collect()) == ["", "", "", "", "", "invalid_id", "invalid_json", "invalid_json", "missing_id"]
    best = revisions.latest(found.where("error is null").drop("record"), ["cve_id"], [F.col("modified_us"), F.col("digest")])
    assert {r["cve_id"]: r["status"] for r in best.collect()} == {"CVE-2024-1001": "Analyzed", "CVE-2024-1002": "Rejected", "CVE-2024-1003": "Analyzed", "CVE-2024-1004": "Analyzed"}
    texts = {r["cve_id"]: r["t"] for r in found.where("size(record.descriptions) > 0").select("cve_id", records.primary_description(F.col("record.descriptions")).alias("t")).collect()}
    assert texts == {"CVE-2024-1001": "y"}
    assert records.descriptions(found).count() == 2


def test_history_decides(spark, folder, tmp_path):
    log = tmp_path / "log.jsonl"
    event = lambda i, cve, name, at: {"change": {"cveId": cve, "eventName": name, "cveChangeId": i, "created": at, "details": []}}
    log.write_text("\n".join(map(json.dumps, [
        event("1", "CVE-2024-1001", "CVE Rejected", "2024-02-01T00:00:00"), event("2", "CVE-2024-1001", "CVE Unrejected", "2024-02-02T00:00:00"), event("2", "CVE-2024-1001", "CVE Unrejected", "2024-02-02T00:00:00"),
        event("3", "CVE-2024-1003", "CVE Rejected", "2024-02-01T00:00:00"), event("4", "CVE-2024-1004", "Modified Analysis", "2024-02-01T00:00:00"), event("5", "CVE-2024-9999", "New CVE", "2024-02-01T00:00:00"),
    ])))
    found = records.records(records.lines(spark, str(folder / "*.gz"))).where("error is null")
    best = revisions.latest(found.drop("record"), ["cve_id"], [F.col("modified_us"), F.col("digest")])
    states = revisions.change_state(records.changes(records.lines(spark, str(log))), "cve_id", F.struct("created_us", "change_id"), F.col("terminal"))
    decided = revisions.freshness(best, states, "cve_id", F.col("modified_us"), F.lower("status"), F.col("latest.created_us"), F.col("terminal_state"))
    assert {r["cve_id"]: r["decision"] for r in decided.collect()} == {
        "CVE-2024-1001": "current", "CVE-2024-1002": "record_status_rejected", "CVE-2024-1003": "terminal_history_rejected", "CVE-2024-1004": "stale_after_history",
    }
    assert [r["cve_id"] for r in revisions.without(states, best, ["cve_id"]).collect()] == ["CVE-2024-9999"]
    records.write_decided(decided.select("cve_id", "value", "decision"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/kept")).count() == 1 and spark.read.json(str(tmp_path / "out/quarantine")).count() == 3


def test_affected_and_configurations(spark, tmp_path):
    entry = {"version": "0", "status": "affected", "lessThan": "3.0", "changes": [{"at": "2.1", "status": "unaffected"}]}
    item = {"vendor": "v", "product": "p", "defaultStatus": "unaffected", "versions": [entry, {"version": "5.0", "status": "odd"}]}
    conf = {"operator": "AND", "nodes": [{"operator": "weird", "cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*"}]}, {"operator": "OR", "negate": True, "children": [{"cpe_match": [{"vulnerable": False, "criteria": "x"}]}]}]}
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps(record("CVE-2024-1001", affected=[{"source": "s", "affectedData": [item, {"vendor": "v", "product": "q"}]}], configurations=[conf])))
    found = records.records(records.lines(spark, str(path)))
    segments = records.version_entries(records.affected(found)).orderBy("item", "entry", "segment").collect()
    assert [(s["kind"], s["status"], s["lower"], s["upper"], s["upper_inclusive"], s["exact"]) for s in segments] == [
        ("range", "affected", None, "2.1", False, None), ("range", "unaffected", "2.1", "3.0", False, None), ("exact", "unknown", None, None, False, "5.0"), ("unspecified", "unknown", None, None, False, None),
    ]
    nodes, leaves = records.configuration_leaves(found)
    assert {(n["node"], n["parent"], n["operator"], n["negate"]) for n in nodes.collect()} == {("0", None, "AND", False), ("0.0", "0", "OR", False), ("0.1", "0", "OR", True), ("0.1.0", "0.1", "OR", False)}
    assert {(x["parent"], x["vulnerable"]) for x in leaves.collect()} == {("0.0", True), ("0.1.0", False)}


def test_advisories_and_overrides(spark, tmp_path):
    osv = {"id": "GHSA-1", "aliases": ["CVE-2024-1001"], "affected": [{"versions": ["1"], "ranges": [{"type": "GIT", "repo": "https://github.com/a/b", "events": [{"introduced": "0"}, {"fixed": "abc"}]}]}, {"versions": [], "ranges": []}]}
    (tmp_path / "o.json").write_text(json.dumps(osv))
    (got,) = records.advisories(records.lines(spark, str(tmp_path / "o.json"))).collect()
    assert tuple(got) == ("CVE-2024-1001", "GHSA-1", "https://github.com/a/b", "0", "abc")
    results = tmp_path / "results"
    results.mkdir()
    doc = {"repo": "a@b", "results": [{"repo": "a@b", "cve": "CVE-2024-1001", "state": "done", "proposal": {"confidence": "high", "changed": True, "ranges": []}}]}
    for name, text in (("1.json", json.dumps(doc)), ("2.json", json.dumps(doc)), ("3.json", "{half")):
        (results / name).write_text(text)
    good, bad = records.override_results(spark, str(results))
    assert good.count() == 1 and bad.count() == 1


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = [(1, 5, "rejected"), (1, 9, None), (2, 3, None), (1, 7, "active"), (2, 4, "rejected")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "key long, at_us long, terminal string").coalesce(1).write.parquet(source)
    got = {}
    read = spark.readStream.schema("key long, at_us long, terminal string").parquet(source)
    q = stream.folded(read).writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r["key"]: (r["changes"], r["latest_us"], r["terminal"], r["terminal_us"]) for r in b.collect()}))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got == {1: (3, 9, "active", 7), 2: (2, 4, "rejected", 4)}


def test_new_results_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text('{"repo": "x@y"}')
    for _ in range(2):
        stream.new_results(spark, str(tmp_path / "in"), "repo string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        (tmp_path / "in" / "c.json").write_text('{"repo": "x@y"}')
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_replay_and_parts(spark):
    base = spark.createDataFrame([("A", '["1-2", "3-4"]'), ("B", "[]")], "cve_id string, ranges string")
    log = spark.createDataFrame([("A", 2, "Changed", "1-2", "1-5"), ("A", 1, "Removed", "9", ""), ("A", 3, "Added", None, "7")], "cve_id string, at_us long, action string, old_value string, new_value string")
    assert {tuple(r) for r in replay.replay_ranges(base, log).collect()} == {("A", '["1-5","3-4","7"]', 2, 1), ("B", "[]", 0, 0)}
    groups = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 3)], "group string, size int")
    assert {r["group"]: r["part"] for r in replay.balanced_parts(groups, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_conditions_deeper_than_the_schema_stay_unknown(spark):
    import json

    from verdex.operators import applicability
    from verdex.sources import schemas

    def tree(depth):
        leaf = {"operator": "OR", "cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*"}]}
        for _ in range(depth):
            leaf = {"operator": "AND", "nodes": [leaf]}
        return leaf

    depths = [0, 1, schemas.NODE_DEPTH, schemas.NODE_DEPTH + 1, schemas.NODE_DEPTH + 5]
    rows = [(json.dumps({"cve": {"id": f"CVE-2024-{1000 + d}", "configurations": [tree(d)]}}), "m") for d in depths]
    found = records.records(spark.createDataFrame(rows, "value string, source_file string")).where("error is null").select("cve_id", "record")
    nodes, leaves = records.configuration_leaves(found)
    nodes, leaves = (x.withColumn("tree_id", F.concat_ws("#", "cve_id", "tree")) for x in (nodes, leaves))
    root = applicability.evaluate_tree(nodes.select("tree_id", "node", "parent", "level", "operator", "negate"), leaves.select("tree_id", "parent", F.col("vulnerable").alias("truth")), schemas.NODE_DEPTH)
    got = {int(r["tree_id"].split("#")[0][-4:]) - 1000: r["truth"] for r in root.collect()}
    assert got == {d: True if d <= schemas.NODE_DEPTH else None for d in depths}
