"""Schemas of the nested records that the readers take."""

from __future__ import annotations

VERSION_ENTRY = "struct<version: string, status: string, lessThan: string, lessThanOrEqual: string, versionType: string, changes: array<struct<at: string, status: string>>>"
AFFECTED_ITEM = f"struct<vendor: string, product: string, defaultStatus: string, packageName: string, collectionURL: string, modules: array<string>, platforms: array<string>, cpes: array<string>, versions: array<{VERSION_ENTRY}>>"
CPE_MATCH = "struct<vulnerable: boolean, criteria: string, matchCriteriaId: string, versionStartIncluding: string, versionStartExcluding: string, versionEndIncluding: string, versionEndExcluding: string>"


def _node(depth: int) -> str:
    inner = _node(depth - 1) if depth else "string"
    below = f", children: array<{inner}>, nodes: array<{inner}>"
    return f"struct<operator: string, negate: boolean, cpeMatch: array<{CPE_MATCH}>, cpe_match: array<{CPE_MATCH}>{below}>"


#: Levels of nodes under a configuration; the records at hand have one or two. Deeper ones are kept as text, so that it shows that they are there.
NODE_DEPTH = 3
CONFIGURATION = _node(NODE_DEPTH)
RECORD = (
    "id string, cveId string, cve_id string, sourceIdentifier string, published string, lastModified string, vulnStatus string, descriptions array<struct<lang: string, value: string>>, "
    "references array<struct<url: string, source: string, tags: array<string>>>, "
    f"affected array<struct<source: string, affectedData: array<{AFFECTED_ITEM}>>>, configurations array<{CONFIGURATION}>, "
    "weaknesses array<struct<description: array<struct<lang: string, value: string>>>>, metrics map<string, array<struct<cvssData: struct<baseScore: double>>>>"
)
CHANGE = "cveId string, eventName string, cveChangeId string, sourceIdentifier string, created string, details array<struct<action: string, type: string, oldValue: string, newValue: string>>"
ADVISORY = (
    "id string, aliases array<string>, affected array<struct<package: struct<ecosystem: string, name: string, purl: string>, versions: array<string>, "
    "ranges: array<struct<type: string, repo: string, events: array<map<string, string>>>>>>"
)
OVERRIDE = (
    "repo string, results array<struct<repo: string, cve: string, state: string, tag_count: bigint, evaluated_tags: bigint, unknown_tags: bigint, "
    "proposal: struct<confidence: string, changed: boolean, ranges: array<struct<introduced: string, last_affected: string, fixed: string, fixed_source: string>>>>>"
)
EXTRACTION = "cve_id string, description string, bindings array<struct<vendor: string, product: string, version_ranges: array<struct<start: string, start_inclusive: boolean, end: string, end_inclusive: boolean>>>>"
