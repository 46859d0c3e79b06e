"""Reports as JSON, SARIF 2.1.0 and Markdown.

``findings_json`` stays distributed, a JSON text per finding.  ``to_json`` and its
like render one scan on the driver; ``plans.documents`` writes those of all scans where the findings are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from auditlake import __version__
from auditlake.plans.detect import Report

# Names of the formats.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
PREFIX = "CANDIDATE — "
LEVELS = {"official": "warning", "draft": "note"}
MANIFEST_SCHEMA = "auditlake-triage-manifest/1"
GAP_KIND = "absence-of-candidate-evidence"
#: What every gap report says of itself.
GAP_DISCLAIMER = "That no candidate signal was seen does not show that a control is missing; a person has to review each one."
GAP_SCOPE = "Only the controls of the catalogue are looked at; standards that it merely cites are out of scope."
_ORDER = ["pass", "seq", "rule_ord"]


def findings_json(findings: DataFrame, *more: str) -> DataFrame:
    """``scan_id, pass, seq, rule_ord, json`` and the columns ``more``; ``ambiguity`` only if true, ``baseline_state`` only if set."""
    body = F.struct(
        "id", "title", "status", "confidence", "triggering_signal", F.struct(F.col("citation_url").alias("url"), F.col("citation_version").alias("version")).alias("citation"),
        "suggested_controls", "cross_refs", "rules_source", "rules_source_collapsed", "is_candidate", F.when(F.col("ambiguity"), F.lit(True)).alias("ambiguity"), "baseline_state",
        *[c for c in ("reason", "suppressed_by", "origin") if c in findings.columns],
    )
    return findings.select("scan_id", *_ORDER, F.to_json(body).alias("json"), *more)


def _rows(df: DataFrame, scan_id: str) -> list[dict]:
    """One scan's findings in the order of output."""
    return [json.loads(r["json"]) for r in findings_json(df.filter(F.col("scan_id") == scan_id)).orderBy(*_ORDER).collect()]


def report_document(report: Report, scan_id: str) -> dict:
    """The JSON report of a scan."""
    return {"rules_source": report.pack.source, "rules_source_collapsed": report.pack.source_collapsed, "findings": _rows(report.findings, scan_id), "suppressed": _rows(report.suppressed, scan_id)}


def to_json(report: Report, scan_id: str) -> str:
    return json_text(report_document(report, scan_id))


def json_text(doc: dict) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False)


def _sarif_result(f: dict) -> dict:
    text = f"{PREFIX}{f['title']} (signal: {f['triggering_signal']}). Review suggested control(s): {', '.join(f['suggested_controls'])}. Source provenance: {f['status']}."
    properties = {k: f[k] for k in ("citation", "confidence", "status", "cross_refs", "suggested_controls")}
    properties |= {"rules_source": f["rules_source_collapsed"], "is_candidate": f["is_candidate"]}
    out = {"ruleId": f["id"], "level": LEVELS[f["status"]], "message": {"text": text}, "properties": properties}
    if "baseline_state" in f:
        out["baselineState"] = f["baseline_state"]
    if f.get("origin") == "allowlist":
        out["suppressions"] = [{"kind": "external", "justification": f["reason"]}]
        properties["suppressed_by"] = f["suppressed_by"]
    elif f.get("origin") == "threshold":
        properties |= {"dropped_by_threshold": True, "dropped_reason": f["reason"]}
    return out


def _sarif(descriptors: list[dict], results: list[dict], properties: dict) -> str:
    driver = {"name": "auditlake", "version": __version__, "rules": descriptors}
    return json.dumps({"version": SARIF_VERSION, "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": driver}, "properties": properties, "results": results}]}, indent=2, ensure_ascii=False)


def _descriptor(id_: str, title: str, status: str) -> dict:
    return {"id": id_, "name": title, "shortDescription": {"text": title}, "properties": {"status": status}}


def to_sarif(report: Report, scan_id: str) -> str:
    """Active results, then suppressed ones; a descriptor per id, by id."""
    return sarif_text(report_document(report, scan_id))


def sarif_text(doc: dict) -> str:
    return sarif_of([json.dumps(f) for f in doc["findings"] + doc["suppressed"]], doc["rules_source_collapsed"])


def sarif_of(findings: Iterable[str], source: str) -> str:
    """``sarif_text`` of findings as JSON, active ones first; what a finding gives is made once, as the same ones stand in many documents."""
    descriptors, results = {}, []
    for f in findings:
        id_, descriptor, result = _sarif_parts(f)
        descriptors.setdefault(id_, descriptor)
        results.append(result)
    # The lists stand empty in the text around them, each in a line of its own; no value holds a line break.
    head, mid, end = re.split(r"(?<=^          \"rules\": )\[\]|(?<=^      \"results\": )\[\]", _sarif([], [], {"rules_source": source}), flags=re.M)
    return "".join((head, _json_list([descriptors[k] for k in sorted(descriptors)], 5), mid, _json_list(results, 3), end))


@lru_cache(4096)
def _sarif_parts(finding: str) -> tuple[str, str, str]:
    """Id, descriptor and result of a finding, the latter two as they stand in a document."""
    f = json.loads(finding)
    return f["id"], _indented(_descriptor(f["id"], f["title"], f["status"]), 6), _indented(_sarif_result(f), 4)


def _indented(value: object, depth: int) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def _json_list(items: list[str], depth: int) -> str:
    """A list, in a line of ``depth``, of texts made for a level more."""
    inner = "\n" + "  " * (depth + 1)
    return "[" + ",".join(inner + x for x in items) + "\n" + "  " * depth + "]" if items else "[]"


def _listed(items: list[str]) -> str:
    return ", ".join(items) or "—"


def _md_finding(f: dict) -> Iterator[str]:
    yield f"- {PREFIX}**{f['id']}** {f['title']} — status: `{f['status']}`, confidence: {f['confidence']:.2f}"
    yield f"  - triggering_signal: `{f['triggering_signal']}`"
    yield f"  - suggested_controls: {_listed(f['suggested_controls'])}"
    yield f"  - cross_refs: {_listed(f['cross_refs'])}"
    yield f"  - citation: <{f['citation']['url']}> (version {f['citation']['version']})"
    if "reason" in f:
        yield f"  - suppressed: {f['reason']} (by `{f['suppressed_by']}`)"


def to_markdown(report: Report, scan_id: str) -> str:
    """Counts, then sections for findings, allowlisted ones and those below a threshold."""
    return markdown_text(report_document(report, scan_id))


def markdown_text(doc: dict) -> str:
    out = ["# Agent action audit — candidate findings", "", f"**Rules source:** `{doc['rules_source_collapsed']}` · **Findings:** {len(doc['findings'])} · **Suppressed:** {len(doc['suppressed'])}", ""]
    if not doc["findings"] and not doc["suppressed"]:
        return "\n".join([*out, "No candidate signals matched.", ""])
    out += ["## Findings", ""]
    out += [line for f in doc["findings"] for line in _md_finding(f)] or ["No active candidate signals matched."]
    for origin, title in (("allowlist", "Suppressed (allowlisted)"), ("threshold", "Dropped by threshold")):
        part = [f for f in doc["suppressed"] if f["origin"] == origin]
        if part:
            out += ["", f"## {title}", "", *(line for f in part for line in _md_finding(f))]
    return "\n".join([*out, ""])


def manifest_json(report: Report, scan_id: str) -> str:
    """The triage manifest, also if empty."""
    rows = _rows(report.findings.filter("ambiguity"), scan_id)
    keep = ("id", "title", "triggering_signal", "confidence", "suggested_controls")
    return json.dumps({"schema": MANIFEST_SCHEMA, "note": "ambiguous candidates to review before acting", "candidates": [{k: f[k] for k in keep} for f in rows]}, ensure_ascii=False)


def _gap_rows(report: Report) -> list[Row]:
    return report.gap().orderBy("ord").collect()  # at most the catalogue


def gap_json(report: Report) -> str:
    rows = _gap_rows(report)
    n = len(report.pack.controls)
    return json.dumps({"rules_source": report.pack.source, "rules_source_collapsed": report.pack.source_collapsed, "scope": GAP_SCOPE, "disclaimer": GAP_DISCLAIMER, "universe": n, "covered": n - len(rows), "gaps": [{k: r[k] for k in ("id", "title", "status", "message")} for r in rows]}, indent=2, ensure_ascii=False)


def gap_markdown(report: Report) -> str:
    rows = _gap_rows(report)
    n = len(report.pack.controls)
    head = ["# Control gap — controls without candidate evidence", "", f"_{GAP_SCOPE}_", "", f"_{GAP_DISCLAIMER}_", "", f"**Rules source:** `{report.pack.source_collapsed}` · **Universe:** {n} · **With candidate evidence:** {n - len(rows)} · **Without:** {len(rows)}", ""]
    lines = [f"- {r['message']} — status: `{r['status']}`" for r in rows] or ["Each control of the catalogue has candidate evidence."]
    return "\n".join([*head, *lines, ""])


def gap_sarif(report: Report) -> str:
    rows = _gap_rows(report)
    results = [{"ruleId": r["id"], "level": "note", "message": {"text": r["message"]}, "properties": {"status": r["status"], "kind": GAP_KIND}} for r in rows]
    return _sarif([_descriptor(r["id"], r["title"], r["status"]) for r in rows], results, {"analysis": "gap", "scope": GAP_SCOPE, "disclaimer": GAP_DISCLAIMER, "rules_source": report.pack.source_collapsed, "universe": len(report.pack.controls), "covered": len(report.pack.controls) - len(rows)})


def audit_log(actions: DataFrame, report: Report, skips: DataFrame | None = None) -> DataFrame:
    """``scan_id, pass, seq, rule_ord, line``: what an operator's log shows.

    A scan's first line (pass 0) has the rules' source and its number of actions; then a line
    per skip (``skips``: ``scan_id, seq, place, reason``), per finding and per suppressed one.
    """
    head = actions.groupBy("scan_id").agg(F.concat(F.lit(f"rules_source: {report.pack.source}; actions: "), F.count("*").cast("string")).alias("line"))
    out = head.select("scan_id", F.lit(0).alias("pass"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("rule_ord"), "line")
    if skips is not None:
        out = out.union(skips.select("scan_id", F.lit(0), "seq", F.lit(0), F.concat(F.lit("skip: "), "place", F.lit(": "), "reason")))
    hit = F.concat(F.lit("match: "), "id", F.lit(" "), "triggering_signal", F.lit(" in "), F.coalesce("source", F.lit("-")))
    moved = F.concat(F.lit("suppressed: "), "id", F.lit(" by "), "suppressed_by")
    if report.routed is not None:  # one read of the actions
        return out.union(report.routed.select("scan_id", *_ORDER, F.when(F.col("origin").isNull(), hit).otherwise(moved)))
    return out.union(report.findings.select("scan_id", *_ORDER, hit)).union(report.suppressed.select("scan_id", *_ORDER, moved))


def sarif_results(routed: DataFrame) -> DataFrame:
    """SARIF results as columns, a row per finding, distributed: ``scan_id, pass, seq, rule_ord, rule_id, level, message, suppression, justification, dropped_reason``."""
    level = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("status")]
    message = F.concat(F.lit(PREFIX), "title", F.lit(" (signal: "), "triggering_signal", F.lit("). Review suggested control(s): "), F.array_join("suggested_controls", ", "), F.lit(". Source provenance: "), "status", F.lit("."))
    listed, dropped = F.col("origin") == "allowlist", F.col("origin") == "threshold"
    return routed.select("scan_id", *_ORDER, F.col("id").alias("rule_id"), level.alias("level"), message.alias("message"), F.when(listed, "external").alias("suppression"), F.when(listed, F.col("reason")).alias("justification"), F.when(dropped, F.col("reason")).alias("dropped_reason"))


def exit_code(report: Report, block: bool = False) -> int:
    """0, or 2 if blocking is on and any candidate is active."""
    return 2 if block and not report.findings.isEmpty() else 0
