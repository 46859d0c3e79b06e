"""Schemas of the tables that operators pass on."""

from __future__ import annotations

#: What was observed, in the order of ``seq`` within a scan.
ACTIONS = "scan_id string, seq long, source string, value string"
#: Passes in the order of output.
PASSES = {"single": 1, "sequence": 2, "taint": 3, "shell": 4, "shell_ast": 5, "asi": 6, "absent": 7}
HITS = "scan_id string, pass int, seq long, rule_ord int, code string, signal string, source string, ambiguity boolean"
FINDINGS = (
    "scan_id string, pass int, seq long, rule_ord int, id string, title string, status string, confidence double, triggering_signal string, "
    "citation_url string, citation_version string, suggested_controls array<string>, cross_refs array<string>, rules_source string, "
    "rules_source_collapsed string, is_candidate boolean, ambiguity boolean, baseline_state string"
)
SUPPRESSED = FINDINGS + ", reason string, suppressed_by string, origin string"
