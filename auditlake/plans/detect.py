"""The query plan from actions to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import derive
from auditlake.operators.enrich import enrich
from auditlake.operators.match import all_hits
from auditlake.operators.route import allowlist_table, route
from auditlake.plans.pack import Config, RulePack, SuppressRule, embedded_pack, merged_suppress


@dataclass
class Report:
    """Lazy tables of a detection run."""

    findings: DataFrame
    suppressed: DataFrame
    pack: RulePack
    #: Active and suppressed findings in one table with ``reason, suppressed_by, origin`` (null: active), from one read.
    routed: DataFrame | None = None

    def gap(self) -> DataFrame:
        """Controls without evidence.  It looks at findings as they are before the rollup and the baseline."""
        return derive.control_gap(self.findings, self.pack)

    def by_asi(self) -> Report:
        """With a companion per agentic risk."""
        return Report(self.findings.unionByName(derive.asi_rollup(self.findings, self.pack)), self.suppressed, self.pack)

    def against(self, baseline: DataFrame, only_new: bool = False) -> Report:
        """With baseline states; on demand the new ones only."""
        found = derive.baseline_diff(self.findings, baseline)
        return Report(derive.only_new(found) if only_new else found, self.suppressed, self.pack)

    def manifest(self) -> DataFrame:
        """What a reviewer should look at first."""
        return derive.triage_manifest(self.findings)


def detect(
    actions: DataFrame,
    pack: RulePack | None = None,
    suppress: list[SuppressRule] | DataFrame = (),
    config: Config = Config(),
    min_confidence: float | None = None,
    min_severity: int | None = None,
    by_asi: bool = False,
    baseline: DataFrame | None = None,
    only_new: bool = False,
    shell_ast: bool = False,
) -> Report:
    """Findings and suppressed findings of any number of scans; runs no job.

    The order of stages: match, allowlist, thresholds, rollup, baseline.  A long
    allowlist is a table (``operators.route.ALLOWLIST``).
    """
    pack = pack or embedded_pack()
    if isinstance(suppress, DataFrame):  # entries of the config come after those of the table
        more = [r for r in merged_suppress([], config)]
        last = suppress.agg(F.coalesce(F.max("entry") + 1, F.lit(0)).alias("_n"))
        entries = suppress.unionByName(allowlist_table(actions.sparkSession, more).join(last).withColumn("entry", F.col("entry") + F.col("_n")).drop("_n")) if more else suppress
    else:
        entries = merged_suppress(list(suppress), config)
    routed = route(enrich(all_hits(actions, pack, shell_ast), pack), pack, entries, config, min_confidence, min_severity)
    report = Report(routed.filter(F.col("origin").isNull()).drop("reason", "suppressed_by", "origin"), routed.filter(F.col("origin").isNotNull()), pack, routed)
    if by_asi:
        report = report.by_asi()
    if baseline is not None:
        report = report.against(baseline, only_new)
    return report
