"""Reports that are derived from findings: risk rollup, baseline diff, control gap, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.enrich import asi_table, controls_table
from auditlake.plans.pack import RulePack
from auditlake.plans.schema import PASSES

_ORDER = ["pass", "seq", "rule_ord"]


def asi_rollup(findings: DataFrame, pack: RulePack) -> DataFrame:
    """A companion finding per scan and agentic risk that active findings refer to.

    Its signal names the distinct codes in the order they were first seen.
    """
    refs = findings.select("scan_id", *_ORDER, "id", F.posexplode("cross_refs").alias("p", "asi")).filter(F.col("asi").rlike("^ASI[0-9]{2}$"))
    first = refs.groupBy("scan_id", "asi", "id").agg(F.min(F.struct(*_ORDER, "p")).alias("at"))
    per_risk = first.groupBy("scan_id", "asi").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "id"))).alias("seen"))  # at most a pack's codes
    codes = F.transform("seen", lambda s: s["id"])
    risks = asi_table(findings.sparkSession, pack).select(F.col("id").alias("asi"), "title", F.col("url").alias("citation_url"), F.col("version").alias("citation_version"), "status")
    return per_risk.join(F.broadcast(risks), "asi").select(
        "scan_id", F.lit(PASSES["asi"]).alias("pass"), (F.col("at.pass") * F.lit(1 << 56) + F.col("at.seq")).alias("seq"), (F.col("at.rule_ord") * 1000 + F.col("at.p")).cast("int").alias("rule_ord"),
        F.col("asi").alias("id"), "title", "status", F.lit(1.0).alias("confidence"), F.concat(F.lit("AGT cross-reference: "), F.array_join(codes, ", ")).alias("triggering_signal"),
        "citation_url", "citation_version", codes.alias("suggested_controls"), codes.alias("cross_refs"), F.lit(pack.source).alias("rules_source"),
        F.lit(pack.source_collapsed).alias("rules_source_collapsed"), F.lit(True).alias("is_candidate"), F.lit(False).alias("ambiguity"), F.lit(None).cast("string").alias("baseline_state"), F.lit(None).cast("string").alias("source"),
    )


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with ``baseline_state`` (new or unchanged), and a row per baseline finding that is gone (absent).

    ``baseline`` has ``scan_id``, ``id`` and ``triggering_signal`` and may have any other column of findings.
    """
    defaults = {"pass": F.lit(PASSES["absent"]), "status": F.lit("official"), "confidence": F.lit(0.0), "title": F.col("id"), "is_candidate": F.lit(True), "ambiguity": F.lit(False)}
    columns = []
    for f in findings.schema:
        if f.name in ("pass", "baseline_state"):
            value = F.lit(PASSES["absent"]) if f.name == "pass" else F.lit("absent")
        elif f.name in baseline.columns:
            value = F.coalesce(F.col(f.name).cast(f.dataType), defaults.get(f.name, F.lit(None)).cast(f.dataType))
        else:
            value = defaults.get(f.name, F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    # Both sides meet in one shuffle by key, so each is read once.
    both = findings.withColumn("_now", F.lit(True)).unionByName(baseline.select(columns).withColumn("_now", F.lit(False)))
    return baseline_states(both, "_now").select(findings.columns)


def baseline_states(both: DataFrame, now: str) -> DataFrame:
    """As ``baseline_diff`` for findings of both sides in one table, told apart by the truth value ``now``, which goes."""
    columns = [c for c in both.columns if c not in (now, "baseline_state")]
    both = both.select(*columns, F.col(now).alias("_now"))
    same = Window.partitionBy("scan_id", "id", "triggering_signal")
    both = both.withColumn("_both", F.min("_now").over(same) != F.max("_now").over(same))
    state = F.when(~F.col("_now"), "absent").when(F.col("_both"), "unchanged").otherwise("new")
    return both.filter("_now OR NOT _both").select(*columns, state.alias("baseline_state"))


def baseline_counts(diffed: DataFrame) -> DataFrame:
    """One row: how many findings are ``new``, ``unchanged`` and ``absent``."""
    return diffed.agg(*(F.count_if(F.col("baseline_state") == s).alias(s) for s in ("new", "unchanged", "absent")))


def only_new(findings: DataFrame) -> DataFrame:
    """Findings that the baseline lacks."""
    return findings.filter("baseline_state = 'new'")


def control_gap(findings: DataFrame, pack: RulePack, per_scan: bool = False) -> DataFrame:
    """Controls without any active finding, in the catalogue's order."""
    controls = controls_table(findings.sparkSession, pack)
    covered = findings.select(*(["scan_id"] if per_scan else []), F.explode("suggested_controls").alias("id")).distinct()
    if per_scan:
        universe = findings.select("scan_id").distinct().join(F.broadcast(controls))  # 49 rows a scan
        left = universe.join(covered, ["scan_id", "id"], "left_anti")
    else:
        left = controls.join(covered, "id", "left_anti")
    message = F.concat(F.lit("no candidate evidence observed for "), "id", F.lit(" ("), "title", F.lit(")"))
    return left.select(*(["scan_id"] if per_scan else []), "ord", "id", "title", "status", message.alias("message"))


def gap_counts(findings: DataFrame, pack: RulePack) -> DataFrame:
    """One row: ``universe, covered, gaps``."""
    controls = controls_table(findings.sparkSession, pack)
    covered = findings.select(F.explode("suggested_controls").alias("id")).distinct().withColumn("c", F.lit(1))
    return controls.join(covered, "id", "left").agg(F.count("*").alias("universe"), F.count("c").alias("covered"), F.count_if(F.col("c").isNull()).alias("gaps"))


def triage_manifest(findings: DataFrame) -> DataFrame:
    """Active findings that fired in an ambiguous context."""
    return findings.filter("ambiguity").select("scan_id", *_ORDER, "id", "title", "triggering_signal", "confidence", "suggested_controls")


def outcome_counts(actions: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: actions, active findings and suppressed ones."""
    a = actions.agg(F.count("*").alias("actions"))
    b = routed.agg(F.count_if(F.col("origin").isNull()).alias("findings"), F.count_if(F.col("origin").isNotNull()).alias("suppressed"))
    return a.join(b)  # one row each
