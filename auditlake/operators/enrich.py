"""Hits become findings: control citation, provenance status and cross references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import plain_llm_id
from auditlake.plans.pack import SCHEMA_VERSION, RulePack


def rule_dimension(pack: RulePack) -> list[tuple]:
    """Per rule: ord, code, title, status, confidence, citation url and version, controls, cross references.

    The citation is that of the first control that the catalogue carries, else the
    rule's own; one draft control makes the status draft.  References: agentic
    risks, the model risks they map to, techniques, management controls, articles,
    without repeats.
    """
    controls = {}
    for c in pack.controls:
        controls.setdefault(c.id, c)
    crosswalk = {}
    for asi, llm in pack.crosswalk:
        crosswalk.setdefault(asi, llm)
    out = []
    for r in pack.rules:
        carried = [controls[i] for i in r.controls if i in controls]
        url, version = (carried[0].url, carried[0].version) if carried else (r.citation, f"schema-{SCHEMA_VERSION}")
        status = "draft" if any(c.status == "draft" for c in carried) else "official"
        refs = list(r.asi)
        llm = [plain_llm_id(x) for a in r.asi for x in crosswalk.get(a, ())]
        for x in [*llm, *r.atlas, *r.iso42001, *r.eu_ai_act]:
            if x not in refs:
                refs.append(x)
        out.append((r.ord, r.code, r.name, status, r.confidence, url, version, list(r.controls), refs))
    return out


_DIMENSION = "rule_ord int, id string, title string, status string, confidence double, citation_url string, citation_version string, suggested_controls array<string>, cross_refs array<string>"


def rules_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """``rule_dimension`` as a table: a row per rule of the pack."""
    return spark.createDataFrame(rule_dimension(pack), _DIMENSION)


def enrich(hits: DataFrame, pack: RulePack) -> DataFrame:
    """Findings of hits; the rules are joined by broadcast, as a pack is driver-side data of a few rows."""
    dim = F.broadcast(rules_table(hits.sparkSession, pack))
    return hits.join(dim, "rule_ord").select(
        "scan_id", "pass", "seq", "rule_ord", "id", "title", "status", "confidence", F.col("signal").alias("triggering_signal"),
        "citation_url", "citation_version", "suggested_controls", "cross_refs", F.lit(pack.source).alias("rules_source"),
        F.lit(pack.source_collapsed).alias("rules_source_collapsed"), F.lit(True).alias("is_candidate"), "ambiguity",
        F.lit(None).cast("string").alias("baseline_state"), "source",
    )


def controls_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """The catalogue: ``ord, id, title, framework, version, url, status``."""
    return spark.createDataFrame([(c.ord, c.id, c.title, c.framework, c.version, c.url, c.status) for c in pack.controls], "ord int, id string, title string, framework string, version string, url string, status string")


def asi_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """Agentic risks: ``id, title, url, version, status``."""
    return spark.createDataFrame([tuple(x) for x in pack.asi], "id string, title string, url string, version string, status string")


def known_refs(pack: RulePack) -> set[str]:
    """What cross references may point to: entries of the tables that a pack carries."""
    return {i for i, *_ in pack.asi} | {i for k in ("atlas", "iso42001", "eu_ai_act") for i, _ in pack.xrefs[k]} | {c.id for c in pack.controls} | {plain_llm_id(x) for _, l in pack.crosswalk for x in l}


def ref_counts(findings: DataFrame, pack: RulePack) -> DataFrame:
    """``ref, resolved, n``: how many findings refer to what, and whether a table that the pack carries has it."""
    refs = findings.select(F.explode("cross_refs").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    return refs.select("ref", F.col("ref").isin(sorted(known_refs(pack))).alias("resolved"), "n")


def unresolved_refs(spark: SparkSession, pack: RulePack) -> DataFrame:
    """Cross references of rules that no carried table resolves; none in a sound pack."""
    targets = spark.createDataFrame([(x,) for x in sorted(known_refs(pack))], "ref string")
    refs = rules_table(spark, pack).select("id", F.explode("cross_refs").alias("ref"))
    return refs.join(F.broadcast(targets), "ref", "left_anti")
