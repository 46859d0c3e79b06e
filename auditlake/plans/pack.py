"""Rule packs, configuration and allowlists: what the driver reads before any job runs."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from auditlake.packs import stock

SCHEMA_VERSION = 1
#: Environment variable that may name a pack folder.
PACK_ENV = "AUDITLAKE_RULES_DIR"
KINDS = ("sequence", "taint", "shell")


class PackError(ValueError):
    """A pack that can't be used; raised before any job starts."""


@dataclass(frozen=True)
class Step:
    """One side of an ordered pair, or the conditions of a single-action rule."""

    signals: tuple[str, ...] = ()
    source_kinds: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """A detection rule; ``ord`` is its place in the pack."""

    ord: int
    code: str
    name: str
    severity: int
    confidence: float
    citation: str
    controls: tuple[str, ...] = ()
    asi: tuple[str, ...] = ()
    atlas: tuple[str, ...] = ()
    iso42001: tuple[str, ...] = ()
    eu_ai_act: tuple[str, ...] = ()
    kind: str = "single"
    main: Step = field(default_factory=Step)
    source: Step = field(default_factory=Step)
    sink: Step = field(default_factory=Step)
    roles: tuple[str, ...] = ()
    binary: str = ""
    flags: tuple[str, ...] = ()
    constructs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Control:
    """A catalogue entry; ``version`` and ``url`` are what a finding cites."""

    ord: int
    id: str
    title: str
    framework: str
    version: str
    url: str
    status: str


@dataclass(frozen=True)
class RulePack:
    """Rules and catalogues, in file order, and where they came from."""

    rules: tuple[Rule, ...]
    controls: tuple[Control, ...]
    asi: tuple[tuple[str, str, str, str, str], ...]  # id, title, url, version, status
    crosswalk: tuple[tuple[str, tuple[str, ...]], ...]
    xrefs: dict[str, tuple[tuple[str, str], ...]]
    source: str = "embedded-fallback"
    warnings: tuple[str, ...] = ()

    @property
    def source_collapsed(self) -> str:
        """``file`` or ``embedded-fallback``."""
        return self.source if self.source == "embedded-fallback" else "file"

    def of_kind(self, kind: str) -> list[Rule]:
        return [r for r in self.rules if r.kind == kind]

    def severity(self) -> dict[str, int]:
        """Severity by code; of repeated codes the first counts."""
        out: dict[str, int] = {}
        for r in self.rules:
            out.setdefault(r.code, r.severity)
        return out


def status_of(text: Any) -> str:
    """``draft`` or ``official``; anything unknown counts as official."""
    return "draft" if str(text).strip().lower() == "draft" else "official"


def _fragments(code: str, fragments: Any, warnings: list[str]) -> tuple[str, ...]:
    """Context patterns that compile; others are warned of and left out."""
    out = []
    for f in fragments or ():
        try:
            re.compile(f)
        except re.error as e:
            warnings.append(f"{code}: context fragment {f!r} ignored: {e}")
        else:
            out.append(f)
    return tuple(out)


def make_rule(ord_: int, row: dict, warnings: list[str]) -> Rule:
    """A rule from a row in the layout of ``packs.stock``."""
    code = row["code"]

    def step(x: dict) -> Step:
        return Step(tuple(x.get("signals") or ()), tuple(x.get("source_kinds") or ()), _fragments(code, x.get("require"), warnings), _fragments(code, x.get("deny"), warnings))

    return Rule(
        ord_,
        code,
        row["name"],
        int(row["severity"]),
        float(row["confidence"]),
        row.get("citation") or f"rule:{code}",
        *(tuple(row.get(k) or ()) for k in ("controls", "asi", "atlas", "iso42001", "eu_ai_act")),
        kind=row.get("kind", "single"),
        main=step(row),
        source=step(row.get("source") or {}),
        sink=step(row.get("sink") or {}),
        roles=tuple(row.get("roles") or ()),
        binary=row.get("binary", ""),
        flags=tuple(row.get("flags") or ()),
        constructs=tuple(row.get("constructs") or ()),
    )


def embedded_pack() -> RulePack:
    """The stock pack."""
    warnings: list[str] = []
    rules = tuple(make_rule(i, r, warnings) for i, r in enumerate(stock.RULES))
    flat = [(i, t, f, v, u, s) for f, v, u, s, rows in stock.CONTROLS for i, t in rows]
    controls = tuple(Control(n, *row) for n, row in enumerate(flat))
    asi = tuple((i, t, stock.ASI_URL, stock.ASI_VERSION, stock.ASI_STATUS) for i, t in stock.ASI_RISKS)
    xrefs = {"ast": tuple(stock.SKILL_RISKS), "atlas": tuple(stock.ATLAS), "iso42001": tuple(stock.ISO42001), "eu_ai_act": tuple(stock.EU_AI_ACT)}
    return RulePack(rules, controls, asi, tuple((a, tuple(b)) for a, b in stock.CROSSWALK), xrefs, warnings=tuple(warnings))


# The files of a pack folder, each with the key of its rows.
PACK_FILES = {
    "rules": ("detection-rules", "rules"),
    "controls": ("controls-49", "controls"),
    "asi": ("asi-2026", "risks"),
    "ast": ("ast-2026", "risks"),
    "atlas": ("atlas-2026", "techniques"),
    "iso42001": ("iso42001-2023", "controls"),
    "eu_ai_act": ("eu-ai-act-2024", "articles"),
    "crosswalk": ("crosswalk-asi-llm", "crosswalk"),
}


def _read(folder: Path, stem: str) -> dict:
    """A pack file as YAML, where a YAML parser is installed, or as JSON."""
    for suffix in (".yaml", ".yml", ".json"):
        path = folder / (stem + suffix)
        if not path.is_file():
            continue
        text = path.read_text(encoding="utf-8")
        try:
            if suffix == ".json":
                data = json.loads(text)
            else:
                try:
                    import yaml
                except ImportError:
                    raise PackError(f"{path}: no YAML parser is installed; use JSON") from None
                data = yaml.safe_load(text)
        except PackError:
            raise
        except Exception as e:
            raise PackError(f"{path}: {e}") from e
        found = data.get("schema_version") if isinstance(data, dict) else None
        if found != SCHEMA_VERSION:
            raise PackError(f"{path}: schema_version is {found!r}, expected {SCHEMA_VERSION}")
        return data
    raise PackError(f"{folder}: {stem} is missing")


def _is_pack(folder: Path) -> bool:
    return any((folder / f"{PACK_FILES['rules'][0]}{s}").is_file() for s in (".yaml", ".yml", ".json"))


def _row(r: dict) -> dict:
    """A rule of a pack file in the layout of ``packs.stock``."""

    def step(x: dict | None) -> dict:
        x = x or {}
        return {"signals": x.get("signals"), "source_kinds": x.get("source_kinds"), "require": x.get("require_context"), "deny": x.get("deny_context")}

    out = {"code": r["agt_code"], "name": r["name"], "severity": r["severity"], "confidence": r["default_confidence"], "citation": r.get("citation"), "controls": r.get("maps_to_controls")}
    out |= {k: r.get(f"{k}_xref") for k in ("asi", "atlas", "iso42001", "eu_ai_act")}
    for kind, a, b in (("sequence", "source_step", "sink_step"), ("taint", "taint_source", "taint_sink")):
        if r.get(kind):
            return out | {"kind": kind, "source": step(r[kind].get(a)), "sink": step(r[kind].get(b)), "roles": r[kind].get("require_value_from_source")}
    if r.get("shell"):
        s = r["shell"]
        return out | step(s) | {"kind": "shell", "binary": s["binary"], "flags": s.get("all_flags"), "constructs": s.get("ast_only_constructs")}
    return out | step(r)


def load_folder(folder: str | Path, source: str = "cli-dir") -> RulePack:
    """A pack from its eight files; any unreadable file or other schema version raises."""
    folder = Path(folder)
    data = {k: _read(folder, stem) for k, (stem, _) in PACK_FILES.items()}
    rows = {k: data[k].get(key) or [] for k, (_, key) in PACK_FILES.items()}
    warnings: list[str] = []
    rules = tuple(make_rule(i, _row(r), warnings) for i, r in enumerate(rows["rules"]))
    controls = tuple(Control(i, c["id"], c["title"], c["framework"], str(c["version"]), c["source_url"], status_of(c.get("status"))) for i, c in enumerate(rows["controls"]))
    asi = tuple((r["id"], r["title"], r.get("url") or data["asi"].get("source_url", ""), str(r.get("version") or data["asi"].get("version", "")), status_of(r.get("status"))) for r in rows["asi"])
    xrefs = {k: tuple((r["id"], r.get("title") or r.get("name")) for r in rows[k]) for k in ("ast", "atlas", "iso42001", "eu_ai_act")}
    crosswalk = tuple((r["asi_id"], tuple(r["llm_ids"])) for r in rows["crosswalk"])
    return RulePack(rules, controls, asi, crosswalk, xrefs, source, tuple(warnings))


def load_pack(rules_dir: str | Path | None = None) -> RulePack:
    """The first of: the given folder, the one in ``AUDITLAKE_RULES_DIR``, ``rules/`` beside the package, the stock pack.

    A folder counts only if it holds the rule file, so a given one without it falls through.
    """
    beside = Path(__file__).resolve().parents[2] / "rules"
    for folder, source in ((rules_dir, "cli-dir"), (os.environ.get(PACK_ENV), "env-dir"), (beside, "exe-relative")):
        if folder and _is_pack(Path(folder)):
            return load_folder(folder, source)
    return embedded_pack()


@dataclass(frozen=True)
class SuppressRule:
    """An allowlist entry; a field that is None matches anything."""

    code: str | None
    signal: str | None
    source_glob: str | None
    reason: str
    raw: str


def parse_suppress(text: str) -> list[SuppressRule]:
    """Lines ``code[:signal[:source_glob]] [# reason]``; a ``#`` starts the reason anywhere."""
    out = []
    for line in text.splitlines():
        pattern, _, reason = line.partition("#")
        pattern = pattern.strip()
        if pattern:
            parts = [p.strip() for p in pattern.split(":", 2)] + [""] * 2
            out.append(SuppressRule(*(None if p in ("", "*") else p for p in parts[:3]), reason.strip() or "allowlisted", pattern))
    return out


@dataclass(frozen=True)
class Config:
    """Thresholds, severity overrides and allowlist entries of a TOML file."""

    min_confidence: float | None = None
    min_severity: int | None = None
    severity: dict[str, int] = field(default_factory=dict)
    suppress: tuple[SuppressRule, ...] = ()


CONFIG_NAME, SUPPRESS_NAME = ".auditlake.toml", ".auditlake-suppress"


def parse_config(text: str) -> Config:
    """A config from TOML text; values out of range raise."""
    data = tomllib.loads(text)
    limits = data.get("thresholds", {})
    overrides = {str(k): int(v) for k, v in data.get("severity", {}).items()}
    severity = limits.get("min_severity")
    for v in [*overrides.values(), *([severity] if severity is not None else [])]:
        if not 0 <= v <= 255:
            raise ValueError(f"severity {v} is out of range")
    rules = []
    for s in data.get("suppress", []):
        glob = s.get("source_glob")
        raw = s["agt_code"] + (f":*:{glob}" if glob else "")
        rules.append(SuppressRule(None if s["agt_code"] in ("", "*") else s["agt_code"], None, None if glob in (None, "", "*") else glob, s.get("reason") or "allowlisted", raw))
    return Config(limits.get("min_confidence"), severity, overrides, tuple(rules))


def find_config(path: str | Path | None = None, target: str | Path | None = None) -> Config:
    """The named config, which must exist, or the one beside the scanned target, which need not."""
    if path is not None:
        return parse_config(Path(path).read_text(encoding="utf-8"))
    beside = target_folder(target) / CONFIG_NAME
    return parse_config(beside.read_text(encoding="utf-8")) if beside.is_file() else Config()


def find_suppress(path: str | Path | None = None, target: str | Path | None = None) -> list[SuppressRule]:
    """Entries of the named allowlist or of the one beside the target; a missing file has none."""
    file = Path(path) if path is not None else target_folder(target) / SUPPRESS_NAME
    return parse_suppress(file.read_text(encoding="utf-8")) if file.is_file() else []


def target_folder(target: str | Path | None) -> Path:
    """The folder itself, a file's folder, or the current one."""
    if target is None:
        return Path.cwd()
    target = Path(target)
    return target if target.is_dir() else target.parent


def merged_suppress(file_rules: list[SuppressRule], config: Config) -> list[SuppressRule]:
    """Entries of the file come first."""
    return [*file_rules, *config.suppress]
