"""Transcripts parsed by plain Python: what the Spark plan is compared with."""

from __future__ import annotations

import json
from collections.abc import Iterator

from auditlake.functions.text import INPUT_ROLES
from auditlake.sources.session import INERT_TYPES, INPUT_FIELD, PER_LINE, TESTED_VERSION

_ROLE_OF = {f: r for r, fields in INPUT_ROLES.items() for f in fields}


def rendered_call(name: str, fields: dict) -> str | None:
    """``tool-call:NAME`` with the first text of each role, in the order of roles; None without any.  Fields go by name."""
    roles: dict[str, str] = {}
    for field in sorted(fields):
        role = _ROLE_OF.get(field.lower())
        if role and isinstance(fields[field], str):
            roles.setdefault(role, fields[field])
    if not roles:
        return None
    return f"tool-call:{name}" + "".join(f" {r}={roles[r]}" for r in INPUT_ROLES if r in roles)


def relevant_input(name: str, fields: object) -> str | None:
    """The text of a tool's input that is matched; for unknown tools all top-level texts."""
    if not isinstance(fields, dict):
        return None
    if name in INPUT_FIELD:
        found = fields.get(INPUT_FIELD[name])
        return found if isinstance(found, str) else None
    texts = [fields[k] for k in sorted(fields) if isinstance(fields[k], str)]
    return " ".join(texts) if texts else None


def _blocks(obj: dict, kind: str) -> list[dict]:
    message = obj.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    return [b for b in content if isinstance(b, dict) and b.get("type") == kind] if isinstance(content, list) else []


def _result_text(content: object) -> str | None:
    if isinstance(content, str):
        return content or None
    if isinstance(content, list):
        texts = [p["text"] for p in content if isinstance(p, dict) and isinstance(p.get("text"), str)]
        return " ".join(texts) if texts else None
    return None


def line_actions(obj: dict, kind: str) -> list[tuple[str, str, bool]]:
    """Actions of one object: (source, value, whether the value is to be normalised)."""
    out: list[tuple[str, str, bool]] = []
    if kind == "assistant":
        for b in _blocks(obj, "tool_use"):
            name, fields = b.get("name"), b.get("input")
            if not isinstance(name, str):
                continue
            value = relevant_input(name, fields)
            if value is not None:
                out.append((f"session:{name}.input", value, True))
                call = rendered_call(name, fields)
                if call is not None:
                    out.append((f"sink:{name}", call, False))
        return out
    for b in [obj] if obj.get("type") == "tool_result" else _blocks(obj, "tool_result"):
        id_ = b.get("tool_use_id")
        text = _result_text(b.get("content"))
        if text is not None:
            out.append((f"tool-result:{id_ if isinstance(id_, str) else len(out)}", text, False))
    return out


def version_warning(version: str) -> str | None:
    """A warning for a version of another family; None for one that can't be read."""
    parts = version.split(".")
    if len(parts) < 2 or not all(p.isascii() and p.isdigit() for p in parts[:2]) or (int(parts[0]), int(parts[1])) == TESTED_VERSION:
        return None
    family = ".".join(map(str, TESTED_VERSION))
    return f"warning: session version {version} differs from the tested {family}.x family; parsing best-effort"


def parse_line(number: int, line: str) -> Iterator[tuple[int, str, str, str | None, bool]]:
    """Events of a transcript's line: (seq, what, source, value, plain); what: action, skip, type, evidence or warning.

    Never fails on content: each object that yields no action gives a skip with
    its reason.  What counts once a transcript is told for each line; a warning
    is null for a version without one.
    """
    line = line.strip()
    if not line:
        return
    at = number * PER_LINE
    try:
        obj = json.loads(line)
    except ValueError:
        yield at, "skip", f"line {number}", "json parse error", False
        return
    fields = obj if isinstance(obj, dict) else {}
    for key in ("version", "gitBranch", "cwd"):
        if isinstance(fields.get(key), str):
            yield at, "evidence", key, fields[key], False
            if key == "version":
                yield at, "warning", f"line {number}", version_warning(fields[key]), False
    kind = fields.get("type")
    if not isinstance(kind, str):
        yield at, "skip", f"line {number}", "missing type discriminator", False
        return
    yield at, "type", kind, kind, False
    if kind in ("assistant", "user", "tool_result"):
        found = line_actions(fields, kind)
        for i, (source, value, fold) in enumerate(found):
            yield at + i, "action", source, value, not fold
        if not found:
            reason = "assistant object, no tool_use blocks" if kind == "assistant" else f"'{kind}' carries no observable action"
            yield at, "skip", f"line {number}", reason, False
    elif kind in INERT_TYPES:
        yield at, "skip", f"line {number}", f"'{kind}' carries no observable action", False
    else:
        yield at, "skip", f"line {number}", f"unknown type: '{kind}' (skipped)", False
