"""Telemetry exports parsed by plain Python: what the Spark plan is compared with."""

from __future__ import annotations

import json
from collections.abc import Iterator

from auditlake.sources.otlp import PER_LINE, TOOL_KEYS


def any_value(v: object) -> str | None:
    """Text of a typed value: text, whole number, number, truth value, and lists of these joined by blanks."""
    if isinstance(v, str):
        return v
    if not isinstance(v, dict):
        return None
    if isinstance(v.get("stringValue"), str):
        return v["stringValue"]
    whole = v.get("intValue")
    if isinstance(whole, str):
        return whole
    if isinstance(whole, int) and not isinstance(whole, bool):
        return str(whole)
    number = v.get("doubleValue")
    if isinstance(number, (int, float)) and not isinstance(number, bool):
        return str(int(number)) if float(number).is_integer() and abs(number) < 1e16 else repr(float(number))
    if isinstance(v.get("boolValue"), bool):
        return "true" if v["boolValue"] else "false"
    for key in ("arrayValue", "kvlistValue"):
        inner = v.get(key)
        values = inner.get("values") if isinstance(inner, dict) else None
        if isinstance(values, list):
            items = values if key == "arrayValue" else [x.get("value") for x in values if isinstance(x, dict)]
            texts = [t for t in map(any_value, items) if t is not None]
            if texts:
                return " ".join(texts)
    return None


def _rows(obj: object, *keys: str) -> Iterator[dict]:
    """Objects of nested lists."""
    found = obj.get(keys[0]) if isinstance(obj, dict) else None
    for x in found if isinstance(found, list) else []:
        if len(keys) > 1:
            yield from _rows(x, *keys[1:])
        elif isinstance(x, dict):
            yield x


def record_action(record: dict, is_span: bool) -> tuple[str, str] | None:
    """(source, value) of a log record or a span; None if it holds no text."""
    attributes = [(x["key"], t) for x in _rows(record, "attributes") if isinstance(x.get("key"), str) and (t := any_value(x.get("value"))) is not None]
    by_key: dict[str, str] = {}
    for k, t in attributes:
        by_key.setdefault(k, t)
    name = record.get("name") if isinstance(record.get("name"), str) else None
    tool = next((by_key[k] for k in TOOL_KEYS if by_key.get(k, "").strip()), name if is_span else None)
    head = name if is_span else any_value(record.get("body"))
    value = " ".join(t for t in ([head] if head is not None else []) + [t for _, t in attributes] if t.strip())
    if not value.strip():
        return None
    if tool and tool.strip():
        return f"session:{tool.split()[-1]}.input", value
    return ("otlp:span" if is_span else "otlp:log"), value


def parse_otlp(text: str) -> Iterator[tuple[int, str, str, str]]:
    """Events (position, what, source, value) of one file: a document, or else one per line."""
    text = text.strip("﻿")
    if not text.strip():
        return
    n = 0
    try:
        documents: list[tuple[int, object]] = [(0, json.loads(text))]
    except ValueError:
        documents = []
        for number, line in enumerate(text.split("\n"), 1):
            if line.strip():
                try:
                    documents.append((number, json.loads(line)))
                except ValueError:
                    yield number * PER_LINE, "skip", f"line {number}", "json parse error"
    for number, doc in documents:
        known, n = False, number * PER_LINE
        for kind, keys in (("log", ("resourceLogs", "scopeLogs", "logRecords")), ("span", ("resourceSpans", "scopeSpans", "spans"))):
            known |= isinstance(doc, dict) and isinstance(doc.get(keys[0]), list)
            for record in _rows(doc, *keys):
                action = record_action(record, kind == "span")
                yield (n, "action", *action) if action else (n, "skip", f"otlp:{kind}", "record carried no observable string")
                n += 1
        if not known:
            yield n, "skip", "document", "neither resourceLogs nor resourceSpans"
            n += 1
