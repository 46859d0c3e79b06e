"""Column builders for text: signal patterns, contexts, globs, roles and normalisation."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.plans.pack import Rule, Step

#: Case-insensitive with Unicode folding and classes.
FLAGS = "(?iuU)"
# Other characters that fold to ASCII letters.
ODD_FOLDS = "[ſK]"
# Invisible code points that are taken out, and look-alikes that are folded.
INVISIBLE = "​‌‍﻿­"
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "Х": "X",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
}
# Field names that play a role in a call's input, and in a rendered call.
INPUT_ROLES = {
    "recipient": ["recipient", "to", "dest", "destination", "account", "payee", "email"],
    "amount": ["amount", "value", "sum", "total"],
    "url": ["url", "endpoint", "link", "host"],
    "command": ["command", "cmd", "query", "sql", "script"],
}
CALL_ROLES = INPUT_ROLES | {
    "url": ["url", "endpoint", "link", "host", "href", "uri"],
    "command": ["command", "cmd", "shell", "exec", "run", "query", "sql", "script"],
}
#: Shorter values are too common to tell where they came from.
MIN_ROLE_VALUE = 6


def signal_pattern(signal: str) -> str:
    """A signal as a literal, with a word boundary at each edge that is a letter, digit or underscore."""
    quoted = re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", signal)
    head = r"\b" if re.match(r"[A-Za-z0-9_]", signal) else ""
    tail = r"\b" if re.search(r"[A-Za-z0-9_]\Z", signal) else ""
    return f"{FLAGS}{head}{quoted}{tail}"


def sql_text(s: str) -> str:
    """A string as SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_table(value: object, schema: str) -> str:
    """A constant of nested lists and objects as SQL; the optimiser reads it once."""
    return f"from_json({sql_text(json.dumps(value))}, {sql_text(schema)})"


#: The text that signals are looked up in: lower case, with all characters that fold to ASCII letters.
LOW = "lower(translate(value, 'ſ\u212a', 'sk'))"
_ENTRY = "struct<g:int,o:int,signal:string,low:string,pattern:string>"


def first_signals(groups: tuple[tuple[str, ...], ...]) -> str:
    """SQL for an array of (``g``: number of a group of signals, ``signal``: its first one that ``value`` holds), by group.

    A signal is entered under its first word.  The words of ``low`` (``LOW`` as a column; runs
    of ASCII letters, digits and underscores) are looked up in a set, those found there in a table by their
    checksum, so a text costs in proportion to its words, however many signals there are; only signals found there are searched for, and these tried as
    patterns.  As a pattern ends at word boundaries where the signal starts or ends in a word, its first word is a
    whole word of any text it fits.  Signals without an ASCII word are searched for in every text.
    """
    words: dict[str, list[dict]] = {}
    loose = []
    for g, signals in enumerate(groups):
        for o, signal in enumerate(signals):
            low = signal.translate({0x17F: "s", 0x212A: "k"}).lower()
            entry = {"g": g, "o": o, "signal": signal, "low": low, "pattern": signal_pattern(signal)}
            word = re.search(r"[a-z0-9_]+", low) if signal.isascii() else None
            words.setdefault(word[0], []).append(entry) if word else loose.append(entry)
    size = 1 << max(4, (2 * len(words)).bit_length())
    table: list[list[dict]] = [[] for _ in range(size)]
    for word, entries in words.items():
        table[zlib.crc32(word.encode()) % size].extend(entries)
    known = ", ".join(map(sql_text, sorted(words)))
    near = f"array_distinct(filter(split(low, '[^a-z0-9_]+'), w -> w IN ({known})))" if words else "CAST(array() AS array<string>)"
    near = f"flatten(transform({near}, w -> get({sql_table(table, f'array<array<{_ENTRY}>>')}, CAST(crc32(CAST(w AS BINARY)) % {size} AS INT))))"
    if loose:
        near = f"concat({near}, {sql_table(loose, f'array<{_ENTRY}>')})"
    held = f"array_sort(filter({near}, x -> contains(low, x.low) AND rlike(value, x.pattern)))"
    # A transform over one item names it, so that it is evaluated once.
    return f"flatten(transform(array({held}), a -> transform(filter(a, (x, i) -> i = 0 OR a[i - 1].g != x.g), x -> named_struct('g', x.g, 'signal', x.signal))))"


def contained_signals(groups: tuple[tuple[str, ...], ...]) -> str:
    """As ``first_signals``, by plain search in ``low``, inside words as well."""
    made = []
    for g, signals in enumerate(groups):
        first = " ".join(f"WHEN contains(low, {sql_text(s.lower())}) THEN {sql_text(s)}" for s in signals)
        made.append(f"named_struct('g', {g}, 'signal', CASE {first} END)" if signals else "")
    return f"filter(array({', '.join(filter(None, made))}), h -> h.signal IS NOT NULL)"


def _any(tests: list[str]) -> str:
    return f"({' OR '.join(tests)})" if tests else "false"


def kind_ok(kinds: tuple[str, ...]) -> str:
    """SQL for the prefix test of ``source``; no prefixes allow any."""
    return _any([f"startswith(source, {sql_text(k)})" for k in kinds]) if kinds else "true"


def _joinable(fragment: str) -> bool:
    """Whether a pattern means the same as a branch of another: no groups that are named, flagged or referred to, no quoting, no classes that engines read differently, and whole in itself."""
    if re.search(r"\(\?|\\[0-9kQE]|\[[^\]]*\[|\[\^?\]", fragment):
        return False
    try:
        re.compile(fragment)
    except re.error:
        return False
    return True


def holds_context(fragments: tuple[str, ...]) -> str:
    """SQL for whether any fragment is found anywhere in the whole ``value``.

    Fragments are branches of one pattern where they can be: a text is decoded once, and the code that
    Spark makes of a pack's tests stays below the 8,000 bytes of a method that the JVM compiles.
    """
    joined = "|".join(f for f in fragments if _joinable(f))
    patterns = ([joined] if any(map(_joinable, fragments)) else []) + [f for f in fragments if not _joinable(f)]
    return _any([f"rlike(value, {sql_text(FLAGS + f)})" for f in patterns])


def context_ok(step: Step) -> tuple[str, str]:
    """SQL for (fires, ambiguous) of a single action: a denied one still fires, as ambiguous, if a required context is there."""
    require = holds_context(step.require) if step.require else "true"
    if not step.deny:
        return require, "false"
    denied = holds_context(step.deny)
    return (require, denied) if step.require else (f"NOT {denied}", "false")


def step_ok(step: Step) -> str:
    """SQL for source kinds and contexts of one side of an ordered pair; here a denied context always stops it."""
    tests = [kind_ok(step.source_kinds)]
    if step.require:
        tests.append(holds_context(step.require))
    if step.deny:
        tests.append(f"NOT {holds_context(step.deny)}")
    return " AND ".join(tests)


def glob_regex(glob: str) -> str:
    """An anchored pattern for a glob that knows ``*`` only."""
    return "(?s)^" + ".*".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", part) for part in glob.split("*")) + "$"


def role_values(call: Column, roles: tuple[str, ...]) -> Column:
    """Lower-cased values of ``key=value`` or ``key:value`` tokens whose key plays one of the roles.

    A token is cut at its first ``=``; at its first ``:`` if it has no ``=`` or nothing follows that.
    """
    fields = sorted({f for r in roles for f in CALL_ROLES.get(r, [])})
    known = F.array(*(F.lit(f) for f in fields)) if fields else F.array().cast("array<string>")

    def cut(token: Column, sep: str) -> Column:
        at = F.instr(token, sep)
        key, val = F.lower(F.substring(token, F.lit(1), at - 1)), F.substring(token, at + 1, F.length(token))
        return F.when((at > 0) & (val != ""), F.struct(key.alias("k"), F.lower(val).alias("v")))

    pairs = F.transform(F.split(F.trim(call), r"(?U)\s+"), lambda t: F.coalesce(cut(t, "="), cut(t, ":")))
    good = F.filter(pairs, lambda p: p.isNotNull() & F.array_contains(known, p["k"]) & (F.char_length(p["v"]) >= MIN_ROLE_VALUE))
    return F.transform(good, lambda p: p["v"])


def llm_id(column: Column) -> Column:
    """``LLM01:2025`` -> ``OWASP-LLM:LLM01``; ids of other forms stay."""
    return F.when(column.startswith("LLM"), F.concat(F.lit("OWASP-LLM:"), F.split_part(column, F.lit(":"), F.lit(1)))).otherwise(column)


def plain_llm_id(text: str) -> str:
    """``llm_id`` for a string."""
    return "OWASP-LLM:" + text.split(":", 1)[0] if text.startswith("LLM") else text


#: Texts that are Python strings at a time.
_TEXTS = 64


def nfkc_array(values: pa.Array) -> pa.Array:
    """NFKC of texts, of which a few at a time are strings: beside the batch itself only the result is held."""
    parts = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.slice(i, _TEXTS).to_pylist()], pa.string()) for i in range(0, len(values), _TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return nfkc_array(values)


def normalize(value: Column) -> Column:
    """Invisible characters out, look-alikes folded, NFKC, white space collapsed and trimmed.

    NFKC leaves ASCII as it is, so only other texts go to Python.
    """
    folded = F.translate(value, "".join(LOOKALIKES) + INVISIBLE, "".join(LOOKALIKES.values()))
    composed = F.when(folded.rlike("[^\\x00-\\x7f]"), _nfkc(folded)).otherwise(folded)
    return F.regexp_replace(F.regexp_replace(composed, r"(?U)\s+", " "), "^ | $", "")


def rule_signal_label(rule: Rule) -> str:
    """Label of a shell rule's findings."""
    return rule.constructs[0] if rule.constructs else f"{rule.binary} {''.join(rule.flags)}"
