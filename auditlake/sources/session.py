"""Session transcripts: newline-delimited JSON, one file a scan.

A line is a VARIANT, and its actions come from expressions over it; a line that
isn't one JSON value, or is larger than a VARIANT can be (16 MiB), is skipped with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.text import INPUT_ROLES, normalize
from auditlake.functions.variant import allow_repeated_keys, parsed_line, part, parts, string

# Object types without actions, tools whose input is one field, and the tested version.
INERT_TYPES = ("system", "attachment", "queue-operation", "permission-mode", "mode", "ai-title", "agent-name", "last-prompt", "file-history-snapshot")
INPUT_FIELD = {"Bash": "command", "Read": "file_path", "Write": "file_path", "Edit": "file_path", "MultiEdit": "file_path", "NotebookEdit": "file_path"}
TESTED_VERSION = (2, 1)
#: Actions of one line have numbers below this; a VARIANT can't hold as many.
PER_LINE = 1 << 20

_EVENT = "struct<seq:bigint,what:string,source:string,value:string,plain:boolean>"


def _fields(tool_input: Column) -> Column:
    """Top-level texts of a tool's input by name: array of (k, v); null if it is no object."""
    names = F.try_variant_get(tool_input, "$", "map<string,variant>")
    texts = F.transform(F.array_sort(F.map_keys(names)), lambda k: F.struct(k.alias("k"), string(F.element_at(names, k)).alias("v")))
    return F.filter(texts, lambda f: f["v"].isNotNull())


def relevant_input(name: Column, fields: Column) -> Column:
    """The text of a tool's input that is matched; for unknown tools all top-level texts."""
    known = F.create_map(*(F.lit(x) for kv in INPUT_FIELD.items() for x in kv))
    one = F.get(F.filter(fields, lambda f: f["k"] == known[name]), F.lit(0))["v"]
    every = F.when(F.size(fields) > 0, F.array_join(F.transform(fields, lambda f: f["v"]), " "))
    return F.when(known[name].isNotNull(), one).otherwise(every)


def rendered_call(name: Column, fields: Column) -> Column:
    """``tool-call:NAME`` with the first text of each role, in the order of roles; null without any.  Fields go by name."""
    texts = []
    for role, names in INPUT_ROLES.items():
        first = F.get(F.filter(fields, lambda f: F.lower(f["k"]).isin(names)), F.lit(0))["v"]  # noqa: B023
        texts.append(F.concat(F.lit(f" {role}="), first))
    return F.when(F.coalesce(*texts).isNotNull(), F.concat(F.lit("tool-call:"), name, *(F.coalesce(t, F.lit("")) for t in texts)))


def _action(source: Column, value: Column, plain: bool) -> Column:
    return F.struct(source.alias("source"), value.alias("value"), F.lit(plain).alias("plain"))


def input_actions(name: Column, tool_input: Column) -> Column:
    """Actions of one tool call, at most two: its input, and the rendered call."""
    none = F.array().cast("array<struct<source:string,value:string,plain:boolean>>")

    def make(c: Column) -> Column:
        value, call = relevant_input(c["name"], c["fields"]), rendered_call(c["name"], c["fields"])
        both = F.array_compact(F.array(_action(F.concat(F.lit("session:"), c["name"], F.lit(".input")), value, False), F.when(call.isNotNull(), _action(F.concat(F.lit("sink:"), c["name"]), call, True))))
        return F.when(value.isNotNull(), both).otherwise(none)

    # A lambda's variable is evaluated once.
    return F.flatten(F.transform(F.array(F.struct(name.alias("name"), _fields(tool_input).alias("fields"))), make))


def _result_actions(blocks: Column) -> Column:
    def text(b: Column) -> Column:
        content = part(b, "$.content")
        listed = F.filter(F.transform(parts(content, "$"), lambda x: string(part(x, "$.text"))), lambda t: t.isNotNull())
        plain = string(content)
        return F.coalesce(F.when(plain != "", plain), F.when(F.size(listed) > 0, F.array_join(listed, " ")))

    found = F.transform(blocks, lambda b: F.struct(string(part(b, "$.tool_use_id")).alias("id"), text(b).alias("text")))
    return F.transform(F.filter(found, lambda x: x["text"].isNotNull()), lambda x, i: _action(F.concat(F.lit("tool-result:"), F.coalesce(x["id"], i.cast("string"))), x["text"], True))


def version_warning(version: Column) -> Column:
    """A warning for a version of another family; null for one that can't be read."""
    family = ".".join(map(str, TESTED_VERSION))
    own = r"^0*{}\.0*{}(?:\.|\z)".format(*TESTED_VERSION)
    other = version.rlike(r"^[0-9]+\.[0-9]+(?:\.|\z)") & ~version.rlike(own)
    return F.when(other, F.concat(F.lit("warning: session version "), version, F.lit(f" differs from the tested {family}.x family; parsing best-effort")))


def line_events(lines: DataFrame) -> DataFrame:
    """Events of transcripts given by line (``scan_id, number, line``, numbers from 1, in any order and place).

    Returns ``scan_id, seq, what, source, value, plain``; what: action, skip,
    type, evidence or warning.  Never fails on content: each object that yields
    no action gives a skip with its reason.  What counts once a transcript is
    told for each line; a warning is null for a version without one.
    """
    allow_repeated_keys(lines.sparkSession)
    rows = lines.select("scan_id", F.col("number").cast("long").alias("number"), parsed_line(F.col("line")).alias("v"), F.concat(F.lit("line "), F.col("number").cast("string")).alias("place"), F.col("line"))
    rows = rows.filter(~F.coalesce(rows["line"], F.lit("")).rlike(r"(?U)^\s*$")).drop("line")
    at = F.col("number") * F.lit(PER_LINE)
    rows = rows.withColumns({"at": at, "kind": string(part(F.col("v"), "$.type")), **{k: string(part(F.col("v"), f"$.{k}")) for k in ("version", "gitBranch", "cwd")}})
    content = parts(F.col("v"), "$.message.content")

    def of_type(kind: str) -> Column:
        return F.coalesce(F.filter(content, lambda b: string(part(b, "$.type")) == kind), F.array().cast("array<variant>"))

    calls = F.flatten(F.transform(of_type("tool_use"), lambda b: F.when(string(part(b, "$.name")).isNotNull(), input_actions(string(part(b, "$.name")), part(b, "$.input"))).otherwise(F.array().cast("array<struct<source:string,value:string,plain:boolean>>"))))
    results = _result_actions(F.when(F.col("kind") == "tool_result", F.array("v")).otherwise(of_type("tool_result")))
    acting = F.col("kind").isin("assistant", "user", "tool_result")
    rows = rows.withColumn("actions", F.when(F.col("kind") == "assistant", calls).when(acting, results))

    def event(what: str, source: Column, value: Column, at: Column = F.col("at"), plain: Column = F.lit(False)) -> Column:
        return F.struct(at.alias("seq"), F.lit(what).alias("what"), source.alias("source"), value.alias("value"), plain.alias("plain"))

    kind, place = F.col("kind"), F.col("place")
    none = F.array().cast(f"array<{_EVENT}>")
    evidence = [F.when(F.col(k).isNotNull(), event("evidence", F.lit(k), F.col(k))) for k in ("version", "gitBranch", "cwd")]
    evidence.insert(1, F.when(F.col("version").isNotNull(), event("warning", place, version_warning(F.col("version")))))
    no_action = F.concat(F.lit("'"), kind, F.lit("' carries no observable action"))
    reason = (
        F.when(F.col("v").isNull(), "json parse error").when(kind.isNull(), "missing type discriminator").when(kind == "assistant", "assistant object, no tool_use blocks")
        .when(acting | kind.isin(*INERT_TYPES), no_action).otherwise(F.concat(F.lit("unknown type: '"), kind, F.lit("' (skipped)")))
    )
    acted = F.coalesce(F.size("actions"), F.lit(0)) > 0
    told = F.when(acted, F.transform("actions", lambda a, i: event("action", a["source"], a["value"], F.col("at") + i, a["plain"]))).otherwise(F.array(event("skip", place, reason)))
    typed = F.when(kind.isNotNull(), F.array(event("type", kind, kind))).otherwise(none)
    events = F.concat(F.array_compact(F.array(*evidence)), typed, told)
    # No list is empty; outer, as a plain explode makes the optimiser evaluate its expression once more, to see whether one is.
    return rows.select("scan_id", F.explode_outer(events).alias("e")).select("scan_id", "e.*")


def session_events(texts: DataFrame) -> DataFrame:
    """Events of whole transcripts, given as ``scan_id, text``; each must fit a value."""
    lines = texts.select("scan_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return line_events(lines.select("scan_id", (F.col("at") + 1).alias("number"), "line"))


class Session:
    """What transcripts hold: ``actions``, ``skips``, ``types`` and ``evidence``, all lazy."""

    def __init__(self, events: DataFrame):
        value = F.when(F.col("plain"), F.col("value")).otherwise(normalize(F.col("value")))
        self.actions = events.filter("what = 'action'").select("scan_id", "seq", "source", value.alias("value"))
        skips = events.filter("what = 'skip'").select("scan_id", "seq", F.col("source").alias("place"), F.col("value").alias("reason"))
        # Only the first version of a transcript is warned about.
        first = events.filter("what = 'warning'").groupBy("scan_id").agg(F.min("seq").alias("seq"), F.min_by(F.struct("source", "value"), "seq").alias("w"))
        self.skips = skips.union(first.filter("w.value IS NOT NULL").select("scan_id", "seq", "w.source", "w.value"))
        self.types = events.filter("what = 'type'").groupBy("scan_id").agg(F.array_sort(F.collect_set("value")).alias("observed_types"))
        self.evidence = events.filter("what = 'evidence'").groupBy("scan_id").agg(*(F.min_by(F.when(F.col("source") == k, F.col("value")), F.when(F.col("source") == k, F.col("seq"))).alias(n) for k, n in (("version", "version"), ("gitBranch", "git_branch"), ("cwd", "cwd"))))


def read_sessions(spark: SparkSession, path: str | list[str]) -> Session:
    """Transcripts of a path, glob or folder; ``scan_id`` is the file's path."""
    # A split of a file is read in one go, so ids ascend by one within it, and few rows tell where splits start.
    found = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("scan_id"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("id"))
    splits = found.groupBy("scan_id", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scan_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = found.join(splits.withColumn("before", before), ["scan_id", "split"])
    return Session(line_events(lines.select("scan_id", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "line")))


def transcript_from_messages(messages: DataFrame, scan_col: str = "scan_id", seq_col: str = "seq") -> DataFrame:
    """Actions of benchmark traces: ``scan_id, seq, role, content, tool, args`` (JSON text), a row per message or call.

    Tool messages become tool results, calls become tool inputs and their rendered calls.
    """
    allow_repeated_keys(messages.sparkSession)
    rows = messages.select(F.col(scan_col).cast("string").alias("scan_id"), F.col(seq_col).cast("long").alias("seq"), "role", "content", "tool", F.coalesce(parsed_line(F.col("args")), F.parse_json(F.lit("{}"))).alias("args"))
    result = F.when((F.col("role") == "tool") & (F.col("content") != ""), F.array(_action(F.concat(F.lit("tool-result:"), F.col("seq").cast("string")), F.col("content"), True)))
    call = F.when((F.col("role") == "assistant") & (F.col("tool") != ""), input_actions(F.col("tool"), F.col("args")))
    acts = rows.select("scan_id", "seq", F.posexplode(F.coalesce(result, call)).alias("i", "a"))
    return acts.select("scan_id", (2 * F.col("seq") + F.col("i")).alias("seq"), "a.source", "a.value")


def traces_from_messages(traces: DataFrame, scan_col: str = "scan_id", messages_col: str = "messages") -> DataFrame:
    """Actions of benchmark traces that hold their messages as an array.

    ``messages``: array of ``role, content, tool_calls: array<struct<function, args (JSON text)>>``.  A message with calls
    takes a place per call.
    """
    each = traces.select(F.col(scan_col).alias("scan_id"), F.posexplode(messages_col).alias("place", "m"))
    calls = F.when(F.size("m.tool_calls") > 0, F.transform("m.tool_calls", lambda c: F.struct(c["function"].alias("tool"), c["args"].alias("args"))))
    each = each.select("scan_id", "place", "m.role", "m.content", F.posexplode_outer(calls).alias("n", "c"))
    return transcript_from_messages(each.select("scan_id", (F.col("place") * F.lit(1 << 20) + F.coalesce("n", F.lit(0))).alias("seq"), "role", "content", "c.tool", "c.args"))
