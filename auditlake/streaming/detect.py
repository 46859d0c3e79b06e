"""Detection over a stream of actions.

Single actions are stateless: the batch expressions run on the stream.  Pairs
keep a latch per scan: the first source of each rule, and whether the rule is
over.  Actions of a scan are taken in the order of ``seq`` within a micro-batch;
a batch that comes late counts in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.functions import text
from auditlake.operators import match
from auditlake.plans.pack import Rule, RulePack
from auditlake.plans.schema import PASSES


def stateless_rules(pack: RulePack, shell_ast: bool = False) -> list[Rule]:
    """Rules that look at one action: signals, programs with flags, and on demand shell constructs."""
    return [r for r in pack.rules if r.kind == "single" or (r.kind == "shell" and (shell_ast or not r.constructs))]


def stream_single(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Hits of signals in single actions, each (action, rule) once; nothing is kept between batches."""
    return match.single_hits(actions, pack)


def stream_stateless(actions: DataFrame, pack: RulePack, shell_ast: bool = False) -> DataFrame:
    """Hits of all rules that look at one action, argv and grammar included; nothing is kept between batches."""
    rules = stateless_rules(pack, shell_ast)
    return match.as_hits(match.tagged(actions, rules), rules)


def stream_first_per_signal(actions: DataFrame, pack: RulePack, time_col: str, delay: str = "1 hour", shell_ast: bool = False) -> DataFrame:
    """As ``stream_stateless``, with ``time_col``, but each (scan, code, signal) once within ``delay`` of its first hit.

    State goes when the watermark passes, so a signal that comes up again after that is told again.
    """
    rules = stateless_rules(pack, shell_ast)
    hits = match.as_hits(match.tagged(actions.withWatermark(time_col, delay), rules, (time_col,)), rules, (time_col,))
    return hits.dropDuplicatesWithinWatermark(["scan_id", "code", "signal"])


_OUT = "scan_id string, pass int, seq long, rule_ord int, code string, signal string, source string, ambiguity boolean"
_STATE = "rules array<int>, seqs array<long>, signals array<string>, texts array<string>, over array<int>"


def stream_pairs(actions: DataFrame, pack: RulePack, idle: str | None = None) -> DataFrame:
    """Hits of sequence and taint rules.  ``idle``: after so long without actions a scan's latch is dropped (processing time)."""
    rules = pack.of_kind("sequence") + pack.of_kind("taint")
    by_ord = {r.ord: r for r in rules}
    sides = match.tagged(actions, rules)
    held = F.lit(None).cast("array<string>")
    for r in rules:
        if r.roles:
            held = F.when(F.col("rule_ord") == r.ord, text.role_values(F.col("value"), r.roles)).otherwise(held)
    sides = sides.withColumn("held", F.when(F.col("role") == "sink", held)).withColumn("low", F.when(F.col("role") == "source", F.lower("value")))
    sides = sides.select("scan_id", "seq", "source", "rule_ord", "role", "signal", "held", "low")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latched: dict[int, tuple] = {}
        over: set[int] = set()
        if state.exists:
            r, q, s, t, o = state.get
            latched = {a: (b, c, d) for a, b, c, d in zip(r, q, s, t)}
            over = set(o)
        rows = pd.concat(list(frames)).sort_values(["seq", "rule_ord", "role"], kind="stable")  # a sink is looked at before the source of the same action
        out = []
        for row in rows.itertuples():
            n = int(row.rule_ord)
            if n in over:
                continue
            if row.role == "sink" and n in latched and row.seq > latched[n][0]:
                over.add(n)
                rule = by_ord[n]
                if not rule.roles or any(v in latched[n][2] for v in row.held):
                    arrow = " → " if rule.kind == "sequence" else " ⇒ "
                    out.append((key[0], PASSES[rule.kind], int(row.seq), n, rule.code, latched[n][1] + arrow + row.signal, row.source, False))
            elif row.role == "source" and n not in latched:
                latched[n] = (int(row.seq), row.signal, row.low)
        live = [n for n in latched if n not in over]
        state.update((live, [latched[n][0] for n in live], [latched[n][1] for n in live], [latched[n][2] for n in live], sorted(over)))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return sides.groupBy("scan_id").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)


def hook_payloads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Actions of hook payloads, a JSON text a row: ``tool_input.command`` of ``session_id``; others are left out."""
    parsed = F.from_json(F.col(column), "session_id string, tool_input struct<command: string>")
    rows = lines.withColumn("_p", parsed).filter(F.col("_p.tool_input.command").isNotNull())
    keep = [c for c in lines.columns if c != column]
    return rows.select(F.coalesce("_p.session_id", F.lit("action")).alias("scan_id"), F.lit(0).cast("long").alias("seq"), F.lit("session:Bash.input").alias("source"), F.col("_p.tool_input.command").alias("value"), *keep)
