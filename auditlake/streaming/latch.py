"""Stateful detection in event time: what a batch over the whole input gives, whatever the order of arrival.

Rows wait in state until the watermark has passed them, so that no earlier one can come any more, and are then taken in the
order of ``seq``.  Positions of a scan must not run against its event time.  All state is keyed
(by scan, or by scan, code and signal), kept per rule, and goes when a scan has been
quiet for ``idle`` of event time.  The session needs RocksDB as its state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.functions import text
from auditlake.operators import match
from auditlake.plans.pack import Rule, RulePack
from auditlake.plans.schema import PASSES
from auditlake.streaming.detect import stateless_rules

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "scan_id string, pass int, seq long, rule_ord int, code string, signal string, source string, ambiguity boolean, ts timestamp"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_PENDING = "seq long, source string, rule_ord int, role string, signal string, held array<string>, low string, at long"


def _checked(actions: DataFrame) -> None:
    provider = actions.sparkSession.conf.get(_PROVIDER, "")
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {_PROVIDER} to org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=_COLUMNS)
    made["ts"] = pd.to_datetime(made["ts"])
    return made


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class PairLatch(StatefulProcessor):
    """A latch per rule of a scan: the first source, and whether the rule is over."""

    def __init__(self, rules: list[Rule], idle_ms: int):
        self.rules, self.idle_ms = {r.ord: r for r in rules}, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.latch = handle.getMapState("latch", "rule_ord int", "seq long, signal string, low string, over boolean")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            some = [(int(r.seq), r.source, int(r.rule_ord), r.role, r.signal, None if r.held is None else list(r.held), r.low, int(r.at)) for r in frame.itertuples()]
            if some:
                self.pending.appendList(some)
                last = max(last, max(r[-1] for r in some))
        self.last.update((last,))
        self.handle.registerTimer(last)
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.pending.get()) if self.pending.exists() else []
        ready, later = [r for r in waiting if r[-1] <= now], [r for r in waiting if r[-1] > now]
        out = []
        for seq, source, n, role, signal, held, low, at in sorted(ready, key=lambda r: (r[0], r[2], r[3])):  # a sink is looked at before the source of the same action
            latched = self.latch.getValue((n,)) if self.latch.containsKey((n,)) else None
            if latched is None:
                if role == "source":
                    self.latch.updateValue((n,), (seq, signal, low, False))
            elif not latched[3] and role == "sink" and seq > latched[0]:
                rule = self.rules[n]
                self.latch.updateValue((n,), (latched[0], None, None, True))  # its texts are needed no more
                if not rule.roles or any(v in latched[2] for v in held or []):
                    out.append((key[0], PASSES[rule.kind], seq, n, rule.code, latched[1] + (" → " if rule.kind == "sequence" else " ⇒ ") + signal, source, False, _time(at)))
        if later:
            self.pending.put(later)
        elif waiting:
            self.pending.clear()
        last = self.last.get()[0] if self.last.exists() else 0
        if not later and self.idle_ms:
            if last + self.idle_ms <= now:
                self.latch.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(last + self.idle_ms)
        yield _frame(out)

    def close(self) -> None:
        pass


class FirstSignal(StatefulProcessor):
    """The hit of the lowest ``seq`` of a (scan, code, signal), told once the watermark has passed the first one seen."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "seq long, rule_ord int, pass int, source string, ambiguity boolean, at long, last long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.best.get()) if self.best.exists() else None
        for frame in rows:
            for r in frame.itertuples():
                one = (int(r.seq), int(r.rule_ord), int(r.hit_pass), r.source, bool(r.ambiguity), int(r.at))
                if best is None:
                    best = (*one, one[5], False)
                    self.handle.registerTimer(one[5])
                elif not best[7] and one[:2] < best[:2]:
                    best = (*one, max(best[6], one[5]), False)
                else:
                    best = (*best[:6], max(best[6], one[5]), best[7])
        if best is not None:
            self.best.update(best)
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        if self.best.exists():
            seq, n, number, source, ambiguity, at, last, told = self.best.get()
            if not told:
                out.append((key[0], number, seq, n, key[1], key[2], source, ambiguity, _time(at)))
                self.best.update((seq, n, number, None, ambiguity, at, last, True))
            if self.idle_ms and last + self.idle_ms <= now:
                self.best.clear()
            elif self.idle_ms:
                self.handle.registerTimer(last + self.idle_ms)
        yield _frame(out)

    def close(self) -> None:
        pass


def _ms(span: str | None) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000) if span else 0


def stream_pairs_in_order(actions: DataFrame, pack: RulePack, time_col: str, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """Hits of sequence and taint rules as ``match.sequence_hits`` and ``match.taint_hits`` give them, with ``ts``.

    An action may come ``delay`` late; a pair is told when the watermark has passed its sink.
    """
    _checked(actions)
    rules = pack.of_kind("sequence") + pack.of_kind("taint")
    sides = match.tagged(actions.withWatermark(time_col, delay), rules, (time_col,))
    held = F.lit(None).cast("array<string>")
    for r in rules:
        if r.roles:
            held = F.when(F.col("rule_ord") == r.ord, text.role_values(F.col("value"), r.roles)).otherwise(held)
    sides = sides.select("scan_id", "seq", "source", "rule_ord", "role", "signal", F.when(F.col("role") == "sink", held).alias("held"), F.when(F.col("role") == "source", F.lower("value")).alias("low"), F.unix_millis(time_col).alias("at"), time_col)
    return sides.groupBy("scan_id").transformWithStateInPandas(PairLatch(rules, _ms(idle)), _OUT, "append", "EventTime")


def stream_first_by_position(actions: DataFrame, pack: RulePack, time_col: str, delay: str = "1 hour", idle: str | None = None, shell_ast: bool = False) -> DataFrame:
    """Hits of rules that look at one action, each (scan, code, signal) once, by the lowest ``seq``, with ``ts``.

    A hit is told when the watermark has passed it; after ``idle`` without another the signal is forgotten.
    """
    _checked(actions)
    rules = stateless_rules(pack, shell_ast)
    hits = match.as_hits(match.tagged(actions.withWatermark(time_col, delay), rules, (time_col,)), rules, (time_col,))
    hits = hits.withColumnRenamed("pass", "hit_pass").withColumn("at", F.unix_millis(time_col))
    return hits.groupBy("scan_id", "code", "signal").transformWithStateInPandas(FirstSignal(_ms(idle)), _OUT, "append", "EventTime")
