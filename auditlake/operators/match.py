"""The five matching passes: actions and a rule pack make hits.

One projection reads the actions: the words of each row are looked up in a table
of all rules' signals, contexts, kinds, argv and shell grammar are tried for hits only, and no
rule table is joined.  The expressions of a list of rules are SQL texts, written once.  Only hits are ever shuffled, first by stretches of ``seq`` within a
scan and rule, so that a scan with a third of all hits spreads over tasks, then
what each stretch leaves by scan and rule.  So a detection run is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import shell, text
from auditlake.plans.pack import Rule, RulePack, Step
from auditlake.plans.schema import PASSES

_HIT = ["scan_id", "pass", "seq", "rule_ord", "code", "signal", "source", "ambiguity"]
#: Positions of a scan that are reduced together at first.
STRETCH = 4096
#: Groups of actions for the shell passes, beside the numbers of signal groups.
_ARGV, _GRAMMAR = -1, -2
_ARROW = {"sequence": " → ", "taint": " ⇒ "}


def _no_hits(actions: DataFrame) -> DataFrame:
    return actions.filter(F.lit(False)).select("scan_id", F.lit(0).alias("pass"), "seq", F.lit(0).alias("rule_ord"), F.lit("").alias("code"), F.lit("").alias("signal"), "source", F.lit(False).alias("ambiguity"))


def _per_rule(rules: list[Rule], kind: str, make) -> Column:
    """A constant by ``rule_ord``."""
    values = [None] * (max((r.ord for r in rules), default=0) + 1)
    for r in rules:
        values[r.ord] = make(r)
    return F.expr(f"get({text.sql_table(values, f'array<{kind}>')}, rule_ord)")


def _argv_test(r: Rule) -> str:
    tests = [f"_argv.program = {text.sql_text(r.binary)}"]
    tests += [f"array_contains(_argv.flags, {text.sql_text(f)})" for f in r.flags]
    tests += [text.holds_context(r.main.require)] if r.main.require else []
    tests += [f"NOT {text.holds_context(r.main.deny)}"] if r.main.deny else []
    return " AND ".join(tests)


@dataclass(frozen=True)
class _Plan:
    """SQL of a list of rules, written once."""

    hits: str
    fires: str
    unsure: str
    parts: str
    argv: bool
    grammar: bool


_PART = "struct<rule_ord:int,role:string,signal:string>"


@lru_cache(maxsize=64)
def _plan(rules: tuple[Rule, ...]) -> _Plan:
    singles = [r for r in rules if r.kind == "single"]
    pairs = [r for r in rules if r.kind in _ARROW]
    argv = [r for r in rules if r.kind == "shell" and not r.constructs]
    grammar = [r for r in rules if r.kind == "shell" and r.constructs]
    steps: dict[Step, int] = {}
    for r in pairs:
        for s in (r.source, r.sink):
            steps.setdefault(s, len(singles) + len(steps))
    hits = text.first_signals((*(r.main.signals for r in singles), *(s.signals for s in steps)))
    bash = "startswith(source, 'session:Bash')"
    extra = []
    if argv:
        near = " OR ".join([*(f"contains(value, {text.sql_text(b)})" for b in sorted({r.binary for r in argv})), *(f"contains(value, {text.sql_text(c)})" for c in "\\'\"")])
        extra.append((_ARGV, f"{bash} AND ({near})"))
    if grammar:
        # Every construct but Simple and Redirection has one of these characters, and the latter has < or >.
        wanted = {shell.ALIASES.get(c, c) for r in grammar for c in r.constructs}
        extra.append((_GRAMMAR, bash if "Simple" in wanted else f"{bash} AND rlike(value, '[|(`<>]')"))
    for g, test in extra:
        hits = f"concat({hits}, if({test}, array(named_struct('g', {g}, 'signal', '')), array()))"
    # Kinds and contexts of the groups that have any; other single actions need only be no rendered calls.
    fires, unsure = [], []
    for g, r in enumerate(singles):
        ok, ambiguous = text.context_ok(r.main)
        if ok != "true" or r.main.source_kinds:
            fires.append(f"WHEN {g} THEN NOT startswith(source, 'sink:') AND {text.kind_ok(r.main.source_kinds)} AND {ok}")
        if ambiguous != "false":
            unsure.append(f"WHEN {g} THEN {ambiguous}")
    fires += [f"WHEN {g} THEN {ok}" for s, g in steps.items() if (ok := text.step_ok(s)) != "true"]
    default = f"h.g < 0 OR h.g >= {len(singles)} OR NOT startswith(source, 'sink:')"
    plays = [[{"rule_ord": r.ord, "role": "single"}] for r in singles]
    plays += [[{"rule_ord": r.ord, "role": role} for r in pairs for role, x in (("source", r.source), ("sink", r.sink)) if x == s] for s in steps]
    parts = [f"WHEN h.g >= 0 THEN transform(get({text.sql_table(plays, 'array<array<struct<rule_ord:int,role:string>>>')}, h.g), p -> named_struct('rule_ord', p.rule_ord, 'role', p.role, 'signal', h.signal))"]
    tests = [(_ARGV, r, _argv_test(r)) for r in argv]
    for r in grammar:
        names = ", ".join(text.sql_text(shell.ALIASES.get(c, c)) for c in r.constructs)
        tests.append((_GRAMMAR, r, f"arrays_overlap(_has, array({names}))"))
    for g in (_ARGV, _GRAMMAR):
        made = [f"if({t}, named_struct('rule_ord', {r.ord}, 'role', 'shell', 'signal', {text.sql_text(text.rule_signal_label(r))}), NULL)" for k, r, t in tests if k == g]
        if made:
            parts.append(f"WHEN h.g = {g} THEN array_compact(array({', '.join(made)}))")
    return _Plan(
        hits,
        f"CASE h.g {' '.join(fires)} ELSE {default} END" if fires else default,
        f"CASE h.g {' '.join(unsure)} ELSE false END" if unsure else "false",
        f"explode(CAST(CASE {' '.join(parts)} END AS array<{_PART}>))",
        bool(argv),
        bool(grammar),
    )


def tagged(actions: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """Every part of a rule that an action plays: ``scan_id, seq, source, value, rule_ord, role, signal, ambiguity`` and the columns to ``carry``.

    Roles: ``single`` (with the rule's first signal that the action holds; rendered calls,
    ``sink:``, are no single actions), ``source`` and ``sink`` of an ordered pair, ``shell``.  Stateless: it
    runs on streams as well.  Rules that share a side share its test.
    """
    plan = _plan(tuple(rules))
    columns = ["scan_id", "seq", "source", "value", *carry]
    # Outer, as a plain explode makes the optimiser test the whole expression once more for being empty; rows without hits fail the filter.
    found = actions.select(*columns, F.expr(text.LOW).alias("low")).select(*columns, F.expr(f"explode_outer({plan.hits})").alias("h"))
    # From here on there are hits only: kinds, contexts, argv and grammar.
    found = found.filter(F.expr(plan.fires)).withColumn("ambiguity", F.expr(plan.unsure))
    if plan.argv:
        found = found.withColumn("_argv", shell.argv_udf(F.expr(f"if(h.g = {_ARGV}, value, NULL)")))
    if plan.grammar:
        found = found.withColumn("_has", shell.constructs_udf(F.expr(f"if(h.g = {_GRAMMAR}, value, NULL)")))
    found = found.select("scan_id", "seq", "source", "value", "ambiguity", *carry, F.expr(plan.parts).alias("p"))
    return found.select("scan_id", "seq", "source", "value", "p.rule_ord", "p.role", "p.signal", "ambiguity", *carry)


def single_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Every (action, rule) that fires, with the first signal of the rule that the action holds."""
    rules = pack.of_kind("single")
    return as_hits(tagged(actions, rules), rules) if rules else _no_hits(actions)


def as_hits(rows: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """``_HIT`` columns of rows that have all but pass and code."""
    number = _per_rule(rules, "int", lambda r: PASSES["shell_ast" if r.constructs else r.kind])
    return rows.select("scan_id", number.alias("pass"), "seq", "rule_ord", _per_rule(rules, "string", lambda r: r.code).alias("code"), "signal", "source", "ambiguity", *carry)


def first_per_signal(hits: DataFrame) -> DataFrame:
    """Of each (code, signal) of a scan the hit of the lowest ``seq``; allowlists are asked after this."""
    first = F.min_by(F.struct(*(c for c in _HIT if c not in ("scan_id", "code", "signal"))), F.struct("seq", "rule_ord")).alias("h")
    return hits.groupBy("scan_id", "code", "signal").agg(first).select("scan_id", "h.pass", "h.seq", "h.rule_ord", "code", "signal", "h.source", "h.ambiguity")


def reduced(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """What the parts of ``tagged`` come to, by scan and rule.

    Returns ``scan_id, rule_ord, seq, signal, source, value, ambiguity``: for
    single actions the first of each (code, signal), for shell rules the first, for ordered
    pairs the first sink after the first source, with that source as ``src_seq, src_signal, src_value``.
    Values are kept for rules that compare them only.
    """
    shared = ["scan_id", "unit", "label"]
    code = _per_rule(rules, "string", lambda r: r.code)
    single = F.col("role") == "single"
    kept = F.when(F.col("rule_ord").isin([r.ord for r in rules if r.roles]), F.col("value")) if any(r.roles for r in rules) else F.lit(None).cast("string")
    # Hits of one signal of a code are one unit, whatever the rule; other parts go by rule.
    rows = rows.withColumn("unit", F.when(single, code).otherwise(F.col("rule_ord").cast("string"))).withColumn("label", F.when(single, F.col("signal")))
    rows = rows.select(*shared, F.floor(F.col("seq") / F.lit(STRETCH)).alias("stretch"), "seq", "role", F.struct("seq", "rule_ord", "signal", "source", kept.alias("value"), "ambiguity").alias("x"))
    before = Window.partitionBy(*shared, "stretch").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("latched", F.min(F.when(F.col("role") == "source", F.col("seq"))).over(before).isNotNull())

    def least(test: Column, name: str) -> Column:
        x = F.when(test, F.col("x"))
        return F.min_by(x, F.when(test, F.struct("x.seq", "x.rule_ord"))).alias(name)

    sink = F.col("role") == "sink"
    part = rows.groupBy(*shared, "stretch").agg(least(F.col("role").isin("single", "shell"), "one"), least(F.col("role") == "source", "src"), least(sink, "snk"), least(sink & F.col("latched"), "after"))
    # A source of an earlier stretch makes any sink count, the first of this one those after it.
    prior = F.min_by("src", F.when(F.col("src").isNotNull(), F.col("stretch"))).over(Window.partitionBy(*shared).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    part = part.withColumn("prior", prior)
    hit = F.coalesce("one", F.when(F.col("prior").isNotNull(), F.col("snk")).otherwise(F.col("after")))
    part = part.select(*shared, hit.alias("k"), F.coalesce("prior", "src").alias("s")).filter("k IS NOT NULL")
    out = part.groupBy(*shared).agg(F.min_by(F.struct("k", "s"), F.struct("k.seq", "k.rule_ord")).alias("r"))
    return out.select("scan_id", "r.k.rule_ord", "r.k.seq", "r.k.signal", "r.k.source", "r.k.value", "r.k.ambiguity", F.col("r.s.seq").alias("src_seq"), F.col("r.s.signal").alias("src_signal"), F.col("r.s.value").alias("src_value"))


def latched_pairs(actions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per scan and rule its first source and the first sink after it, as they are: the pairs of ``reduced``."""
    return reduced(tagged(actions, rules), rules)


def came_from_source(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of rules without roles, and those one of whose role values stands in the source text."""
    checked = [r for r in rules if r.roles]
    if not checked:
        return pairs
    held = F.lit(True)
    low = F.lower("src_value")
    for r in checked:
        found = F.exists(text.role_values(F.col("value"), r.roles), lambda v: F.contains(low, v))
        held = F.when(F.col("rule_ord") == r.ord, found).otherwise(held)
    return pairs.filter(held)


def _found(actions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Deduplicated hits of rules of any kinds."""
    if not rules:
        return _no_hits(actions)
    rows = came_from_source(reduced(tagged(actions, rules), rules), rules)
    pairs = [r for r in rules if r.kind in _ARROW]
    if pairs:
        arrow = _per_rule(pairs, "string", lambda r: _ARROW[r.kind])
        rows = rows.withColumn("signal", F.coalesce(F.concat("src_signal", arrow, "signal"), "signal"))
    return as_hits(rows, rules)


def sequence_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Pairs of a source action and a later sink action; one per scan and rule, at the sink."""
    return _found(actions, pack.of_kind("sequence"))


def taint_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Guarded pairs.  With roles, a value of the sink must come from the source, or the rule is over for the scan."""
    return _found(actions, pack.of_kind("taint"))


def shell_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Commands by program and flags.  Rules on constructs are no business of this pass."""
    return _found(actions, [r for r in pack.of_kind("shell") if not r.constructs])


def shell_ast_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """Commands by the constructs of the grammar."""
    return _found(actions, [r for r in pack.of_kind("shell") if r.constructs])


def all_hits(actions: DataFrame, pack: RulePack, shell_ast: bool = False) -> DataFrame:
    """Hits of all passes, deduplicated as each pass does, from one read of the actions."""
    return _found(actions, [r for r in pack.rules if shell_ast or not r.constructs])


def naive_hits(actions: DataFrame, pack: RulePack) -> DataFrame:
    """The baseline: plain substrings of any single-action rule, no boundaries and no contexts."""
    rules = pack.of_kind("single")
    hits = text.contained_signals(tuple(r.main.signals for r in rules))
    rows = actions.select("scan_id", "seq", F.expr(text.LOW).alias("low")).select("scan_id", "seq", F.expr(f"explode_outer({hits})").alias("h")).filter("h.g IS NOT NULL")
    codes = text.sql_table([r.code for r in rules], "array<string>")
    return rows.select("scan_id", "seq", F.expr(f"get({codes}, h.g)").alias("code"), F.col("h.signal").alias("signal"))


def marker_then_call(rows: DataFrame, marker: Column, call: Column, keys: list[str], order: str) -> DataFrame:
    """Keys with a marker row and any later call row: the latch as a window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latched = rows.select(*keys, order, F.max(marker.cast("int")).over(w).alias("_m"), call.alias("_c"))
    return latched.filter("_m = 1 AND _c").groupBy(*keys).agg(F.min(order).alias("call_at"))
