"""Where findings go: allowlists and thresholds move them aside, visibly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import glob_regex
from auditlake.plans.pack import Config, RulePack, SuppressRule

_REASONS = "reason string, suppressed_by string, origin string"


def _none() -> Column:
    return F.lit(None).cast("struct<reason:string,suppressed_by:string,origin:string>")


def allowlisted(rules: list[SuppressRule], code: Column, signal: Column, source: Column) -> Column:
    """Struct of the first entry that matches code, signal and the source that fired; null if none does."""

    def test(r: SuppressRule) -> Column:
        parts = [F.lit(True)]
        if r.code is not None:
            parts.append(code == r.code)
        if r.signal is not None:
            parts.append(signal == r.signal)
        if r.source_glob is not None:
            parts.append(source.rlike(glob_regex(r.source_glob)))
        return reduce(lambda a, b: a & b, parts)

    made = [F.when(test(r), F.struct(F.lit(r.reason).alias("reason"), F.lit(r.raw).alias("suppressed_by"), F.lit("allowlist").alias("origin"))) for r in rules]
    return F.coalesce(*made, _none())


#: Columns of an allowlist kept as a table; ``entry`` is its place, the first that matches counts.  Null fields match anything.
ALLOWLIST = "entry long, code string, signal string, source_glob string, reason string, raw string"
#: Kinds of entries: which of code and signal they name, and whether they have a glob.
_BOTH, _CODE, _SIGNAL, _ANY = "code", "code only", "signal only", "any"


def allowlist_table(spark: SparkSession, rules: list[SuppressRule]) -> DataFrame:
    """Entries as rows."""
    return spark.createDataFrame([(i, r.code, r.signal, r.source_glob, r.reason, r.raw) for i, r in enumerate(rules)], ALLOWLIST)


def _keyed(code: Column, signal: Column) -> list[tuple[str, Column, Column]]:
    """(kind, code, signal) that an entry of a kind has to have."""
    any_ = F.lit("*")
    return [(_BOTH, code, signal), (_CODE, code, any_), (_SIGNAL, any_, signal), (_ANY, any_, any_)]


def route_by_table(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with ``reason, suppressed_by, origin`` from an allowlist of any length, a table of ``ALLOWLIST``; all null for active ones.

    Findings are reduced to their distinct code, signal and source, and those meet the entries by hash joins. An entry's key is what it
    names of code and signal, and a handle: one of the literal stretches of its glob (``_handles``), that which
    the fewest entries share.  Sources look up their own stretches of the lengths that handles have, and
    what remains of a glob is tested on the pairs that agree so far.
    ``entry`` numbers decide; entries that repeat, and ties of numbers, count by
    their text.  Without entries all findings are active.
    """
    known = findings.select("id", "triggering_signal", "source").distinct()
    met = _agreeing(known, entries).filter(F.col("source_glob").isNull() | _glob_matches(F.col("source"), F.col("source_glob")))
    best = met.groupBy("id", "triggering_signal", "source").agg(F.min("e").alias("e"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "triggering_signal", "source")]
    out = findings.alias("f").join(best.alias("b"), reduce(lambda a, b: a & b, same), "left")
    return out.select("f.*", F.col("b.e.reason").alias("reason"), F.col("b.e.raw").alias("suppressed_by"), F.when(F.col("b.e").isNotNull(), "allowlist").alias("origin"))


def _agreeing(known: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of ``id, triggering_signal, source`` and ``source_glob, e`` that agree in all but what remains of the glob."""
    e = entries.select(F.col("entry").cast("long").alias("entry"), *(F.col(c).cast("string").alias(c) for c in ("code", "signal", "source_glob", "reason", "raw")))
    kind = F.when(F.col("code").isNotNull() & F.col("signal").isNotNull(), _BOTH).when(F.col("code").isNotNull(), _CODE).when(F.col("signal").isNotNull(), _SIGNAL).otherwise(_ANY)
    e = e.select("*", kind.alias("kind"), F.coalesce("code", F.lit("*")).alias("k_code"), F.coalesce("signal", F.lit("*")).alias("k_signal"))
    # Of entries that match the same findings the first one counts, so each key and glob is one row.
    first = F.min(F.struct("entry", "raw", F.coalesce("reason", F.lit("allowlisted")).alias("reason"))).alias("e")
    named, glob = ["kind", "k_code", "k_signal"], ["kind", "k_code", "k_signal", "source_glob"]
    e = e.groupBy(*glob).agg(first).withColumn("handles", F.expr(_handles("source_glob")))
    # Tests that name the first entry as well stay behind the grouping, so that handles are made once a row there and not where a table is read.
    several = e.filter("CASE WHEN e IS NOT NULL THEN size(handles) > 1 END").select(*glob, "e", F.explode("handles").alias("handle"))
    shared = several.groupBy(*named, "handle").agg(F.count("*").alias("c")).filter("c > 1")
    rarest = F.min_by("handle", F.struct(F.coalesce("c", F.lit(1)).alias("c"), -F.col("handle.n"), "handle")).alias("handle")
    several = several.join(shared, [*named, "handle"], "left").groupBy(*glob).agg(F.first("e").alias("e"), rarest)
    e = e.filter("CASE WHEN e IS NOT NULL THEN size(handles) = 1 END").select(*glob, "e", F.col("handles")[0].alias("handle")).unionByName(several)
    sources = known.select("source").distinct()
    lengths = e.select("handle.inside", "handle.n").distinct()  # at most 65 at the start and 7 elsewhere
    held = _probes(sources, lengths).join(e.select("handle").distinct(), "handle", "left_semi")
    # Entries without any literal are met by all sources, so nothing is looked up for them.
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("k_code"), s.alias("k_signal")) for k, c, s in _keyed(F.col("id"), F.col("triggering_signal"))))
    none = known.withColumn("handle", F.expr(_NO_HANDLE))
    asked = known.join(held, "source").unionByName(none).select("*", F.inline(keys)).filter(F.col("k_code").isNotNull() & F.col("k_signal").isNotNull())
    return asked.join(e, [*named, "handle"])


#: Characters of the longest handle.
_LONGEST = 64


def _handle(inside: str, n: str, text: str) -> str:
    return f"named_struct('inside', {inside}, 'n', {n}, 'h', xxhash64({text}))"


#: The handle of a glob without any literal.
_NO_HANDLE = _handle("false", "0", "''")


def _handles(glob: str) -> str:
    """SQL for the handles of a glob: what any source that it matches holds.

    One is the literal start, up to 64 characters; others are stretches of the literals after a ``*``, which may stand
    anywhere, and of what a start has beyond.  Their length is the largest power of two that fits, 64 at most, and each literal is covered by them.  Texts
    stand as checksums; what agrees by chance fails the glob's test.
    """
    start = f"substring_index({glob}, '*', 1)"
    n = f"least(char_length({start}), {_LONGEST})"
    head = f"if(char_length({start}) > 0, array({_handle('false', n, f'left({start}, {n})')}), array())"
    size = f"CASE {' '.join(f'WHEN char_length(t) >= {1 << k} THEN {1 << k}' for k in range(_LONGEST.bit_length() - 1, -1, -1))} END"
    at = "CAST(array_union(sequence(1, char_length(t) - n + 1, n), array(char_length(t) - n + 1)) AS array<int>)"
    cuts = f"transform({at}, p -> {_handle('true', 'n', 'substring(t, p, n)')})"
    cuts = f"flatten(transform(array({size}), n -> {cuts}))"
    rest = f"concat(array(substring({start}, {_LONGEST} + 1)), slice(split({glob}, '[*]'), 2, 1073741824))"
    inside = f"flatten(transform(filter({rest}, t -> t <> ''), t -> {cuts}))"
    found = f"array_distinct(concat({head}, {inside}))"
    return f"transform(array(coalesce({found}, array())), a -> if(size(a) > 0, a, array({_NO_HANDLE})))[0]"


def _probes(sources: DataFrame, lengths: DataFrame) -> DataFrame:
    """``source, handle``: all stretches of each source that have the length and place of some handle."""
    at = "if(inside, sequence(1, char_length(source) - n + 1), array(1))"
    found = f"array_distinct(transform({at}, p -> {_handle('inside', 'n', 'substring(source, p, n)')}))"
    asked = sources.filter("source IS NOT NULL").join(F.broadcast(lengths.filter("n > 0")), F.expr("char_length(source) >= n"))
    return asked.select("source", F.explode(F.expr(found)).alias("handle"))


def _glob_matches(source: Column, glob: Column) -> Column:
    """Whether a glob that knows ``*`` only, in a column, matches the whole source: as LIKE, with the signs of LIKE escaped."""
    pattern = F.replace(F.replace(F.replace(F.replace(glob, F.lit("!"), F.lit("!!")), F.lit("%"), F.lit("!%")), F.lit("_"), F.lit("!_")), F.lit("*"), F.lit("%"))
    return F.like(source, pattern, F.lit("!"))


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def below_threshold(pack: RulePack, config: Config, min_confidence: float | None, min_severity: int | None) -> Column:
    """Struct of the threshold that a finding misses, confidence first; null if it misses none.

    Severity is the config's, else the rule's; a code with neither is never dropped.
    """
    out = []
    if min_confidence is not None:
        # Both sides in single precision, so that a finding at the threshold stays.
        miss = F.col("confidence").cast("float") < F.lit(float(min_confidence)).cast("float")
        n = _number(min_confidence)
        out.append(F.when(miss, F.struct(F.lit(f"below min-confidence {n}").alias("reason"), F.lit(f"threshold:min-confidence {n}").alias("suppressed_by"), F.lit("threshold").alias("origin"))))
    if min_severity is not None:
        known = pack.severity() | config.severity
        pairs = [x for kv in sorted(known.items()) for x in (F.lit(kv[0]), F.lit(kv[1]))]
        severity = F.create_map(*pairs)[F.col("id")] if pairs else F.lit(None).cast("int")
        reason = F.concat(F.lit(f"below min-severity {min_severity} (effective severity "), severity.cast("string"), F.lit(")"))
        out.append(F.when(severity < min_severity, F.struct(reason.alias("reason"), F.lit(f"threshold:min-severity {min_severity}").alias("suppressed_by"), F.lit("threshold").alias("origin"))))
    return F.coalesce(*out, _none())


def route(findings: DataFrame, pack: RulePack, suppress: list[SuppressRule] | DataFrame = (), config: Config = Config(), min_confidence: float | None = None, min_severity: int | None = None) -> DataFrame:
    """Findings with ``reason, suppressed_by, origin``; all null for active ones.

    The allowlist, a short list or a table of ``ALLOWLIST``, is asked first; thresholds are the call's, else the config's.
    """
    confidence = min_confidence if min_confidence is not None else config.min_confidence
    severity = min_severity if min_severity is not None else config.min_severity
    if isinstance(suppress, DataFrame):
        names = ("reason", "suppressed_by", "origin")
        below = below_threshold(pack, config, confidence, severity)
        found = route_by_table(findings, suppress).withColumn("_m", below)
        return found.select(*findings.columns, *(F.when(F.col("origin").isNotNull(), F.col(c)).otherwise(F.col(f"_m.{c}")).alias(c) for c in names))
    moved = F.coalesce(allowlisted(list(suppress), F.col("id"), F.col("triggering_signal"), F.col("source")), below_threshold(pack, config, confidence, severity))
    return findings.withColumn("_m", moved).select("*", "_m.reason", "_m.suppressed_by", "_m.origin").drop("_m")
