"""Telemetry exports in OTLP/JSON: log records first, then spans.

Files up to ``WHOLE`` bytes are VARIANTs, whole or by line, and records come from
expressions over them.  Larger ones are read by ranges: one document by its brackets (``otlp_split``), so that
its records are VARIANTs of their own, other files by lines.  A single record, or a line,
must fit a VARIANT (16 MiB); a larger one is skipped as one that can't be parsed.  Of a larger
document only the records and the brackets around them are checked, and of a list's key that repeats each counts.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.variant import SPACE, allow_repeated_keys, fields, is_object, let, parsed_line, part, parts, string
from auditlake.sources.otlp_split import split_records

# Attributes that name a tool, by precedence, and the files that are read.
TOOL_KEYS = ("gen_ai.tool.name", "tool.name", "gen_ai.operation.name", "code.function.name", "code.function")
SUFFIXES = ("json", "jsonl", "ndjson")
#: Records of one line, lines of a file and files of a scan have numbers below these; beyond, reading fails.
PER_LINE, LINES, FILES = 1 << 23, 1 << 23, 1 << 17
#: Bytes of a file that is read as one value.
WHOLE = 4 << 20
#: Lists within lists that expressions look into; records that may have deeper ones are read by a helper.
DEPTH = 3
_LISTS = {"log": ("resourceLogs", "scopeLogs", "logRecords"), "span": ("resourceSpans", "scopeSpans", "spans")}


def _number(v: Column) -> Column:
    """A number as text: whole ones without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e16)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


_KINDS = ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")


def any_value(v: Column, depth: int = DEPTH) -> Column:
    """Text of a typed value: text, whole number, number, truth value, and lists of these joined by blanks."""
    kind = F.schema_of_variant  # asked of parts only, as it reads all that a value holds

    def plain(o: Column) -> list[Column]:
        whole, number, truth = o["intValue"], o["doubleValue"], o["boolValue"]
        numeric = kind(number).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return [
            F.when(o["stringValue"].isNotNull(), string(o["stringValue"])),
            F.when(whole.isNotNull() & kind(whole).isin("STRING", "BIGINT"), F.try_variant_get(whole, "$", "string")),
            F.when(number.isNotNull() & numeric, _number(F.try_variant_get(number, "$", "double"))),
            F.when(truth.isNotNull() & (kind(truth) == "BOOLEAN"), F.try_variant_get(truth, "$", "string")),
        ]

    def text(o: Column) -> Column:
        out = plain(o)
        if depth:
            def texts(items: Column) -> Column:
                return F.filter(F.transform(items, lambda x: any_value(x, depth - 1)), lambda t: t.isNotNull())

            # Both kinds of lists in one, so that the nested expression stands here once; written twice, it would double with each level.
            lists = F.array(parts(o["arrayValue"], "$.values"), F.transform(parts(o["kvlistValue"], "$.values"), lambda x: part(x, "$.value")))
            found = F.filter(F.transform(lists, texts), lambda t: F.size(t) > 0)
            out.append(F.when(o["arrayValue"].isNotNull() | o["kvlistValue"].isNotNull(), let(found, lambda f: F.array_join(F.get(f, F.lit(0)), " "))))
        return F.coalesce(*out)

    return let(F.struct(v.alias("v"), fields(v, *_KINDS).alias("o")), lambda x: F.when(x["o"].isNull(), string(x["v"])).otherwise(text(x["o"])))


def _plain(v: object) -> str | None:
    """Text of a typed value that is no list."""
    if isinstance(v, str):
        return v
    if not isinstance(v, dict):
        return None
    text, whole, number, truth = (v.get(f"{k}Value") for k in ("string", "int", "double", "bool"))
    if isinstance(text, str):
        return text
    if isinstance(whole, str) or (isinstance(whole, int) and not isinstance(whole, bool)):
        return str(whole)
    if isinstance(number, (int, float)) and not isinstance(number, bool):
        return str(int(number)) if float(number).is_integer() and abs(number) < 1e16 else repr(float(number))
    return ("true" if truth else "false") if isinstance(truth, bool) else None


def deep_text(value: object) -> str | None:
    """Text of a typed value whose lists stand in each other to any depth, without recursion."""

    def lists(v: object) -> list[list]:
        out = []
        for key in ("kvlistValue", "arrayValue"):  # the last is looked at first
            items = v.get(key) if isinstance(v, dict) else None
            items = items.get("values") if isinstance(items, dict) else None
            if isinstance(items, list):
                out.append(items if key == "arrayValue" else [x.get("value") for x in items if isinstance(x, dict)])
        return out

    open_: list[tuple[list[list], list, list[str]]] = []  # lists not looked at, items not looked at, texts
    text, at = None, value
    while True:
        text = _plain(at)
        if text is None and (some := lists(at)):
            items = some.pop()
            open_.append((some, items[::-1], []))
        elif open_:
            open_[-1][2].extend([] if text is None else [text])
        else:
            return text
        while open_ and not open_[-1][1]:
            some, _, texts = open_.pop()
            if not texts and some:
                items = some.pop()
                open_.append((some, items[::-1], []))
                continue
            if not open_:
                return " ".join(texts) if texts else None
            open_[-1][2].extend([" ".join(texts)] if texts else [])
        if not open_:
            return None
        at = open_[-1][1].pop()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deep_texts(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else [None if x is None else deep_text(json.loads(x)) for x in v])


def _blank(text: Column) -> Column:
    return F.coalesce(F.btrim(text, F.lit(SPACE)), F.lit("")) == ""


def record_actions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``what, source, value`` for their ``record`` (a log record or, where ``span``, a span), which goes; a skip if it holds no text."""
    keep = [c for c in rows.columns if c not in ("record", "span")]
    pairs = F.transform(parts(F.col("record"), "$.attributes"), lambda a: let(fields(a, "key", "value"), lambda o: F.struct(string(o["key"]).alias("k"), o["value"].alias("v"))))
    pairs = F.coalesce(F.filter(pairs, lambda a: a["k"].isNotNull()), F.array().cast("array<struct<k:string,v:variant>>"))
    # The body is one more value, before the attributes.
    values = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("k"), F.when(~F.col("span"), part(F.col("record"), "$.body")).alias("v"))), pairs)
    rows = rows.select(*keep, "span", string(part(F.col("record"), "$.name")).alias("_name"), values.alias("_values"))
    lists = F.expr("regexp_count(to_json(_values), '(arrayValue|kvlistValue)')")
    rows = rows.withColumn("_deep", lists > DEPTH)
    # Values stay here: what waits for the helper is copied, texts only.
    shallow = F.when(~F.col("_deep"), F.transform("_values", lambda a: any_value(a["v"])))
    deep = F.when(F.col("_deep"), F.transform("_values", lambda a: F.to_json(a["v"])))
    rows = rows.select(*keep, "span", "_name", F.transform("_values", lambda a: a["k"]).alias("_keys"), shallow.alias("_shallow"), deep.alias("_lists"))
    rows = rows.select(*keep, "span", "_name", "_keys", F.coalesce("_shallow", _deep_texts("_lists")).alias("_texts"))

    def make(r: Column) -> Column:
        return let(F.filter(F.slice(r["pairs"], 2, 1 << 30), lambda a: a["t"].isNotNull()), lambda named: told(r, named))

    def told(r: Column, named: Column) -> Column:
        def first(key: str) -> Column:
            return let(F.get(F.filter(named, lambda a: a["k"] == key), F.lit(0))["t"], lambda t: F.when(~_blank(t), t))

        tool = F.coalesce(*(first(k) for k in TOOL_KEYS), F.when(r["span"], r["name"]))
        head = F.when(r["span"], r["name"]).otherwise(F.get(r["pairs"], F.lit(0))["t"])
        texts = F.filter(F.concat(F.array(head), F.transform(named, lambda a: a["t"])), lambda t: ~_blank(t))
        kind = F.when(r["span"], "otlp:span").otherwise("otlp:log")

        def event(x: Column) -> Column:
            words = F.split(F.btrim(x["tool"], F.lit(SPACE)), r"(?U)\s+")
            source = F.when(~_blank(x["tool"]), F.concat(F.lit("session:"), F.element_at(words, -1), F.lit(".input"))).otherwise(kind)
            made = F.struct(F.lit("action").alias("what"), source.alias("source"), F.array_join(x["texts"], " ").alias("value"))
            none = F.struct(F.lit("skip").alias("what"), kind.alias("source"), F.lit("record carried no observable string").alias("value"))
            return F.when(F.size(x["texts"]) > 0, made).otherwise(none)

        return let(F.struct(tool.alias("tool"), texts.alias("texts")), event)

    pairs = F.arrays_zip(F.col("_keys").alias("k"), F.col("_texts").alias("t"))
    # A lambda's variable is evaluated once.
    made = F.transform(F.array(F.struct(F.col("span"), F.col("_name").alias("name"), pairs.cast("array<struct<k:string,t:string>>").alias("pairs"))), make)
    # Outer, as a plain explode makes the optimiser evaluate its expression once more, to see whether it is empty.
    return rows.select(*keep, F.explode_outer(made).alias("_e")).select(*keep, "_e.what", "_e.source", "_e.value")


def _records(top: Column, second: str, third: str) -> Column:
    """Objects of nested lists, of which ``top`` is the outermost."""
    none = F.array().cast("array<variant>")

    def below(items: Column, name: str) -> Column:
        return F.flatten(F.transform(items, lambda x: F.coalesce(parts(x, f"$.{name}"), none)))

    return F.filter(below(below(F.coalesce(top, none), second), third), is_object)


def _document_events(docs: DataFrame) -> DataFrame:
    """``path, pos, what, source, value`` of documents given as ``path, number`` (0: the whole file, else its line)``, doc`` (null: can't be parsed)."""
    doc = F.col("doc")

    def item(failed: Column, span: bool | None = None, record: Column = F.lit(None).cast("variant")) -> Column:
        return F.struct(failed.alias("failed"), F.lit(span).cast("boolean").alias("span"), record.alias("record"))

    def skip(source: Column, reason: str) -> Column:
        return F.array(item(F.struct(F.lit("skip").alias("what"), source.alias("source"), F.lit(reason).alias("value"))))

    def marked(top: Column, kind: str) -> Column:
        none = F.lit(None).cast("struct<what:string,source:string,value:string>")
        return F.transform(_records(top, *_LISTS[kind][1:]), lambda r: item(none, kind == "span", r))

    def found(x: Column) -> Column:
        return F.when(x["log"].isNull() & x["span"].isNull(), skip(F.lit("document"), "neither resourceLogs nor resourceSpans")).otherwise(F.concat(marked(x["log"], "log"), marked(x["span"], "span")))

    # The lists of a document are copies of all it holds, so they are made once.
    tops = F.struct(*(parts(doc, f"$.{names[0]}").alias(kind) for kind, names in _LISTS.items()))
    items = F.when(doc.isNull(), skip(F.concat(F.lit("line "), F.col("number").cast("string")), "json parse error")).otherwise(let(tops, found))
    # Outer, as below.
    rows = docs.select("path", "number", F.posexplode_outer(items).alias("i", "r")).filter("i IS NOT NULL")
    fits = F.when((F.col("number") == 0) | (F.col("i") < PER_LINE), F.col("i")).otherwise(F.raise_error(F.lit("too many records in a line")))
    rows = rows.select("path", (F.col("number") * F.lit(PER_LINE) + fits).alias("pos"), F.col("r.failed").alias("failed"), F.coalesce("r.span", F.lit(False)).alias("span"), F.col("r.record").alias("record"))
    events = record_actions(rows)
    return events.select("path", "pos", *(F.coalesce(F.col(f"failed.{c}"), F.col(c)).alias(c) for c in ("what", "source", "value")))


def otlp_events(texts: DataFrame) -> DataFrame:
    """Events of files given as ``path, text``: ``path, pos, what`` (action or skip)``, source, value``.

    A file is one document, or else a document a line.
    """
    allow_repeated_keys(texts.sparkSession)
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit("\ufeff"))
    rows = texts.select("path", text.alias("text")).filter(~_blank(F.col("text"))).withColumn("v", parsed_line(F.col("text")))
    lines = F.when(F.col("v").isNotNull(), F.array(F.lit(""))).otherwise(F.split("text", "\n"))
    rows = rows.select("path", F.when(F.col("v").isNotNull(), F.col("v")).alias("whole"), F.posexplode(lines).alias("at", "line"))
    rows = rows.filter(F.col("whole").isNotNull() | ~_blank(F.col("line"))).withColumn("doc", F.coalesce("whole", parsed_line(F.col("line"))))
    number = F.when(F.col("whole").isNotNull(), 0).otherwise(_line_number(F.col("at") + 1)).cast("long")
    return _document_events(rows.select("path", number.alias("number"), "doc"))


def _line_number(n: Column) -> Column:
    return F.when(n < LINES, n).otherwise(F.raise_error(F.lit("too many lines in a file")))


def _large_events(spark: SparkSession, path: str, glob: str, whole: int) -> DataFrame:
    """Events of the files beyond ``whole`` bytes, as ``otlp_events`` gives them for smaller ones; each is read by its ranges."""

    def ranges(end: str) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", glob).option("lineSep", end).text(path).filter(F.col("_metadata.file_size") > whole)
        return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))

    records, documents = split_records(ranges("}"), _LISTS)
    logs = records.filter("kind = 'log'").groupBy("path").agg(F.count("*").alias("logs"))
    rows = records.join(logs, "path", "left").select("path", (F.col("i") + F.when(F.col("kind") == "span", F.coalesce("logs", F.lit(0))).otherwise(0)).alias("pos"), (F.col("kind") == "span").alias("span"), parsed_line(F.col("text")).alias("record"))
    parsed = record_actions(rows.withColumn("_bad", F.col("record").isNull()))
    unread = F.struct(F.lit("skip").alias("what"), F.lit("record").alias("source"), F.lit("json parse error").alias("value"))
    events = parsed.withColumn("_f", F.when(F.col("_bad"), unread)).select("path", "pos", *(F.coalesce(F.col(f"_f.{c}"), F.col(c)).alias(c) for c in ("what", "source", "value")))
    none = documents.filter("NOT known").select("path", F.lit(0).cast("long").alias("pos"), F.lit("skip").alias("what"), F.lit("document").alias("source"), F.lit("neither resourceLogs nor resourceSpans").alias("value"))
    # All other files, by lines; their numbers come from the ranges' counts.
    lines = ranges("\n").join(documents, "path", "left_anti")
    counts = lines.groupBy("path", "start").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("r", F.row_number().over(Window.partitionBy("path", "start").orderBy("n"))).join(counts.select("path", "start", before.alias("before")), ["path", "start"])
    text = F.col("piece").cast("string")
    text = F.when(F.col("before") + F.col("r") == 1, F.btrim(text, F.lit("\ufeff"))).otherwise(text)
    placed = placed.select("path", _line_number(F.col("before") + F.col("r")).cast("long").alias("number"), text.alias("text")).filter(~_blank(F.col("text")))
    return events.unionByName(none).unionByName(_document_events(placed.select("path", "number", parsed_line(F.col("text")).alias("doc"))))


def read_otlp(spark: SparkSession, path: str, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """(actions, skips) of a file or of the files right in a folder; all are one scan, ordered by path and place.

    Files of more than ``whole`` bytes are read by ranges, so that any number of tasks share one.

    A path that isn't there, or a folder without such files, is an error.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise FileNotFoundError(path)
    glob = "*.{" + ",".join(SUFFIXES) + "}" if store.getFileStatus(place).isDirectory() else "*"
    # The listing alone, a row per file: content isn't read for it.
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    ranks = listed.select("path").withColumn("file", F.row_number().over(Window.orderBy("path")))
    count = listed.count()
    if not 0 < count < FILES:
        raise FileNotFoundError(f"{path}: no {', '.join(SUFFIXES)} files") if count == 0 else ValueError(f"{path}: more than {FILES - 1} files")
    allow_repeated_keys(spark)
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).filter(F.col("_metadata.file_size") <= whole)
    events = otlp_events(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    if not listed.filter(F.col("length") > whole).isEmpty():
        events = events.unionByName(_large_events(spark, path, glob, whole))
    placed = events.join(F.broadcast(ranks), "path")  # fewer than FILES rows
    placed = placed.withColumn("seq", F.col("file") * F.lit(PER_LINE * LINES) + F.col("pos")).withColumn("scan_id", F.lit(path))
    return placed.filter("what = 'action'").select("scan_id", "seq", "source", "value"), placed.filter("what = 'skip'").select("scan_id", "seq", F.col("source").alias("place"), F.col("value").alias("reason"))
