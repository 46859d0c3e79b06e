"""Documents of all scans, written by executors as a data source's sink.

A scan's findings meet in one task, in order, and its document is rendered and
written there.  A task writes into a folder of its own; only when all tasks are
done do these folders get their names, so a rerun task or a failed job leaves no
document twice or by half.  A task holds one scan's document at a time.

Each document is a file, or one of a zip archive of a few thousand: as files, their making and taking away costs the file system
an operation each, which no number of tasks shortens.  Documents are found and read by tasks as well; the driver sees folders, one a task of the writer.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote
from zipfile import ZIP_DEFLATED, ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from auditlake.plans.detect import Report
from auditlake.plans.render import findings_json, json_text, markdown_text, sarif_of
from auditlake.sources.repo import Store
from auditlake.sources.spread import cut


def _of_dicts(render):
    """A renderer of parsed reports for findings as JSON."""

    def text(findings: list[str], suppressed: list[str], source: str, collapsed: str) -> str:
        return render({"rules_source": source, "rules_source_collapsed": collapsed, "findings": [json.loads(f) for f in findings], "suppressed": [json.loads(f) for f in suppressed]})

    return text


_KINDS = {"json": _of_dicts(json_text), "sarif": lambda findings, suppressed, _, collapsed: sarif_of(findings + suppressed, collapsed), "md": _of_dicts(markdown_text)}
#: Documents that one task reads and one archive holds, at most; bytes of texts that end an archive; bytes of texts that are read at once, unless one alone is longer.
_PER_TASK, _ARCHIVE, _BATCH = 2048, 64 << 20, 4 << 20
_ZIP = ".zip"
#: Bytes of a name that file systems take, less an ending and a digest.
_NAME = 180


def document_name(scan_id: str | None, kind: str) -> str:
    """A file name for a scan: its id percent-encoded; a long one is cut and ends in a digest, none is ``%none``, an empty one ``%empty``."""
    name = "%none" if scan_id is None else quote(scan_id, safe="") or "%empty"
    if len(name) > _NAME:
        name = f"{name[:_NAME]}%{hashlib.sha256(scan_id.encode()).hexdigest()[:32]}"
    return f"{name}.{kind}"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    documents: int


class _Files:
    """Documents as files of a folder."""

    def __init__(self, store: Store, folder: str, kind: str):
        self.store, self.folder, self.kind = store, folder, kind

    def add(self, name: str, body: bytes) -> None:
        self.store.write(f"{self.folder}/{name}".encode(), body)

    def close(self) -> None:
        pass


class _Archives(_Files):
    """Documents in archives of a folder, one after the other."""

    zip, n, documents, size = None, 0, 0, 0

    def add(self, name: str, body: bytes) -> None:
        if self.zip is None:
            self.opened = self.store.create(f"{self.folder}/documents-{self.n:05d}.{self.kind}{_ZIP}".encode())
            self.zip, self.n, self.documents, self.size = ZipFile(self.opened, "w", ZIP_DEFLATED, compresslevel=1), self.n + 1, 0, 0
        self.zip.writestr(name, body)
        self.documents, self.size = self.documents + 1, self.size + len(body)
        if self.documents >= _PER_TASK or self.size >= _ARCHIVE:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.opened.close()
            self.zip = None


class _DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        store, folder, n = Store(self.options["path"]), f".pending-{self.job}/{uuid.uuid4().hex}", 0
        kind = self.options["kind"]
        out = (_Archives if self.options.get("archives") == "true" else _Files)(store, folder, kind)
        for scan_id, mine in groupby(rows, key=lambda r: r["scan_id"]):
            findings, suppressed = [], []
            for row in mine:
                if row["json"] is not None:
                    (suppressed if row["moved"] else findings).append(row["json"])
            text = _KINDS[kind](findings, suppressed, self.options["source"], self.options["collapsed"])
            out.add(document_name(scan_id, kind), text.encode())
            n += 1
        out.close()
        return _Written(folder, n)

    def commit(self, messages: list[_Written]) -> None:
        store = Store(self.options["path"])
        if self.overwrite:
            for name, is_dir in store.entries(b""):
                if is_dir and name.startswith(b"part-"):
                    store.drop(name)
        for i, m in enumerate(m for m in messages if m is not None and m.documents):  # one a task
            store.move(m.folder.encode(), f"part-{i:05d}-{self.job}".encode())
        if any(m is not None and m.documents for m in messages):
            store.drop(f".pending-{self.job}".encode())

    def abort(self, messages: list[_Written]) -> None:
        Store(self.options["path"]).drop(f".pending-{self.job}".encode())


class DocumentSink(DataSource):
    """Format ``auditlake_documents``: rows ``scan_id, moved, json``, those of a scan together; options ``path, kind, source, collapsed, archives``."""

    @classmethod
    def name(cls) -> str:
        return "auditlake_documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(dict(self.options), overwrite)


def write_documents(report: Report, path: str, kind: str = "sarif", scans: DataFrame | None = None, overwrite: bool = False, archives: bool = False) -> None:
    """A document for each scan as ``part-*/<scan>.<kind>`` below ``path``, equal to what ``to_sarif`` and its like give; ``kind``: ``json``, ``sarif`` or ``md``.

    ``scans`` (``scan_id``, others ignored) adds scans without any finding.  A
    failed job leaves no document; ``overwrite`` takes earlier ones away when all new ones are there.  With ``archives`` the same
    documents stand in ``part-*/documents-*.<kind>.zip``, a few thousand each, for large numbers of scans.  ``path`` is
    shared, or an address that Arrow's file systems know.
    """
    if kind not in _KINDS:
        raise ValueError(f"kind {kind!r} is none of {', '.join(_KINDS)}")
    order = ["pass", "seq", "rule_ord"]
    spark = report.findings.sparkSession
    spark.dataSource.register(DocumentSink)
    if report.routed is not None:  # one read of the actions
        rows = findings_json(report.routed.withColumn("_m", F.col("origin").isNotNull()), "_m").withColumnRenamed("_m", "moved")
    else:
        parts = [findings_json(df).withColumn("moved", F.lit(moved)) for df, moved in ((report.findings, False), (report.suppressed, True))]
        rows = parts[0].union(parts[1])
    if scans is not None:
        none = scans.select("scan_id").distinct().select("scan_id", F.lit(-1).alias("pass"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).alias("rule_ord"), F.lit(None).cast("string").alias("json"), F.lit(False).alias("moved"))
        rows = rows.union(none)
    rows = rows.repartition("scan_id").sortWithinPartitions("scan_id", "moved", *order).select("scan_id", "moved", "json")
    made = rows.write.format("auditlake_documents").mode("overwrite" if overwrite else "append")
    made.option("kind", kind).option("archives", archives).option("source", report.pack.source).option("collapsed", report.pack.source_collapsed).save(str(path))


def list_documents(spark: SparkSession, path: str, kind: str = "sarif") -> DataFrame:
    """``part, name`` of the documents and archives below ``path``, listed by tasks, as a table that is dealt to a task for each few thousand documents; runs jobs."""
    root, endings = str(path), (f".{kind}".encode(), f".{kind}{_ZIP}".encode())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            for part in batch["part"].to_pylist():
                names = [name.decode() for name, is_dir in store.entries(part.encode()) if not is_dir and name.endswith(endings)]
                for i in range(0, len(names), 10_000):
                    yield pa.record_batch({"part": [part] * len(names[i : i + 10_000]), "name": names[i : i + 10_000]})

    parts = [(name.decode(),) for name, is_dir in sorted(Store(root).entries(b"")) if is_dir and name.startswith(b"part-")]  # one a task of the writer
    names = cut(spark.createDataFrame(parts, "part string").mapInArrow(listed, "part string, name string"))
    documents = names.agg(F.sum(F.when(F.endswith("name", F.lit(_ZIP)), _PER_TASK).otherwise(1))).head()[0] or 0
    return names.repartition(max(-(-documents // _PER_TASK), spark.sparkContext.defaultParallelism))


def read_documents(listed: DataFrame, path: str) -> DataFrame:
    """``name, text`` of listed documents and of those in listed archives, each read where its row is."""
    root = str(path)

    def texts(store: Store, file: str) -> Iterator[tuple[str, str]]:
        if file.endswith(_ZIP):
            with store.open(file.encode()) as opened, ZipFile(opened) as archive:
                for name in archive.namelist():
                    yield name, archive.read(name).decode()
        else:
            yield file.rpartition("/")[2], store.head(file.encode(), -1).decode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)
        for batch in batches:
            rows, size = [], 0
            for part, name in zip(batch["part"].to_pylist(), batch["name"].to_pylist()):
                for row in texts(store, f"{part}/{name}"):
                    rows.append(row)
                    size += len(row[1])
                    if size >= _BATCH:
                        yield _record(rows)
                        rows, size = [], 0
            if rows:
                yield _record(rows)

    return listed.mapInArrow(read, "name string, text string")


def _record(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    names, texts = zip(*rows)
    return pa.record_batch({"name": pa.array(names, pa.string()), "text": pa.array(texts, pa.string())})
