"""Repository trees and single literals as actions.

A tree is walked a level of folders a job: every folder is a row that carries
the ignore files above it, tasks list the folders of a level, and what they
find is the next level.  Files get their numbers from a sort by their parts, a
count a partition.  The driver holds counts only.  Local paths must be shared by driver and executors;
other addresses are opened with Arrow's file systems.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator
from functools import lru_cache, reduce
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.spread import cut

#: Bytes of a file that are read.
HEAD = 256 * 1024
#: Files whose heads one task reads, about.
_PER_TASK = 1024
#: Files whose heads are in memory at once.
_HEADS = 32
#: Names of the files whose patterns hide files beside and below them, later ones win.
_IGNORE = (".gitignore", ".ignore")

_LISTED = "parts array<string>, raw binary, what string, reason string, rules array<struct<depth:int,text:string>>"


class Store:
    """Folders and files below an address, whose relative paths are bytes; links are neither."""

    def __init__(self, root: str):
        url, self.made = urlsplit(root), set()
        self.local = url.scheme in ("", "file")
        if self.local:
            self.root = os.fsencode(unquote(url.path) if url.scheme else root)
        else:
            from pyarrow import fs

            self.files, self.root = fs.FileSystem.from_uri(root)

    def entries(self, folder: bytes) -> list[tuple[bytes, bool]]:
        """(name, whether it is a folder)."""
        if self.local:
            with os.scandir(os.path.join(self.root, folder)) as found:
                return [(e.name, e.is_dir(follow_symlinks=False)) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self._name(folder)))
        return [(i.base_name.encode(), i.type == fs.FileType.Directory) for i in found if i.type in (fs.FileType.Directory, fs.FileType.File)]

    def head(self, file: bytes, size: int) -> bytes:
        if self.local:
            with open(os.path.join(self.root, file), "rb") as opened:
                return opened.read(size)
        with self.files.open_input_stream(self._name(file)) as opened:
            return opened.read(size)

    def open(self, file: bytes):
        """A file opened for reading anywhere in it."""
        return open(os.path.join(self.root, file), "rb") if self.local else self.files.open_input_file(self._name(file))

    def create(self, file: bytes):
        """A new file with its folders, opened for writing."""
        if self.local:
            place = os.path.join(self.root, file)
            self._make(os.path.dirname(place), lambda folder: os.makedirs(folder, exist_ok=True))
            return open(place, "wb")
        name = self._name(file)
        self._make(name.rpartition("/")[0], self.files.create_dir)
        return self.files.open_output_stream(name)

    def write(self, file: bytes, body: bytes) -> None:
        """A file with its folders."""
        with self.create(file) as opened:
            opened.write(body)

    def _make(self, folder: bytes | str, make) -> None:
        """A folder once, however many files go there."""
        if folder not in self.made:
            make(folder)
            self.made = {folder}

    def move(self, folder: bytes, to: bytes) -> None:
        if self.local:
            os.rename(os.path.join(self.root, folder), os.path.join(self.root, to))
        else:
            self.files.move(self._name(folder), self._name(to))

    def drop(self, folder: bytes) -> None:
        """A folder with all in it goes, if it is there."""
        if self.local:
            shutil.rmtree(os.path.join(self.root, folder), ignore_errors=True)
        else:
            self.files.delete_dir_contents(self._name(folder), missing_dir_ok=True)
            self.files.delete_dir(self._name(folder))

    def _name(self, below: bytes) -> str:
        return f"{self.root.rstrip('/')}/{below.decode()}".rstrip("/")


@lru_cache(1024)
def _ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern on the path below the folder, negated, folders only) of the lines of an ignore file."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:].removeprefix("\\")
        only_dirs = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        parts = []
        for piece in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\])", body):
            if piece in ("**/",):
                parts.append("(?:.*/)?")
            elif piece in ("/**", "**"):
                parts.append(".*" if piece == "**" else "/.*")
            elif piece == "*":
                parts.append("[^/]*")
            elif piece == "?":
                parts.append("[^/]")
            elif piece.startswith("["):
                parts.append(piece.replace("[!", "[^"))
            else:
                parts.append(re.escape(piece))
        out.append((re.compile(("" if anchored else "(?:.*/)?") + "".join(parts) + r"\Z"), negated, only_dirs))
    return out


def _hidden(parts: list[str], is_dir: bool, rules: list) -> bool:
    """Whether the ignore files of the folders above, outer ones first, hide a path: the last pattern that matches decides."""
    hidden = False
    for rule in rules:
        below = "/".join(parts[rule["depth"] :])
        for pattern, negated, only_dirs in _ignore_rules(rule["text"]):
            if (is_dir or not only_dirs) and pattern.match(below):
                hidden = not negated
    return hidden


def _listing(root: str):
    """Lists folders: their files, folders and what can't be listed."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for batch in batches:
            for parts, raw, above in zip(batch["parts"], batch["raw"], batch["rules"]):
                parts, out = list(parts), []
                rules = [{"depth": int(r["depth"]), "text": r["text"]} for r in above]
                try:
                    found = store.entries(raw)
                    names = {name for name, is_dir in found if not is_dir}
                    texts = [store.head(os.path.join(raw, n.encode()), -1).decode("utf-8", "replace") for n in _IGNORE if n.encode() in names]
                except OSError as e:
                    yield pd.DataFrame([(parts, raw, "skip", f"walk error: {type(e).__name__}", [])], columns=["parts", "raw", "what", "reason", "rules"])
                    continue
                if texts:
                    rules = [*rules, {"depth": len(parts), "text": "\n".join(texts)}]
                for name, is_dir in found:
                    if is_dir and name == b".git":
                        continue
                    at = [*parts, name.decode("utf-8", "replace")]
                    if not _hidden(at, is_dir, rules):
                        out.append((at, os.path.join(raw, name), "folder" if is_dir else "file", None, rules if is_dir else []))
                for i in range(0, len(out), 10_000):
                    yield pd.DataFrame(out[i : i + 10_000], columns=["parts", "raw", "what", "reason", "rules"])

    return visit


def walk_tree(spark: SparkSession, root: str) -> DataFrame:
    """``parts, raw, what, reason`` of the regular files that no ignore file names, and of folders that can't be listed.

    Hidden files are in, ``.git`` isn't, and links aren't followed.  Runs a job for each level of folders; a
    level's folders are dealt over as many tasks as there are shuffle partitions, at most.
    """
    folders = spark.createDataFrame([([], b"", [])], "parts array<string>, raw binary, rules array<struct<depth:int,text:string>>")
    limit, n, levels = int(spark.conf.get("spark.sql.shuffle.partitions")), 1, []
    while n:
        listed = cut(folders.repartition(min(n, limit)).mapInPandas(_listing(root), _LISTED))
        levels.append(listed.filter("what <> 'folder'").drop("rules"))
        folders = listed.filter("what = 'folder'").select("parts", "raw", "rules")
        n = folders.count()
    return reduce(DataFrame.union, levels)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, their number from 0 in the order of the walk: a range sort, and a count for each of its partitions."""
    tasks = max(1, -(-rows.count() // _PER_TASK))
    rows = cut(rows.repartitionByRange(tasks, "parts", "raw").sortWithinPartitions("parts", "raw").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    first, counts = 0, []
    for row in rows.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row per task
        counts.append((row["p"], first))
        first += row["count"]
    starts = rows.sparkSession.createDataFrame(counts, "_p long, _first long")
    return rows.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("at", F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_first")


def _wanted(extensions: tuple[str, ...]) -> F.Column:
    """Whether the extension of the last part, which a leading dot doesn't start, is one of these; all are if there are none."""
    allowed = [e.lower().lstrip(".") for e in extensions]
    return F.lower(F.regexp_extract(F.element_at("parts", -1), r"(?s)[^.].*\.([^.]+)$", 1)).isin(allowed) if allowed else F.lit(True)


def read_repo(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``scan_id, seq, source, value``: two actions a file, its path and its head; files with other extensions are left out.

    The tree is walked at once, heads are read when the result is.  A file that
    can't be read has its path only; an empty tree, or one that can't be listed, gives no rows (``repo_skips`` says why).
    """
    root = str(path)
    files = _numbered(walk_tree(spark, root).filter(F.col("what") == "file").filter(_wanted(extensions)).select("parts", "raw"))
    files = files.select(F.array_join("parts", "/").alias("name"), "raw", "at")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for batch in batches:
            for i in range(0, len(batch), _HEADS):
                out = []
                for name, raw, at in batch.iloc[i : i + _HEADS].itertuples(index=False):
                    out.append((root, 2 * at, f"repo-path:{name}", name))
                    try:
                        out.append((root, 2 * at + 1, f"repo-file:{name}", store.head(raw, HEAD).decode("utf-8", "replace")))
                    except OSError:
                        pass
                yield pd.DataFrame(out, columns=["scan_id", "seq", "source", "value"])

    return files.mapInPandas(read, "scan_id string, seq long, source string, value string")


def repo_skips(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``scan_id, seq, place, reason`` of the files that the extensions leave out and the folders that can't be listed, in the order of the walk."""
    tree = walk_tree(spark, str(path)).filter((F.col("what") == "skip") | ~_wanted(extensions))
    reason = F.coalesce("reason", F.lit("extension not in the wanted ones"))
    return _numbered(tree).select(F.lit(str(path)).alias("scan_id"), F.col("at").alias("seq"), F.array_join("parts", "/").alias("place"), reason.alias("reason"))


def write_tree(files: DataFrame, root: str) -> None:
    """Rows ``name, body`` (both strings) as files below ``root``, written where the rows are."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(root)
        for batch in batches:
            for name, body in zip(batch["name"], batch["body"]):
                store.write(name.encode(), body.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "body").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def drop_tree(spark: SparkSession, root: str) -> None:
    """The tree below ``root`` goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def single_action(spark: SparkSession, action: str, kind: str = "session:Bash.input") -> DataFrame:
    """One literal, neither normalised nor rendered as a call."""
    return spark.createDataFrame([("action", 0, kind, action)], "scan_id string, seq long, source string, value string")


def literal_actions(rows: DataFrame, scan: str, column: str, kind: str = "session:Bash.input") -> DataFrame:
    """``single_action`` for each row of a table: the text of ``column`` as the only action of the scan ``scan``; nulls are none."""
    return rows.filter(F.col(column).isNotNull()).select(F.col(scan).cast("string").alias("scan_id"), F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("source"), F.col(column).alias("value"))
