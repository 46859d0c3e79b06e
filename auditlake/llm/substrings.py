"""Substring deduplication over a log-structured fingerprint index.

*Window hash.*  A window of ``window`` words is indexed under the smallest hash
of its ``GRAM``-word runs.  Equal windows have equal hashes, and neighbours
mostly share theirs, so a text of n words posts about ``n / 12`` hashes and no
window is left out.

*Index.*  Each batch of documents becomes an immutable run, bucketed and sorted
by hash: ``fp, n`` (places that post it).  A new run is merge-joined with those
before it; hashes that a run repeats or that two runs share are candidates.
Runs are compacted into one when ``FAN_IN`` of them have gathered.  The index
is a folder: a later job opens it and adds its batch (``dedup_batch``).

*Verification.*  Windows under candidate hashes are compared by a second,
independent 64-bit hash of all their words, 128 bits with the first.

Documents with equal word sequences are one class: a class of two or more
repeats every window it has, and one member stands for it in the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.scratch import cleaned_up, delete_folder, discard, materialize, register, release, scratch_root
from auditlake.llm.words import run_hashes, split_words, word_hashes

GRAM = 12
FAN_IN = 3


class FingerprintIndex:
    """Sorted immutable runs of window hashes (``fp, n``) in a folder; ``add`` returns what a new run repeats.

    Runs are bucketed by hash, each bucket sorted, so history is merge-joined
    where it lies and isn't shuffled again.  A manifest names the runs; it is
    written after a run and before old ones go, so a job that ends midway
    leaves the index as it was.  Without a folder the index is a scratch table of this process.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.version, self.compactions = spark, fan_in, 0, 0
        self.folder = folder.rstrip("/") if folder else f"{scratch_root(spark)}/auditlake-index-{uuid.uuid4().hex}"
        if folder is None:
            register(self.folder, spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier job left in a folder."""
        state = spark.read.json(f"{folder.rstrip('/')}/manifest-*", schema="version int, fan_in int, buckets int, runs array<string>").orderBy(F.desc("version")).first()
        index = cls(spark, folder, state["fan_in"], state["buckets"])
        index.version, index.runs = state["version"], list(state["runs"])
        return index

    def _table(self, run: str) -> DataFrame:
        if run not in self.tables:
            self.tables[run] = f"auditlake_{run}_{uuid.uuid4().hex[:8]}"
            self.spark.sql(f"CREATE TABLE {self.tables[run]} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame) -> str:
        """Rows of ``fp, n``, one for each hash, as a run."""
        run = f"run_{uuid.uuid4().hex}"
        self.tables[run] = f"auditlake_{run}"
        with cleaned_up(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.folder}/{run}").saveAsTable(self.tables[run])
        return run

    def _commit(self, runs: list[str]) -> None:
        old, self.runs = set(self.runs) - set(runs), runs
        self.version += 1
        state = self.spark.createDataFrame([(self.version, self.fan_in, self.buckets, runs)], "version int, fan_in int, buckets int, runs array<string>")
        state.coalesce(1).write.json(f"{self.folder}/manifest-{self.version:08d}")
        for run in old:
            self._drop(run)
            delete_folder(self.spark, f"{self.folder}/{run}")
        delete_folder(self.spark, f"{self.folder}/manifest-{self.version - 1:08d}")

    def _drop(self, run: str) -> None:
        if run in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")  # the catalogue's entry; files stay

    def close(self) -> None:
        """Take the index's entries out of the catalogue; its folder stays."""
        for run in list(self.tables):
            self._drop(run)

    def add(self, posted: DataFrame) -> DataFrame:
        """Append the hashes (column ``fp``) of a batch as a run; returns those (``fp``) that repeat in it or that history has."""
        run = self._write(posted.groupBy("fp").agg(F.count("*").alias("n")))
        new = self._table(run)
        found = [new.filter("n > 1").select("fp")]
        found += [new.join(self._table(old).hint("merge"), "fp").select("fp") for old in self.runs]
        repeated = materialize(reduce(DataFrame.union, found).distinct(), "repeated")
        self._commit([*self.runs, run])
        if len(self.runs) >= self.fan_in:
            self.compact()
        return repeated

    def compact(self) -> None:
        """Merge all runs into one."""
        merged = reduce(DataFrame.union, [self._table(r) for r in self.runs]).groupBy("fp").agg(F.sum("n").alias("n"))
        self._commit([self._write(merged)])
        self.compactions += 1


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window start the position of its anchor, the first of its runs with the smallest hash."""
    grams = run_hashes(hashes, min(GRAM, window), 0)
    width = window - min(GRAM, window) + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Sliding minimum by doubling: each entry is the position of the least hash of the next 2^k.
    best, span = np.arange(len(grams)), 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(grams[b] < grams[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(grams[b] < grams[a], b, a)


DOCS = "doc_id long, n_words long, seq_hi long, seq_lo long, sha string, anchors array<long>"


def describe(docs: DataFrame, window: int) -> DataFrame:
    """Per row of ``doc_id, text``: words, hash of the word sequence, digest of all words, and the window hashes it posts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                words = split_words(text.as_py())
                hashes = word_hashes(words)
                seq = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8")
                anchors = window_anchors(hashes, window)
                grams = run_hashes(hashes, min(GRAM, window), 0)
                out[0].append(len(words))
                out[1].append(int(seq[0]))
                out[2].append(int(seq[1]))
                out[3].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out[4].append(grams[np.unique(anchors)].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds)), batch.column(2)], names=["doc_id", "n_words", "seq_hi", "seq_lo", "sha", "anchors", "th"])

    return docs.mapInArrow(run, DOCS + ", th long")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, th, fp, first, hashes``: the windows of each anchor whose hash is in ``fps``, by their full hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                hashes = word_hashes(split_words(batch.column(2)[i].as_py()))
                anchors = window_anchors(hashes, window)
                if not len(anchors):
                    continue
                grams = run_hashes(hashes, min(GRAM, window), 0)
                full = run_hashes(hashes, window, 1).view(np.int64)
                starts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
                stops = np.append(starts[1:], len(anchors))
                fps = grams[anchors[starts]].view(np.int64)
                wanted = np.isin(fps, batch.column(3)[i].values.to_numpy())
                for a, z, fp in zip(starts[wanted].tolist(), stops[wanted].tolist(), fps[wanted].tolist()):
                    rows[0].append(i)
                    rows[1].append(fp)
                    rows[2].append(a)
                    rows[3].append(full[a:z])
            at = pa.array(rows[0], pa.int32())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int64()))], names=["doc_id", "th", "fp", "first", "hashes"])

    return texts.select("doc_id", "th", "text", "fps").mapInArrow(run, "doc_id long, th long, fp long, first int, hashes array<long>")


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """True for each of ``n`` words that a window from one of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, th, n_removed, kept_sha256, kept`` of texts with the ``starts`` of their repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, kept = [], [], []
            for text, starts in zip(batch.column(2), batch.column(3)):
                words = split_words(text.as_py())
                gone = covered(starts.values.to_numpy(), len(words), window)
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "th", "n_removed", "kept_sha256", "kept"])

    return texts.select("doc_id", "th", "text", "starts").mapInArrow(run, "doc_id long, th long, n_removed long, kept_sha256 string, kept string")


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, batches: int = 4, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Which rows lose words, and what is left of those that keep some.

    The rows go into ``index`` as one batch, windows that ``history`` (the rows
    of its earlier batches) holds count as repeated; or, without an index, into a new one
    in ``batches`` batches, more than ``FAN_IN``, so that it compacts on the way.

    Returns two tables, and the scratch tables that they stand on.  *rows*, one per row of ``docs``: ``doc_id, th, n_words,
    n_removed, kept_sha256`` (``th``: ``xxhash64`` of the text, null as empty).
    *cuts*, one per distinct (``doc_id``, text) that loses a part of its words:
    ``doc_id, th, kept`` (its other words, joined by one space).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", _text_key())
    about = materialize(describe(rows, window), "words")
    classes = about.filter(F.col("n_words") >= window).groupBy("seq_hi", "seq_lo").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "anchors")).alias("r"))
    classes = materialize(classes.select("seq_hi", "seq_lo", "copies", "r.doc_id", "r.th", "r.anchors"), "classes")

    if index is not None:
        repeated = index.add(classes.select(F.explode("anchors").alias("fp")))
    else:
        scratch, found = FingerprintIndex(docs.sparkSession), []
        for i in range(batches):
            part = classes.filter(F.pmod(F.xxhash64("seq_hi", "seq_lo"), F.lit(batches)) == i)
            found.append(scratch.add(part.select(F.explode("anchors").alias("fp"))))
        scratch.close()
        repeated = materialize(reduce(DataFrame.union, found).distinct(), "repeated")
        discard(*found)
        release(scratch.folder)

    single = classes.filter("copies = 1")

    def posting(classes: DataFrame, rows: DataFrame) -> DataFrame:
        """Texts that post a repeated hash, with these hashes."""
        # Both sides are written tables, so that adaptive execution can split a hash that many texts post.
        hit = classes.select("doc_id", "th", F.explode("anchors").alias("fp")).join(repeated, "fp").groupBy("doc_id", "th").agg(F.collect_set("fp").alias("fps"))  # at most a text's own
        hit = materialize(hit, "hit")
        out = materialize(_join_key(rows, hit, "inner").dropDuplicates(["doc_id", "th"]), "texts")
        discard(hit)
        return out

    texts = posting(classes, rows)
    windows = materialize(_windows(texts, window), "windows")
    each = windows.select("doc_id", "th", "fp", F.posexplode("hashes").alias("i", "h"), "first")
    counted = windows.select("fp", "hashes")
    if history is not None:
        past = history.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", _text_key())
        old = posting(materialize(describe(past, window).select("doc_id", "th", "anchors"), "words"), past)
        counted = counted.union(_windows(old, window).select("fp", "hashes"))
    discard(repeated)
    twice = materialize(counted.select("fp", F.explode("hashes").alias("h")).groupBy("fp", "h").agg(F.count("*").alias("c")).filter("c > 1").select("fp", "h"), "twice")
    starts = each.join(twice, ["fp", "h"]).groupBy("doc_id", "th").agg(F.collect_list(F.col("first") + F.col("i")).alias("starts"))  # at most a text's own
    starts = _join_key(starts, single.select("doc_id", "th"), "left_semi")
    starts = materialize(starts, "starts")
    discard(windows, twice)
    cuts = materialize(_cut(_join_key(texts.select("doc_id", "th", "text"), starts, "inner"), window), "cuts")

    discard(texts, starts)
    copies = classes.filter("copies > 1").select("seq_hi", "seq_lo", F.lit(True).alias("copied"))
    whole = about.drop("anchors").join(copies, ["seq_hi", "seq_lo"], "left")
    out = _join_key(whole, cuts.drop("kept"), "left")
    copied = F.col("copied").isNotNull()
    out = out.select(
        "doc_id",
        "th",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return out, cuts.select("doc_id", "th", "kept"), [about, classes, cuts]


def _join_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, th), null ids equal; columns of ``left``, then what ``right`` adds."""
    mark = F.col("doc_id").isNull()
    l = left.withColumn("_k", F.coalesce("doc_id", F.lit(0))).withColumn("_n", mark)
    r = right.withColumn("_k", F.coalesce("doc_id", F.lit(0))).withColumn("_n", mark).drop("doc_id")
    return l.join(r, ["_k", "_n", "th"], how).drop("_k", "_n")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    Words are runs of bytes other than ASCII white space, unchanged.  A word
    goes if a window of ``window`` words that covers it starts anywhere else as
    well, in this text or another.  Null, empty and short texts lose nothing; rows that
    repeat lose all of their words, if they have a window; null ids are rows
    like others; further columns are ignored; an empty table gives no rows.  A text of any
    length is read whole, with about 100 bytes of memory a word.
    """
    return repeated_windows(docs, id_col, text_col, window)[0].drop("th")


def dedup_batch(docs: DataFrame, index: FingerprintIndex, history: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """As ``dedup_substrings`` for a new batch: windows that ``history`` or the rest of the batch holds go from the batch.

    ``history`` is what the index has taken in before, as it was; the batch is added to the index.
    Of history only the texts that post a hash of the batch are compared.
    """
    return repeated_windows(docs, id_col, text_col, window, index=index, history=history)[0].drop("th")


def _quoted(name: str) -> str:
    """A column's name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with each text cut to its other words; texts that lose nothing stay as they are.

    ``docs`` has ``doc_id`` and ``text``; ``n_chars``, if there, is counted anew
    where a text changed.  A text that loses all of its words becomes empty.  Texts of
    any length are cut whole; further columns stay as they are, whatever their names.
    """
    rows, cuts, used = repeated_windows(docs, window=window)
    change = rows.filter("n_removed > 0").select("doc_id", "th", (F.col("n_removed") == F.col("n_words")).alias("_all")).dropDuplicates(["doc_id", "th"])
    change = materialize(_join_key(change, cuts, "left").select("doc_id", "th", F.when(F.col("_all"), F.lit("")).otherwise(F.col("kept")).alias("_kept")), "change")
    discard(*used)
    # The input goes along as one struct, so that no name of its columns can meet one of these.
    wrapped = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _join_key(wrapped.withColumn("th", _text_key()), change, "left")
    kept = F.col("_kept")
    new = {"text": kept.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    own = {c: F.col("row").getField(c) for c in docs.columns}
    return out.select(*((F.when(kept.isNotNull(), new[c]).otherwise(own[c]) if c in new else own[c]).alias(c) for c in docs.columns))
