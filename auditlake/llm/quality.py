"""Quality classifier: a factorisation machine over hashed words and structure statistics.

``score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; by the
sum-of-squares identity the pairwise part is half of
``sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2``, linear in the features of a text.

Features: every distinct word, lower-cased and hashed into ``BUCKETS`` slots,
by the slot's damped frequency; statistics of the text's structure, as numbers and by
their step on a fixed scale; and metadata of the text itself (its length and its number of
words and lines).  Labels, language, source and id are never features.

The model is fitted on the driver from at most ``max_rows`` labelled rows, a
hash sample, which is read from a file of the driver's a row at a time.  A text's words are
summed up by slot, so a row holds at most ``_SLOTS`` features, in training as in scoring, and none is left out.  Whole
texts are scored, all of them, by one pass.
"""

from __future__ import annotations

import operator
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from tempfile import TemporaryFile
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.scratch import discard, materialize

BUCKETS = 1 << 16
FACTORS = 8
_STEPS = 12
#: Features that are scored together.
_TOGETHER = 100_000
_STATS = ("upper", "digit", "space", "stop", "shout", "sign", "other", "repeat", "distinct", "top", "bare", "lines_same", "word_len", "log_chars", "log_words", "log_lines")
_SLOTS = BUCKETS + len(_STATS) * (1 + _STEPS)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Class of each UTF-16 unit: 0 letter, 1 upper, 2 digit, 3 space, 4 stop, 5 exclamation, 6 sign, 7 anything else."""
    out = np.full(1 << 16, 7, np.uint8)
    for c in range(1 << 16):
        major = unicodedata.category(chr(c))
        if major in ("Lu", "Lt"):
            out[c] = 1
        elif major[0] in "LM" or major == "Cs":
            out[c] = 0
        elif major[0] == "N":
            out[c] = 2
        elif chr(c).isspace():
            out[c] = 3
        elif major[0] == "S" or chr(c) in "#%&*@|\\/~^_":
            out[c] = 6
        elif chr(c) in ".,;:?'\"()-":
            out[c] = 4
        elif chr(c) == "!":
            out[c] = 5
    return out


def statistics(text: str, words: list[str], counts: Counter) -> np.ndarray:
    """Structure statistics, each between 0 and 1."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    kinds = np.bincount(_kinds()[units], minlength=8)
    n, m = max(1, len(units)), max(1, len(words))
    letters = max(1, int(kinds[0] + kinds[1]))
    lines = [x for x in text.split("\n") if x.strip()]
    repeat = sum(map(operator.eq, words, islice(words, 1, None))) / m
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / m
    return np.array(
        [
            kinds[1] / letters,
            kinds[2] / n,
            kinds[3] / n,
            min(1.0, kinds[4] / m),
            min(1.0, kinds[5] / m),
            min(1.0, kinds[6] / m),
            kinds[7] / n,
            repeat,
            len(counts) / m,
            max(counts.values(), default=0) / m,
            bare,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, letters / m / 20),
            min(1.0, np.log1p(len(text)) / 14),
            min(1.0, np.log1p(len(words)) / 12),
            min(1.0, np.log1p(len(lines)) / 10),
        ]
    )


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text; an empty one has its statistics only."""
    words = text.split()
    counts = Counter(words)
    stats = statistics(text, words, counts)
    hashed = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in counts), np.int64, len(counts))
    slots, place = np.unique(hashed, return_inverse=True)
    damped = np.log1p(np.bincount(place, np.fromiter(counts.values(), np.float64, len(counts)), len(slots)))
    damped /= np.sqrt((damped * damped).sum()) or 1.0
    # Fractions are spread by the square root, as most of them are small.
    root = np.sqrt(np.clip(stats, 0, 1))
    base = BUCKETS + np.arange(len(_STATS)) * (1 + _STEPS)
    step = base + 1 + np.minimum(_STEPS - 1, (root * _STEPS).astype(np.int64))
    return np.concatenate([slots, base, step]), np.concatenate([damped, root, np.ones(len(_STATS))])


class FactorisationMachine:
    """Weights and their application; ``fit`` runs AdaGrad over the rows in a seeded order."""

    def __init__(self, constant: float | None = None):
        rng = np.random.default_rng(20240601)
        self.bias, self.constant = 0.0, constant
        self.weights = np.zeros(_SLOTS, np.float32)
        self.factors = (0.01 * rng.standard_normal((_SLOTS, FACTORS))).astype(np.float32)

    def margin(self, slots: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        vx = self.factors[slots] * values[:, None]
        total = vx.sum(axis=0)
        pairs = 0.5 * float((total * total).sum() - (vx * vx).sum())
        return self.bias + float(self.weights[slots] @ values) + pairs, vx, total

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        slots, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.margin(slots, values)[0], -30, 30))))

    def score_all(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, the features of a few at a time by one sum over all of them."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, held, size = np.empty(len(texts)), [], 0
        for i, text in enumerate(texts):
            held.append(features(text))
            size += len(held[-1][0])
            if size > _TOGETHER or i + 1 == len(texts):
                slots, values = (np.concatenate(x) for x in zip(*held))
                starts = np.cumsum([0, *(len(s) for s, _ in held[:-1])])
                vx = self.factors[slots] * values[:, None]
                pairs = np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)
                margin = self.bias + np.add.reduceat(self.weights[slots] * values, starts) + 0.5 * pairs.sum(axis=1)
                out[i + 1 - len(held) : i + 1] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                held, size = [], 0
        return out

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.05, decay: float = 1e-5) -> None:
        rng = np.random.default_rng(7)
        past_w, past_v, past_b = np.full(_SLOTS, 1e-3, np.float32), np.full((_SLOTS, FACTORS), 1e-3, np.float32), 1e-3
        # Both classes weigh the same in sum, at most tenfold.
        share = min(max(float(labels.mean()), 1e-9), 1 - 1e-9)
        weight = {1: min(10.0, 0.5 / share), 0: min(10.0, 0.5 / (1 - share))}
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                slots, values = rows[i]
                margin, vx, total = self.margin(slots, values)
                g = weight[int(labels[i])] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i])
                gw = g * values + decay * self.weights[slots]
                gv = g * values[:, None] * (total - vx) + decay * self.factors[slots]
                past_b += g * g
                self.bias -= rate * g / np.sqrt(past_b)
                past_w[slots] += gw * gw
                past_v[slots] += gv * gv
                self.weights[slots] -= (rate * gw / np.sqrt(past_w[slots])).astype(np.float32)
                self.factors[slots] -= (rate * gv / np.sqrt(past_v[slots])).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> FactorisationMachine:
    """A model from at most ``max_rows`` labelled rows that aren't held out.

    Rows with a null id or a label other than 0 and 1 teach nothing.  Of an
    id's labels the smallest counts, of its texts one (that of the smallest hash), so an id
    that repeats teaches once and ``max_rows`` bounds what reaches the driver.  With
    one class only, or none, every score is that class's share, and 1 without labels.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    # The order by hash makes a uniform sample that doesn't depend on how the table is dealt out.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_rows
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for text in batch.column(0):
                s, v = features(text.as_py())
                slots.append(s.astype("<i4").tobytes())
                values.append(v.astype("<f4").tobytes())
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "quality", "slots", "values"])

    found = rows.select("text", "doc_id", "quality").mapInArrow(extract, "doc_id long, quality int, slots binary, values binary")
    found = materialize(found, "sample")
    y = np.array([r.quality for r in found.select("quality", "doc_id").orderBy("doc_id").collect()], np.int64)  # at most max_rows
    if len(set(y.tolist())) < 2:
        discard(found)
        return FactorisationMachine(float(y.mean()) if len(y) else 1.0)
    model = FactorisationMachine()
    with TemporaryFile() as store:
        model.fit(_Stored(found.orderBy("doc_id").select("slots", "values").toLocalIterator(), store), y)
    discard(found)
    return model


class _Stored:
    """Rows of features in a file of the driver's: one is in memory at a time, however long the texts were."""

    def __init__(self, rows: Iterable, store: BinaryIO):
        self.store, self.places = store, []
        for slots, values in rows:
            self.places.append((store.tell(), len(slots) // 4))
            store.write(slots)
            store.write(values)
        store.flush()

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.places[i]
        self.store.seek(at)
        return np.frombuffer(self.store.read(4 * n), "<i4"), np.frombuffer(self.store.read(4 * n), "<f4")


def score_column(spark: SparkSession, model: FactorisationMachine, text: Column) -> Column:
    """Score of a text column between 0 and 1.

    A null text is scored as empty; a text of any length whole, in memory of a few times its size.
    """
    shared = spark.sparkContext.broadcast(model)  # some megabytes at any size of the input

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        machine = shared.value
        return pd.Series(machine.score_all([t or "" for t in texts]), dtype="float64")

    return score.asNondeterministic()(text.cast("string"))  # so that it runs once a row, wherever its column is used


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` (double) and ``predicted`` (int).

    Repeated rows get the same score; null ids are rows like others; columns of the
    same names are replaced; an empty table gives no rows.
    """
    scored = docs.withColumn("score", score_column(docs.sparkSession, model, F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
