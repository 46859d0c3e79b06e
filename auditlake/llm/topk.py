"""Exact top-k inner products by pivot-table elimination.

Pivots are fitted once, by a far-point sweep over a bounded hash sample, and
vectors are packed into blocks, each with the table of distances from its
vectors to all pivots.  For a query ``q`` and a vector ``x`` every pivot ``p``
gives ``d(q, x) >= |d(q, p) - d(x, p)|``; the largest of these bounds turns
into an upper bound of the score, ``(|q|^2 + |x|^2 - bound^2) / 2``.

Every query first meets one block of candidates; its k-th score there is a bar
that goes with the query to all other blocks.  In a block candidates whose
bound lies below the bar are eliminated at once, the others are evaluated in the order
of the bound, in growing steps, until the k-th score exceeds every bound left:
then the answer of the block is exact, ties included.  Equal vectors share one
table row and are told apart by id only.

Query blocks meet candidate blocks by an equi-join on a block number, so the
work per task is one block pair; at most k rows a query leave a block pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 48
#: Vectors that pivots are chosen from.
SAMPLE = 4096
#: Candidates that are evaluated first; each step after takes twice as many.
FIRST = 16
_EXACT = float(1 << 53)  # sums of products below it are exact in doubles
_WHOLE = float(1 << 52)  # doubles from here on hold integers only
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integer_vector(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` for each component as double, in double precision."""

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < F.lit(_WHOLE), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor empty nor hold a null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _pivot_rows(x: np.ndarray, count: int) -> np.ndarray:
    """Rows that lie far from each other: each next one is the farthest from those before."""
    far = np.full(len(x), np.inf)
    rows, at = [], 0
    for _ in range(min(count, len(x))):
        rows.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
        at = int(far.argmax())
        if far[at] == 0:
            break
    return np.array(rows)


class Block:
    """Distinct vectors of a block, their distances to the pivots, and the ids that share each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.kept, inverse = np.unique(x, axis=0, return_inverse=True)
        by_row = np.argsort(inverse.reshape(-1), kind="stable")
        self.ids = ids[by_row]  # ids ascend within a vector
        self.ends = np.cumsum(np.bincount(inverse.reshape(-1), minlength=len(self.kept)))
        self.largest = float(np.abs(self.kept).max(initial=0.0))
        self.table = np.sqrt(_squares(self.kept, pivots))

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.kept.astype("<f8").tobytes(), self.table.astype("<f8").tobytes(), self.ids.astype("<i8").tobytes(), self.ends.astype("<i8").tobytes()

    @classmethod
    def unpack(cls, dim: int, kept: bytes, table: bytes, ids: bytes, ends: bytes) -> Block:
        out = cls.__new__(cls)
        out.kept, out.ids, out.ends = np.frombuffer(kept, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
        out.table = np.frombuffer(table, "<f8").reshape(len(out.kept), -1)
        out.largest = float(np.abs(out.kept).max(initial=0.0))
        return out

    def owners(self, row: int, most: int) -> list[int]:
        """The smallest ids of a vector."""
        return self.ids[self.ends[row - 1] if row else 0 : self.ends[row]][:most].tolist()


def _squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances of rows to pivots."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, bars: np.ndarray, block: Block, pivots: np.ndarray, k: int, exclude_self: bool = True) -> list[list[tuple[float, int]]]:
    """For each query its k best (-score, id) of the block, those that lie below its bar left out; ties to smaller ids.

    Vectors hold integers.  Where sums of products could leave the exact range
    of doubles, Python integers are used.
    """
    largest = max(block.largest, float(np.abs(q).max(initial=0.0)), float(np.abs(pivots).max(initial=0.0)))
    if not largest * largest * block.kept.shape[1] * 4 < _EXACT:
        return _exact_big(q_ids, q, block, k, exclude_self)
    kept = block.kept
    norms, own = (kept * kept).sum(axis=1), (q * q).sum(axis=1)
    to_pivots = np.sqrt(_squares(q, pivots))
    out = []
    for qid, v, vv, far, bar in zip(q_ids.tolist(), q, own.tolist(), to_pivots, bars.tolist()):
        nearest = np.abs(block.table - far).max(axis=1, initial=0.0)
        bound = (vv + norms - nearest * nearest) / 2
        bound += 1e-6 * (np.abs(bound) + norms + vv + 1)  # above what rounding may take away
        todo = np.flatnonzero(bound >= bar)
        todo = todo[np.argsort(-bound[todo], kind="stable")]
        best: list[tuple[float, int]] = []
        at, step = 0, FIRST
        while at < len(todo):
            if len(best) >= k:
                bar = max(bar, -best[k - 1][0])
            if bound[todo[at]] < bar:
                break
            rows = todo[at : at + step]
            scores = kept[rows] @ v
            pick = np.flatnonzero(scores >= bar)
            if len(pick) > 4 * k:
                cut = np.partition(scores[pick], len(pick) - (k + 1))[len(pick) - (k + 1)]
                pick = pick[scores[pick] >= cut]
            for j in pick.tolist():
                best += [(-float(scores[j]), i) for i in block.owners(rows[j], k + 1) if not (exclude_self and i == qid)][:k]
            best = sorted(set(best))[:k]
            at, step = at + step, 2 * step
        out.append(best)
    return out


def _exact_big(q_ids: np.ndarray, q: np.ndarray, block: Block, k: int, exclude_self: bool) -> list[list[tuple[int, int]]]:
    """The same answer by Python integers, for components too large for doubles; bars aren't needed for it."""
    whole = [[int(c) for c in row] for row in block.kept]
    out = []
    for qid, v in zip(q_ids.tolist(), q):
        ints = [int(c) for c in v]
        scored = [(-sum(a * b for a, b in zip(ints, row)), i) for at, row in enumerate(whole) for i in block.owners(at, k + 1) if not (exclude_self and i == qid)]
        out.append(sorted(set(scored))[:k])
    return out


def _as_double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    block_rows: int = 4096,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products against all rows but its own id.

    Returns ``query_id, rank, vec_id, score``.  Vectors that are null, empty or
    hold null or non-finite components, and rows without an id, take no part;
    vectors are compared with vectors of as many components; repeated
    (id, vector) rows count once; a query without candidates, or an empty
    table, gives no rows.  Scores beyond the range of a long are given as its
    nearest end, and ranked by their value as double.
    """
    spark = vectors.sparkSession
    whole = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    ints = [F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("vec")]
    rows, asked = (df.select(*ints).withColumn("dim", F.size("vec")).dropDuplicates(["id", "vec"]) for df in (whole, whole.filter(is_query)))
    # Block counts come from row counts, so block sizes stay the same as tables grow.
    n = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    cand_blocks, query_blocks = max(1, -(-n["n"] // block_rows)), max(1, -(-n["q"] // block_rows))
    sample = whole.select(*ints).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    pivots = {dim: (x := np.array(group))[_pivot_rows(x, PIVOTS)] for dim, group in by_dim.items()}
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors a length of the sample

    def pivots_of(dim: int) -> np.ndarray:
        """No pivots at all give the plain bound."""
        return shared.value.get(dim, np.empty((0, dim)))

    def pack_cand(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        packed = Block(pdf["id"].to_numpy(np.int64), x, pivots_of(x.shape[1])).pack()
        return pd.DataFrame([(key[0], x.shape[1], *packed)], columns=["cb", "dim", "kept", "table", "ids", "ends"])

    def pack_query(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        return pd.DataFrame([(key[0], x.shape[1], pdf["id"].to_numpy(np.int64).tobytes(), x.astype("<f8").tobytes())], columns=["qb", "dim", "q_ids", "q_vecs"])

    # By id and vector, so that an id with many vectors spreads.
    number = lambda blocks: F.pmod(F.xxhash64("id", "vec"), F.lit(blocks))
    cand = rows.withColumn("cb", number(cand_blocks)).groupBy("cb", "dim").applyInPandas(pack_cand, "cb long, dim int, kept binary, table binary, ids binary, ends binary")
    query = asked.withColumn("qb", number(query_blocks)).groupBy("qb", "dim").applyInPandas(pack_query, "qb long, dim int, q_ids binary, q_vecs binary")
    first = rows.withColumn("cb", number(cand_blocks)).filter("cb = 0").groupBy("cb", "dim").applyInPandas(pack_cand, "cb long, dim int, kept binary, table binary, ids binary, ends binary")

    def look(row: dict, bars: np.ndarray | None) -> tuple[np.ndarray, list]:
        ids, block = np.frombuffer(row["q_ids"], "<i8"), Block.unpack(row["dim"], *(row[c] for c in ("kept", "table", "ids", "ends")))
        bars = np.full(len(ids), -np.inf) if bars is None else bars
        return ids, block_top_k(ids, np.frombuffer(row["q_vecs"], "<f8").reshape(-1, row["dim"]), bars, block, pivots_of(row["dim"]), k)

    def set_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bars = np.array([-_as_double(best[k - 1][0]) if len(best) >= k else -np.inf for best in look(row, None)[1]])
                yield pa.record_batch([pa.array([row["qb"]], pa.int64()), pa.array([row["dim"]], pa.int32()), pa.array([bars.tobytes()], pa.binary())], names=["qb", "dim", "bars"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, found = look(row, None if row["bars"] is None else np.frombuffer(row["bars"], "<f8"))
                flat = [(qid, i, int(-s)) for qid, best in zip(ids.tolist(), found) for s, i in best]
                q, v, s = zip(*flat) if flat else ((), (), ())
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([min(max(x, _LEAST), _MOST) for x in s], pa.int64()), pa.array([_as_double(x) for x in s], pa.float64())], names=["query_id", "vec_id", "score", "wide"])

    # The first block holds about block_rows vectors, of whatever lengths, at any size of the table.
    bars = query.join(F.broadcast(first), "dim").mapInArrow(set_bars, "qb long, dim int, bars binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cand_blocks - 1).cast("long")))
    pairs = query.join(bars, ["qb", "dim"], "left").withColumn("cb", every).join(cand, ["cb", "dim"])
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long, wide double").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
