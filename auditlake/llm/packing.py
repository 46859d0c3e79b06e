"""Best-fit packing by sum of squares.

Documents become token sequences; only those longer than a sequence are cut.
Full pieces are sequences of their own, so at most one piece of a document is
left to place.  Rows are dealt into groups of about ``group_docs`` documents by
a number of their own, so copies spread as well, and each group is packed on its own: an item of length ``s`` goes
to the open bin whose choice leaves the smallest sum over all residual gaps
``g`` of ``(bins with gap g) ** 2``, and opens a new bin only if no open bin
fits.  Items are taken by falling length.  A group wastes about one sequence,
so the count stays within some hundredths of a per cent of the lower bound at
any size, and a task holds lengths and checksums only, never texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.scratch import materialize
from auditlake.llm.vocab import default_dir, word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, seq_len: int, end_id: int) -> DataFrame:
    """Per row: ``n_ids`` and the checksums of its pieces of ``seq_len`` ids.  Null text: only the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = word_bpe(tokenizer), int(end_id).to_bytes(4, "little"), 4 * seq_len
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n_ids", "crcs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_ids long, crcs array<long>")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.  Lengths lie in 1..capacity.

    Ties in the cost go to the smallest gap, and among bins of one gap to the
    one that was touched last.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins per residual gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # From gap g to g - s the sum of squares changes by 2 * (count[g - s] - count[g]) + 2; a bin that gets full leaves it.
        cost = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        cost[0] = 1 - 2 * count[s]
        cost[count[s:] == 0] = never
        left = int(cost.argmin())
        gap = left + s
        if count[gap]:
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, left = opened, capacity, capacity - s
            opened += 1
        place[i], offset[i] = b, capacity - gap
        if left:
            bins[left].append(b)
            count[left] += 1
    return place, offset, opened


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    seq_len: int = 2048,
    end_id: int = 0,
    group_docs: int = 4096,
) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``seq_len`` tokens.

    Returns one row per piece (``PIECES``).  ``sequence_id`` is unique per
    sequence: the group in the high bits.  Null ids and repeated rows are kept
    as rows like any other; a null or empty text is the end id alone; an empty
    table gives no rows; further columns are ignored.  A text is encoded whole,
    however long; of its pieces only the checksums are kept.
    """
    path = tokenizer or f"{default_dir()}/word_bpe_49k.json"
    # Lengths and checksums, a few dozen bytes a document, are written once: row numbers of
    # the written table stay the same when a task is run again, and no text is encoded twice.
    rows = materialize(token_pieces(docs, id_col, text_col, path, seq_len, end_id), "lengths")
    groups = max(1, -(-rows.count() // group_docs))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_ids", "descending"), ("doc_id", "ascending")])
        n_ids = table.column("n_ids").to_numpy()
        counts = -(-n_ids // seq_len)
        row = np.repeat(np.arange(len(n_ids)), counts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.minimum(seq_len, n_ids[row] - piece * seq_len)
        bins, offset, opened = sum_of_squares(length[length < seq_len], seq_len)
        seq, off = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        seq[length < seq_len], off[length < seq_len] = bins, offset
        full = length == seq_len
        seq[full] = opened + np.arange(int(full.sum()))
        crcs = pa.chunked_array([c.flatten() for c in table.column("crcs").chunks], pa.int64())
        cols = [table.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * seq_len), pa.array(length), crcs, pa.array((key[0].as_py() << 32) + seq), pa.array(off)]
        return pa.table(cols, names=[c.split()[0] for c in PIECES.split(", ")])

    return dealt.groupBy("grp").applyInArrow(pack, PIECES)
