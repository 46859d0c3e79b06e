"""Alignment of two tokenizers over a corpus, by a cogroup of postings.

1. Each text is encoded by both sides.  A pair of tokens is linked where their byte
   ranges overlap; where both have a token end, a group closes.
2. A task gathers its texts in blocks of about ``BLOCK`` entries: a posting
   (pair, text, multiplicity).  Postings go out by bucket of the A id, sorted by pair, in packed
   rows; each block also sends how many of its texts hold each pair.
3. These numbers, added up before and after the shuffle, are the pairs' counts; a
   second, small shuffle by A id marks those that are its highest.
4. Counts and postings of a bucket meet as two sorted streams: counts first, then
   postings, which only pass.  A bucket of many postings is dealt into stretches of
   blocks, each with a copy of its counts, so that an id of any share spreads.
5. Each posting row gives the contributions of its texts, which are summed by text.

A task holds the counts of one bucket and one row of postings; the number of
different pairs is bounded by the vocabularies, not by the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm.scratch import discard, materialize
from auditlake.llm.vocab import default_dir

#: Postings of a block, texts of a block, postings of a packed row, buckets of A ids.
BLOCK, TEXTS, ROW, BUCKETS = 1_500_000, 1 << 16, 2048, 64
#: Packed rows that a copy of a bucket's counts serves.
STRETCH = 4096
#: Bytes of texts that are aligned together.
_BYTES = 1 << 20
# Fixed value: the pattern that parts a text before the merges of side A.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes no version of Unicode has changed; texts of these alone take a quicker library for side A.
_SETTLED = re.compile("[\t\n\r -~¡-ɏ‐-„…€]*").fullmatch


def _printable() -> dict[str, int]:
    """Byte-level alphabet: bytes that print stand for themselves, others for 256, 257, ..."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both sides' encoders, and the bytes of their tokens."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        self.whole = Tokenizer.from_file(os.path.join(folder, a_file))
        self.whole.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, b_file))
        byte_of = _printable()
        with open(os.path.join(folder, a_file), encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        # Ids of this vocabulary are ranks: single bytes, then one for each merge.
        ranks = {b: i for i, b in enumerate(self.a_bytes[: 256 + len(merges)])}
        joined = all("".join(m if isinstance(m, list) else m.split(" ")) == self.whole.id_to_token(256 + i) for i, m in enumerate(merges))
        self.quick = tiktoken.Encoding("side-a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if joined and len(ranks) == 256 + len(merges) else None
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len = np.array(list(map(len, self.a_bytes)))
        self.b_len = np.array(list(map(len, self.b_bytes)))
        self.n_b = len(self.b_bytes)
        # A token with what follows it in the description of the groups.
        self.a_text = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_text = [f"{i}{end}" for i in range(self.n_b) for end in ",;"]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that is empty or that a side doesn't give back."""
        a_ids: list[list[int]] = []
        for text in texts:
            if not text:
                a_ids.append([])
            elif self.quick and _SETTLED(text):
                a_ids.append(self.quick(" " + text))
            else:
                a_ids.append(self.whole.encode(" " + text, add_special_tokens=False).ids)
        b_ids = self.pieces.encode(texts, num_threads=1) if texts else []
        for i, text in enumerate(texts):
            raw = (" " + text).encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a_ids[i])) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids[i])) != raw:
                a_ids[i], b_ids[i] = [], []
        return a_ids, b_ids

    def align(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
        """What each text has by itself, and all links: text, A id, B id.

        Texts stand behind each other in one line of bytes; their borders are ends of both sides.
        """
        a_ids, b_ids = self.encode(texts)
        n_a, n_b = np.array(list(map(len, a_ids))), np.array(list(map(len, b_ids)))
        a, b = (np.fromiter((i for ids in x for i in ids), np.int64, n.sum()) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        owner = np.repeat(np.arange(len(texts)), n_a)
        # Between two neighbouring ends of either side lies the overlap of one pair.
        ends = np.union1d(a_end, b_end)
        link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        closing = np.intersect1d(a_end, b_end, assume_unique=True)
        # Groups in order, in each the A tokens before the B tokens.
        a_group, b_group = np.searchsorted(closing, a_end), np.searchsorted(closing, b_end)
        a_before, b_before = np.searchsorted(a_group, np.arange(len(closing)), "right"), np.searchsorted(b_group, np.arange(len(closing)))
        parts = np.empty(len(a) + len(b), object)
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a)], np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
        a_names, b_names = self.a_text, self.b_text
        parts[np.arange(len(a)) + b_before[a_group]] = [a_names[i] for i in (2 * a + a_last).tolist()]
        parts[np.arange(len(b)) + a_before[b_group]] = [b_names[i] for i in (2 * b + b_last).tolist()]
        parts = parts.tolist()
        n_groups = np.bincount(owner[np.searchsorted(a_end, closing)], minlength=len(texts))
        shas, at = [], 0
        for n in (n_a + n_b).tolist():
            shas.append(hashlib.sha256("".join(parts[at : at + n])[:-1].encode()).hexdigest() if n else "")
            at += n
        text_of = owner[link_a]
        about = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(text_of, minlength=len(texts)), "groups_sha256": shas}
        return about, text_of, a[link_a], b[link_b]


@lru_cache(maxsize=2)
def aligner(folder: str, a_file: str, b_file: str) -> Aligner:
    """One aligner a worker process."""
    return Aligner(folder, a_file, b_file)


_ABOUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTED = f"kind int, block long, place int, {_ABOUT}, bucket int, pairs binary, texts binary, times binary"
_NAMES = [x.split()[0] for x in _POSTED.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), *[pa.binary()] * 3]
#: Kinds of rows: a text, the numbers of texts of a block's pairs, postings of a bucket.
_TEXT, _COUNTS, _POSTINGS = 0, 1, 2


def _rows(columns: dict[str, object], n: int) -> pa.RecordBatch:
    """A batch of ``_POSTED`` rows; columns that aren't given are null."""
    made = [pa.nulls(n, t) if (x := columns.get(name)) is None else x if isinstance(x, pa.Array) else pa.array(x, t) for name, t in zip(_NAMES, _TYPES)]
    return pa.record_batch(made, names=_NAMES)


def _cut(values: np.ndarray, edges: list[tuple[int, int]], kind: str) -> pa.Array:
    return pa.array([values[a:z].astype(kind).tobytes() for a, z in edges], pa.binary())


def _postings(block: int, n_b: int, text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's postings by bucket, and its pairs' numbers of texts."""
    bucket = pair // n_b % BUCKETS
    order = np.lexsort((text, pair, bucket))
    text, pair, times, bucket = text[order], pair[order], times[order], bucket[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    names, counts = pair[starts], np.diff(np.append(starts, len(pair)))
    for kind, of, size, columns in ((_COUNTS, bucket[starts], ROW, (("pairs", names, "<i8"), ("times", counts, "<i4"))), (_POSTINGS, bucket, ROW, (("pairs", pair, "<i8"), ("texts", text, "<i4"), ("times", times, "<i4")))):
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
        edges = [(i, min(i + size, z)) for a, z in zip(heads, [*heads[1:], len(of)]) for i in range(a, z, size)]
        for i in range(0, len(edges), 1024):
            some = edges[i : i + 1024]
            n = len(some)
            yield _rows({"kind": np.full(n, kind), "block": np.full(n, block), "bucket": of[[a for a, _ in some]]} | {name: _cut(x, some, t) for name, x, t in columns}, n)


def post(docs: DataFrame, id_col: str, text_col: str, folder: str, a_file: str, b_file: str) -> DataFrame:
    """Texts, their blocks' pair counts and postings (``_POSTED``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = aligner(folder, a_file, b_file)
        block, base, held, parts = TaskContext.get().partitionId() << 33, 0, 0, []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal block, base, held
            if held:
                yield from _postings(block, sides.n_b, *(np.concatenate(x) for x in zip(*parts)))
            block, base, held = block + 1, 0, 0
            parts.clear()

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                z, size = i, 0
                while z < len(texts) and (z == i or size < _BYTES) and z - i < 4096:
                    size += len(texts[z] or "")
                    z += 1
                about, text, a, b = sides.align([t or "" for t in texts[i:z]])
                # Texts of a part stand in no other, so multiplicities are whole here.
                key, times = np.unique((a * sides.n_b + b) * np.int64(8192) + text, return_counts=True)
                n = z - i
                yield _rows({"kind": np.full(n, _TEXT), "block": np.full(n, block), "place": np.arange(base, base + n), "doc_id": ids.slice(i, n)} | about, n)
                parts.append(((key & 8191) + base, key >> 13, times))
                base, held, i = base + n, held + len(key), z
                if held > BLOCK or base > TEXTS - 4096:
                    yield from emit()
        yield from emit()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _POSTED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pair, c`` of packed counts, equal pairs of a batch added up."""
    for batch in batches:
        if batch.num_rows:
            pair = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            count = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4")
            names, at = np.unique(pair, return_inverse=True)
            yield pa.record_batch([pa.array(names), pa.array(np.bincount(at, count, len(names)).astype(np.int64))], names=["pair", "c"])


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts sorted by bucket and pair, in packed rows; ``best``: the count if it is its A id's highest, negative otherwise."""
    for batch in batches:
        bucket, pair, count = (batch.column(i).to_numpy() for i in range(3))
        if len(bucket):
            heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            edges = list(zip(heads, [*heads[1:], len(bucket)]))
            yield pa.record_batch([pa.array(bucket[heads], pa.int32()), _cut(pair, edges, "<i8"), _cut(count, edges, "<i8")], names=["bucket", "pairs", "times"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per posting row its block, and the texts' links with a highest count and sums of counts."""
    now, pairs, counts, fresh = None, [], [], True
    known = values = np.empty(0, np.int64)
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for bucket, stretch, kind, block, p, t, m in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (bucket, stretch) != now:
                now, pairs, counts, fresh = (bucket, stretch), [], [], True
            if kind == _COUNTS:
                pairs.append(np.frombuffer(p, "<i8"))
                counts.append(np.frombuffer(t, "<i8"))
                continue
            if fresh:
                known, values, fresh = np.concatenate(pairs), np.concatenate(counts), False
                order = np.argsort(known)
                known, values = known[order], values[order]
            value = values[np.searchsorted(known, np.frombuffer(p, "<i8"))]
            times = np.frombuffer(m, "<i4").astype(np.int64)
            names, at = np.unique(np.frombuffer(t, "<i4"), return_inverse=True)
            best, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            np.add.at(best, at, np.where(value > 0, times, 0))
            np.add.at(total, at, times * np.abs(value))
            out[0].append(block)
            out[1].append(names.astype("<i4").tobytes())
            out[2].append(best.astype("<i4").tobytes())
            out[3].append(total.astype("<i8").tobytes())
        yield pa.record_batch([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "places", "best", "total"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, place, n_best, count_sum`` of sorted contributions, a block at a time."""
    now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(TEXTS, now)), pa.array(np.arange(TEXTS), pa.int32()), pa.array(best), pa.array(total)], names=["block", "place", "n_best", "count_sum"]).filter(pa.array(total > 0))

    for batch in batches:
        for block, p, b, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if block != now:
                if now is not None:
                    yield done()
                now, best, total = block, np.zeros(TEXTS, np.int64), np.zeros(TEXTS, np.int64)
            at = np.frombuffer(p, "<i4")
            best[at] += np.frombuffer(b, "<i4")
            total[at] += np.frombuffer(t, "<i8")
    if now is not None:
        yield done()


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    Side A encodes a blank and the text, side B the text, to which it adds the blank itself; strings of
    special tokens are plain text.  Texts that are null or empty, or whose tokens don't join to
    these bytes on both sides, have no tokens.  Links are all pairs of tokens whose bytes overlap; a pair's count is the number of
    rows that hold it, so a row that repeats counts each time.  ``n_best``: links whose
    count is the highest of their A id, ties included.  A text of any length is aligned whole, in about
    200 bytes of memory a token; further columns are ignored; an empty table gives no rows.
    """
    posted = materialize(post(docs, id_col, text_col, folder or default_dir(), a_file, b_file), "postings")
    sides_b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder or default_dir(), b_file)).get_piece_size()
    bucket = F.pmod(F.floor(F.col("pair") / F.lit(sides_b)), F.lit(BUCKETS)).cast("int")
    counts = posted.filter(F.col("kind") == _COUNTS).select("pairs", "times").mapInArrow(_unpacked, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    counts = materialize(counts.withColumn("a", F.floor(F.col("pair") / F.lit(sides_b))), "counts")
    # At most as many pairs an A id as side B has ids.
    top = counts.groupBy("a").agg(F.max("c").alias("top"))
    marked = counts.join(top, "a").select(bucket.alias("bucket"), "pair", F.when(F.col("c") == F.col("top"), F.col("c")).otherwise(-F.col("c")).alias("c"))
    packed = materialize(marked.repartition("bucket").sortWithinPartitions("bucket", "pair").mapInArrow(_packed_counts, "bucket int, pairs binary, times binary"), "packed")
    rows = posted.filter(F.col("kind") == _POSTINGS)
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(STRETCH)).cast("int").alias("stretches"))
    sizes = F.broadcast(materialize(sizes, "sizes"))  # a row a bucket
    lists = rows.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("block"), F.col("stretches")).cast("int").alias("stretch"), F.lit(_POSTINGS).alias("kind"), "block", "pairs", "times", "texts")
    copies = packed.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"), F.lit(_COUNTS).alias("kind"), F.lit(0).cast("long").alias("block"), "pairs", "times", F.lit(None).cast("binary").alias("texts"))
    met = copies.unionByName(lists).repartition("bucket", "stretch").sortWithinPartitions("bucket", "stretch", "kind")
    met = met.select("bucket", "stretch", "kind", "block", "pairs", F.when(F.col("kind") == _COUNTS, F.col("times")).otherwise(F.col("texts")).alias("t"), F.col("times").alias("m"))
    given = met.mapInArrow(_contributions, "block long, places binary, best binary, total binary")
    sums = given.repartition("block").sortWithinPartitions("block").mapInArrow(_sums, "block long, place int, n_best long, count_sum long")
    sums = materialize(sums, "sums")
    discard(counts, packed)
    texts = posted.filter(F.col("kind") == _TEXT).select("block", "place", *(x.split()[0] for x in _ABOUT.split(", ")))
    out = texts.join(sums.hint("merge"), ["block", "place"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
