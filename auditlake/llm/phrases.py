"""Collocations: frequent phrases by vertical positional inverted lists.

1. Texts are cut into blocks of ``BLOCK`` word places.  A block's words become
   positional lists: their places in the block, ascending.  The lists of words of one
   language and one bucket of hashes share a row, so a block has a bounded number of
   rows, whatever its vocabulary.
2. The length of a list, summed over the blocks, is the exact frequency of its word
   or phrase; lists below ``min_count`` go, as no phrase with such a part can be frequent.
   Words get their numbers bucket by bucket: a bucket's frequent words come first, then
   the words of each block, without their places, stream past them.  Longer phrases
   have buckets of their own, each of which is counted and numbered in one task.
3. A frequent phrase is extended within each block: the places of its list are
   merge-joined with those of the adjacent words, one place after its end.  Only
   words that end a frequent phrase of the same length can follow, so the lists of
   these phrases serve as the adjacent words' postings.  Each pair of lists that
   meets gives the longer phrase's list in that block.
4. The last two steps repeat up to ``max_words`` words.

Pieces end at punctuation, so a place between two pieces stays empty and no
phrase runs across.  A block takes whole texts; one that is longer than a block goes on in the
next, and the block holds the first ``max_words - 1`` words after its end as well, which
extend phrases but start none.  So a task holds a block at a time, whatever a word's or
a language's share of all words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.scratch import discard, materialize

#: Word places of a block.
BLOCK = 6_000_000
#: Bytes of a text that are split at once.
_SLICE = 1 << 22
#: Buckets of a language's words; a row of lists holds those of a block's words in one.
BUCKETS = 64
#: Bits of a longer phrase's bucket: a task holds the numbers of a bucket's phrases in all blocks.
_BITS = 10
#: Rows of lists that are built at once.
_ROWS = 16
_NO_LANG = "und"
# A separator of pieces is no part of a word, so it can stand between words as a word of its own.
_BREAK = b","
_TABLE = bytearray(range(256))
_TABLE[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = ord(_BREAK)
_TABLE[ord("\t")] = ord(" ")
_TABLE = bytes(_TABLE)
_RUN = re.compile(rb",[, ]*")

LISTS = "block long, lang string, bucket int, words array<string>, n array<long>, places array<binary>"


class _Numbers(dict):
    """Word -> number, one for each new word; the break is -1."""

    def __init__(self):
        super().__init__({_BREAK: -1})
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in slices that end where a word does."""
    start = 0
    while start < len(raw):
        stop = start + _SLICE
        if stop < len(raw):
            stop = raw.find(b" ", stop)
            if stop < 0:
                stop = len(raw)
        yield raw[start:stop]
        start = stop


def split_places(text: str | None, numbers: _Numbers) -> Iterator[np.ndarray]:
    """Numbers of a text's words in order, -1 between pieces, a slice at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE) if text else b""
    for part in _slices(raw):
        yield np.fromiter(map(numbers.__getitem__, _RUN.sub(b" , ", part).split()), np.int32)


def _packed(order: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Consecutive stretches of places as binary values of little-endian 32-bit integers."""
    data = pa.py_buffer(np.ascontiguousarray(order, "<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype("<i4").tobytes()), data])


def _listed(cuts: np.ndarray, values: pa.Array) -> pa.Array:
    """Consecutive stretches of values as lists."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _block_lists(places: np.ndarray, langs: list[str], kinds: np.ndarray, names: list[list[bytes]], buckets: list[np.ndarray], block: int, owned: int) -> Iterator[pa.RecordBatch]:
    """``LISTS`` of one block: ``places`` holds word numbers of the language that ``kinds`` gives, ``buckets`` the bucket of each word."""
    at = np.flatnonzero(places >= 0)
    if not len(at):
        return
    kind, number = kinds[at].astype(np.int64), places[at]
    base = np.cumsum([0, *map(len, names)])
    key = (kind << 48) | (np.concatenate(buckets)[base[kind] + number].astype(np.int64) << 32) | number
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cuts = np.append(starts, len(key))
    n = np.add.reduceat((at < owned).astype(np.int64), starts)
    group = key[starts] >> 32
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    edges = np.append(firsts, len(starts))
    kind, number = (group >> 16).tolist(), (key[starts] & 0xFFFFFFFF).tolist()
    for i in range(0, len(firsts), _ROWS):
        some = edges[i : i + _ROWS + 1]
        a, z = some[0], some[-1]
        words = pa.array([names[k][w].decode() for k, w in zip(kind[a:z], number[a:z])], pa.string())
        rows, lists = group[some[:-1]], some - a
        yield pa.record_batch(
            [
                pa.array(np.full(len(rows), block)), pa.array([langs[k] for k in (rows >> 16).tolist()], pa.string()), pa.array((rows & 0xFFFF).astype(np.int32)),
                _listed(lists, words), _listed(lists, pa.array(n[a:z])), _listed(lists, _packed(at[cuts[a] : cuts[z]], cuts[a : z + 1] - cuts[a])),
            ],
            names=["block", "lang", "bucket", "words", "n", "places"],
        )


def word_lists(docs: DataFrame, text_col: str, lang_col: str, max_words: int, block: int) -> DataFrame:
    """Positional lists (``LISTS``) of every word of every block, a row a bucket; ``n``: how many of the places are the block's own."""
    ahead = max_words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        numbers: dict[str, tuple[int, _Numbers]] = {}
        parts: list[np.ndarray] = []
        kinds: list[int] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            places = np.concatenate(parts)
            kind = np.repeat(np.array(kinds, np.int32), [len(p) for p in parts])
            names = [x.names for _, x in numbers.values()]
            buckets = [np.fromiter((zlib.crc32(w) % BUCKETS for w in x), np.int32, len(x)) for x in names]
            for start in range(0, len(places), block):
                z = start + block + ahead
                yield from _block_lists(places[start:z], list(numbers), kind[start:z], names, buckets, number, block)
                number += 1
            for x in (numbers, parts, kinds):
                x.clear()
            held = 0

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = _NO_LANG if lang.as_py() is None else lang.as_py()
                kind, mine = numbers.setdefault(lang, (len(numbers), _Numbers()))
                for words in (*split_places(text.as_py(), mine), np.full(1, -1, np.int32)):
                    parts.append(words)
                    kinds.append(kind)
                    held += len(words)
                if held > block * 3 // 4:  # only between texts, so that no phrase is cut
                    yield from emit()
        if held:
            yield from emit()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, LISTS)


def _numbered(lists: DataFrame, level: DataFrame) -> DataFrame:
    """``block, lang, bucket, ids``: the ids of the words of each row of ``LISTS``, null where ``level`` doesn't have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, ids = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, bucket = batch.column(0), batch.column(1).to_numpy()
            rank, is_list = lang.dictionary_encode().indices.to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            new = np.diff(rank).astype(bool) | np.diff(bucket).astype(bool) | np.diff(is_list.astype(np.int8)).astype(bool)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:]):
                if (key := (lang[a].as_py(), bucket[a])) != now:
                    now, names, ids = key, [], []
                part = batch.slice(a, z - a)
                if not is_list[a]:  # they come first
                    names.append(part.column(3))
                    ids.append(part.column(4))
                    continue
                words, cuts = part.column(5).flatten(), np.append(0, np.cumsum(pc.list_value_length(part.column(5)).to_numpy()))
                if names:
                    names, ids = [pa.concat_arrays(names)], [pa.concat_arrays(ids)]
                    found = ids[0].take(pc.index_in(words, value_set=names[0]))
                else:
                    found = pa.nulls(len(words), pa.int64())
                yield pa.record_batch([part.column(2), part.column(0), part.column(1), _listed(cuts, found)], names=["block", "lang", "bucket", "ids"])

    none = F.lit(None)
    known = level.select("lang", "bucket", none.cast("long").alias("block"), F.col("phrase").alias("word"), "id", none.cast("array<string>").alias("words"))
    rows = known.union(lists.select("lang", "bucket", "block", none.cast("string"), none.cast("long"), "words"))
    rows = rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.asc_nulls_first("block"))
    return rows.mapInArrow(run, "block long, lang string, bucket int, ids array<long>")


def _frequent(held: list[pa.RecordBatch]) -> pa.Table:
    """Lists ``id, places`` of the frequent words of a block, from its rows of ids and its rows of places in the same order."""
    table = pa.Table.from_batches(held)
    ids, places = (pa.concat_arrays([x.flatten() for x in table.column(c).chunks]) for c in ("ids", "places"))
    frequent = ids.is_valid()
    return pa.table({"id": ids.filter(frequent), "places": places.filter(frequent)})


EXTENDED = "block long, bucket int, heads array<long>, tails array<long>, n array<int>, places array<binary>"


def _buckets(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Buckets of pairs of ids."""
    x = (head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tail.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _BITS)).astype(np.int64)


def extend(table: pa.Table, block: int, owned: int, placed: bool) -> Iterator[pa.RecordBatch]:
    """Lists (``EXTENDED``) of all phrases one word longer in a block, from its lists ``id, places``; null places unless ``placed``."""
    if not table.num_rows:
        return
    ids, column = table.column("id").to_numpy(), table.column("places").combine_chunks()
    cuts = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    at = np.frombuffer(column.buffers()[2], "<i4")[cuts[0] // 4 : cuts[-1] // 4]
    sizes = np.diff(cuts) // 4
    row = np.repeat(np.arange(len(ids)), sizes)
    # The merge join: in order of places, a phrase and the one that starts a place later are neighbours.
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    meet = np.flatnonzero(np.diff(at) == 1)
    if not len(meet):
        return
    at, pair = at[meet], row[meet] * np.int64(len(ids)) + row[meet + 1]
    # A block has fewer lists than 2 ** 24, so pairs leave room for the bucket.
    key = (_buckets(ids[row[meet]], ids[row[meet + 1]]) << 48) | pair
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    cuts = np.append(starts, len(key))
    n = np.add.reduceat((at < owned).astype(np.int32), starts)
    bucket, pair = key[starts] >> 48, key[starts] & ((1 << 48) - 1)
    head, tail = ids[pair // len(ids)], ids[pair % len(ids)]
    firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    edges = np.append(firsts, len(starts))
    for i in range(0, len(firsts), 4 * _ROWS):
        some = edges[i : i + 4 * _ROWS + 1]
        a, z = some[0], some[-1]
        lists, size = some - a, len(some) - 1
        places = _listed(lists, _packed(at[cuts[a] : cuts[z]], cuts[a : z + 1] - cuts[a])) if placed else pa.nulls(size, pa.list_(pa.binary()))
        yield pa.record_batch(
            [pa.array(np.full(size, block)), pa.array(bucket[some[:-1]].astype(np.int32)), _listed(lists, pa.array(head[a:z])), _listed(lists, pa.array(tail[a:z])), _listed(lists, pa.array(n[a:z].astype(np.int32))), places],
            names=["block", "bucket", "heads", "tails", "n", "places"],
        )


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each value of the first column of sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, z in zip(edges[:-1], edges[1:]):
            if z > a:
                if held and values[a] != now:
                    yield now, held
                    held = []
                now = int(values[a])
                held.append(batch.slice(a, z - a))
    if held:
        yield now, held


def _longer(lists: DataFrame, owned: int, order: tuple[str, ...], placed: bool) -> DataFrame:
    """Lists of phrases one word longer (``EXTENDED``), block by block, from rows ``block, ids, places`` in pairs that agree in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _together(batches):
            yield from extend(_frequent(held), block, owned, placed)

    return lists.repartition("block").sortWithinPartitions("block", *order).mapInArrow(run, EXTENDED)


COUNTED = "head long, tail long, a long, id long, block long, bucket int, ids array<long>"


def _counted(longer: DataFrame, min_count: int, numbered: bool) -> DataFrame:
    """``head, tail, a, id`` of the frequent phrases of ``EXTENDED`` and, if ``numbered``, ``block, bucket, ids`` for each of its rows, null ids for rare phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _together(batches):
            blocks = np.concatenate([x.column(1).to_numpy() for x in held])
            sizes = np.concatenate([pc.list_value_length(x.column(2)).to_numpy() for x in held])
            head, tail, n = (np.concatenate([x.column(i).flatten().to_numpy() for x in held]) for i in (2, 3, 4))
            held.clear()
            order = np.lexsort((tail, head))
            head, tail = head[order], tail[order]
            starts = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
            a = np.add.reduceat(n[order].astype(np.int64), starts)
            often = a >= min_count
            found = np.where(often, (bucket << 32) + np.cumsum(often) - 1, -1)
            some, size = starts[often], int(often.sum())
            yield pa.record_batch([pa.array(x) for x in (head[some], tail[some], a[often], found[often])] + [pa.nulls(size, t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int64()))], names=[x.split()[0] for x in COUNTED.split(", ")])
            if numbered:
                ids = np.empty(len(head), np.int64)
                ids[order] = np.repeat(found, np.diff(np.append(starts, len(head))))
                cuts = np.append(0, np.cumsum(sizes))
                for i in range(0, len(blocks), 256):
                    some = cuts[i : i + 257]
                    mine, size = ids[some[0] : some[-1]], len(some) - 1
                    rows = [pa.array(blocks[i : i + 256]), pa.array(np.full(size, bucket, np.int32)), _listed(some - some[0], pa.array(mine, mask=mine < 0))]
                    yield pa.record_batch([pa.nulls(size, pa.int64())] * 4 + rows, names=[x.split()[0] for x in COUNTED.split(", ")])

    rows = longer.select("bucket", "block", "heads", "tails", "n")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, COUNTED)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Exact frequencies of all words and of all phrases of up to ``max_words`` words that occur ``min_count`` times.

    Returns the number of words of each language (``lang, n``), a table for each
    length from 1 on, and the scratch tables below them.  A table has ``id, lang, phrase, a``
    (its frequency), ``heads`` and ``tails`` (frequencies of its first and of its last 1, 2, ... words),
    and, from 2 words on, ``head, tail`` (ids of the phrase without its last and without its first word).
    """
    lists = materialize(word_lists(docs, text_col, lang_col, max_words, block), "word-lists")
    each = lists.select("lang", "bucket", F.explode(F.arrays_zip("words", "n")).alias("e"))
    counts = materialize(each.groupBy("lang", "bucket", F.col("e.words").alias("word")).agg(F.sum("e.n").alias("a")), "words")
    total = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    level = counts.filter(F.col("a") >= min_count).select(F.monotonically_increasing_id().alias("id"), "lang", "bucket", F.col("word").alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    levels = [materialize(level, "phrases-1")]
    used = [counts]
    none = F.lit(None).cast("array<binary>").alias("places")
    numbers = _numbered(lists, levels[0])
    for length in range(2, max_words + 1):
        order = ("lang", "bucket") if length == 2 else ("bucket",)
        rows = numbers.select("block", *order, "ids", none).union(lists.select("block", *order, F.lit(None).cast("array<long>"), "places"))
        longer = materialize(_longer(rows, block, order, length < max_words), f"lists-{length}")
        discard(lists)
        lists, old = longer, levels[-1]
        made = materialize(_counted(longer, min_count, length < max_words), f"found-{length}")
        found, numbers = made.filter("id IS NOT NULL"), made.filter("id IS NULL")
        used.append(made)
        first = old.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"), "heads")
        last = old.select(F.col("id").alias("tail"), F.col("phrase").alias("last"), "tails")
        level = found.select("head", "tail", "a", "id").join(first.hint("merge"), "head").join(last.hint("merge"), "tail")
        phrase = F.concat_ws(" ", "first", F.substring_index("last", " ", -1))
        level = level.select("id", "lang", phrase.alias("phrase"), "a", F.array_append("heads", F.col("a")).alias("heads"), F.array_append("tails", F.col("a")).alias("tails"), "head", "tail")
        levels.append(materialize(level, f"phrases-{length}"))
    discard(lists)
    return total, levels, used


def cut_score(k: int, length: int) -> Column:
    """Score of a phrase cut after ``k`` words, rounded down; exact, as products may pass 64 bits."""
    whole = "AS DECIMAL(20,0))"
    return F.expr(f"CAST(2000000 AS DECIMAL(7,0)) * CAST(a {whole} DIV (CAST(heads[{k - 1}] {whole} + CAST(tails[{length - k - 1}] {whole})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score.

    A phrase of 2 to ``max_words`` words with ``a >= min_count`` occurrences is cut
    into two parts of frequencies ``l`` and ``r``; the score is ``2000000 * a / (l + r)``, rounded down, of the cut
    where it is lowest, the first of equal ones.  A phrase that stands inside a longer one
    goes if that has at least 80 % of its occurrences.  Ties in score go by ``a``, then by the
    phrase's bytes.  A null language is ``und``, a null or empty text has no words, a
    text of any length counts whole, rows that repeat count each time, an empty table gives
    no rows, further columns are ignored.
    """
    total, levels, used = frequent_phrases(docs, text_col, lang_col, min_count, max_words)
    whole = "decimal(20,0)"
    found = []
    for length, level in enumerate(levels[1:], 2):
        cuts = []
        for k in range(1, length):
            cuts.append(F.struct(cut_score(k, length).alias("score"), F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.lit(length - k - 1)).alias("r")))
        scored = level.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        if length <= max_words - 1:
            # A phrase two words longer is no more frequent than those between, so the next length is enough.
            around = levels[length].select(F.explode(F.array("head", "tail")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            scored = scored.join(around.hint("merge"), "id", "left").filter(F.col("b").isNull() | (F.lit(100) * F.col("b").cast(whole) < F.lit(80) * F.col("a").cast(whole)))
        found.append(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = rows.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(total.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
