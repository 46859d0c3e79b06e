"""Records of JSON documents of any size, found by brackets over byte ranges.

A document is read in pieces that end with ``}``, by as many tasks as it has ranges.

1. Each range is scanned without knowing what stands before it, once as if it began outside of a string
   and once as if inside.  All that is kept are the brackets that it closes beyond its
   start and those that it leaves open, with the keys of the lists.
2. These summaries, a row a range, are put together in order: so each range gets what is open
   where it starts.  A document that doesn't close, or closes more than once, is none.
3. The ranges are scanned again, each with its start, and the records of the
   lists asked for leave as text.  A record that runs over ranges is put together from their parts.

No task holds more than a record and the pieces of a batch.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+("?)|[][{}:]', re.S)
_STRING = re.compile(rb'(?:[^"\\]++|\\.)*+("?)', re.S)
_OPENS = {b"{": b"}", b"[": b"]"}


class Scanner:
    """Brackets of a text that comes in pieces.

    ``stack`` holds the open ones as (bracket, key, where): ``where`` is the range it was opened in. Closing brackets
    of what stood open before the first piece are in ``closed``; ``zeros`` counts how often the lowest level was
    reached, ``seen`` has the lists named by ``roots`` with their levels.
    """

    def __init__(self, inside: bool = False, stack: list[tuple] | None = None, where: int = 0, roots: frozenset[str] = frozenset()):
        self.inside, self.stack, self.where, self.roots = inside, list(stack or []), where, roots
        self.seen: set[tuple[str, int]] = set()
        self.closed, self.zeros, self.sound = "", 0, True
        self.key: str | None = None

    def tokens(self, piece: bytes) -> Iterator[tuple[bytes, int]]:
        """Brackets of a piece with where they end, after the stack has taken them."""
        at, last = 0, None
        if self.inside:
            found = _STRING.match(piece)
            at = found.end()
            if not found[1]:
                return
            self.inside = False  # the string began earlier, so it names nothing
        for found in _TOKEN.finditer(piece, at):
            token = found[0]
            if token[:1] == b'"':
                self.inside = not found[1]
                last = token[1:-1]
            elif token == b":":
                self.key = last.decode("utf-8", "replace") if last is not None and len(last) < 64 else None
            else:
                if token in _OPENS:
                    self.stack.append((token.decode(), self.key, self.where))
                    if token == b"[" and self.key in self.roots:
                        self.seen.add((self.key, len(self.stack) - len(self.closed)))
                elif self.stack:
                    self.sound &= _OPENS[self.stack.pop()[0].encode()] == token
                    self.zeros += not self.stack
                else:
                    self.closed += token.decode()
                    self.zeros = 1
                self.key = last = None
                yield token, found.end()


def _summary(scanner: Scanner) -> list:
    return [scanner.closed, scanner.stack, scanner.inside, scanner.zeros, scanner.sound, sorted(scanner.seen)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, str, int, int, bytes]]:
    """(is it the last of its range, path, start, size of the file, piece); ranges come whole and in order."""
    held = None
    for batch in batches:
        for path, start, size, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if held is not None:
                yield held[:2] != (path, start), *held
            held = (path, start, size, piece)
    if held is not None:
        yield True, *held


def _lead(piece: bytes) -> bytes:
    """What stands before a piece's first token, up to some bytes."""
    return re.split(rb'["\[\]{}:]', piece, maxsplit=1)[0].removeprefix(b"\xef\xbb\xbf").strip()[:64]


def _summaries(roots: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per range how many bytes it has, its summaries up to the last piece, and that piece, which may lack its ``}``."""
        both, n, lead = None, 0, b""
        for last, path, start, size, piece in _ranges(batches):
            if both is None:
                both, n, lead = [Scanner(inside, where=start, roots=roots) for inside in (False, True)], 0, _lead(piece)
            n += len(piece) + 1
            if not last:
                for scanner in both:
                    for _ in scanner.tokens(piece + b"}"):
                        pass
                continue
            made = json.dumps([*map(_summary, both), not lead])
            both = None
            yield pa.record_batch([pa.array([path]), pa.array([start]), pa.array([size]), pa.array([n]), pa.array([made]), pa.array([piece], pa.binary())], names=["path", "start", "size", "n", "made", "piece"])

    return run


def _starts(roots: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per range, in order by file: what is open where it starts, and whether its last piece lacks the ``}``.

        The file's last row says whether the file is one document (``whole``), and whether that has one of the ``roots`` (``known``).
        """
        state, path, total, zeros, known = Scanner(roots=roots), None, 0, 0, False

        def step(row: tuple, final: bool) -> tuple:
            nonlocal state, path, total, zeros, known
            if path != row[0]:
                state, path, total, zeros, known = Scanner(roots=roots), row[0], 0, 0, False
                state.sound = json.loads(row[4])[2]
            _, start, size, n, made, piece = row
            begins = json.dumps([state.inside, state.stack])
            closed, opened, inside, hits, sound, seen = json.loads(made)[state.inside]
            total += n
            zeros += hits if len(closed) == len(state.stack) else 0
            known |= any(len(state.stack) + level == 2 for _, level in seen)
            state.sound &= sound and len(closed) <= len(state.stack)
            for c in closed[: len(state.stack)]:
                state.sound &= _OPENS[state.stack.pop()[0].encode()].decode() == c
            state.stack += [tuple(x) for x in opened]
            state.inside, state.where, state.seen = inside, start, set()
            cut, end = final and total == size + 1, 0
            for token, end in state.tokens(piece + (b"" if cut else b"}")):
                zeros += not state.stack and token not in _OPENS
            known |= any(level == 2 for _, level in state.seen)
            rest = not piece[end:].strip() if cut else True
            whole = final and state.sound and not state.closed and not state.stack and not state.inside and zeros == 1 and rest
            return path, start, begins, cut, whole, known

        def done(some: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=["path", "start", "begins", "cut", "whole", "known"])

        held, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held is not None:
                    rows.append(step(held, held[0] != row[0]))
                held = row
                if len(rows) >= 1000:
                    yield done(rows)
                    rows = []
        if held is not None:
            rows.append(step(held, True))
        if rows:
            yield done(rows)

    return run


def _names(stack: list[tuple]) -> tuple:
    return tuple(key if bracket == "[" else None for bracket, key, _ in stack)


def _emitter(lists: dict[str, tuple[str, ...]]):
    """Records by range; ``lists``: kind -> keys of the nested lists whose objects are records."""
    paths = {tuple(x for key in keys for x in (None, key)) + (None,): kind for kind, keys in lists.items()}
    (depth,) = {len(p) for p in paths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, scanner, cut = None, None, False
        n: Counter[str] = Counter()  # records of each kind that began in the range
        kind, parts, since, held, passed = None, [], 0, None, False

        def emit(text: bytes, open_: bool) -> None:
            out.append((now[0], kind, since, now[1], n[kind] if since == now[1] else -1, open_ or since != now[1], text))
            n[kind] += since == now[1]

        def feed(piece: bytes) -> None:
            nonlocal kind, parts, since
            at = 0
            for token, end in scanner.tokens(piece):
                if token in _OPENS:
                    if kind is None and token == b"{" and len(scanner.stack) == depth and (found := paths.get(_names(scanner.stack))):
                        kind, parts, since, at = found, [], scanner.where, end - 1
                elif kind is not None and len(scanner.stack) == depth - 1:
                    emit(b"".join([*parts, piece[at:end]]), False)
                    kind = None
            if kind is not None:
                parts.append(piece[at:])

        def finish() -> None:
            if held is not None:
                feed(held + (b"" if cut else b"}"))
            if kind is not None:
                emit(b"".join(parts), True)

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["path", "kind", "since", "start", "i", "part", "text"])
            out.clear()
            return made

        for batch in batches:
            for path, start, begins, lacks, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if begins is not None:
                    finish()
                    inside, stack = json.loads(begins or "[false, []]")
                    stack = [tuple(x) for x in stack]
                    now, cut, held, parts = (path, start), lacks, None, []
                    n.clear()
                    scanner = Scanner(inside, stack, start)
                    kind = paths.get(_names(stack[:depth])) if len(stack) >= depth else None
                    since = stack[depth - 1][2] if kind else 0
                    passed = not begins
                    continue
                if passed:
                    continue
                if held is not None:
                    feed(held + b"}")
                held = piece
            if len(out) > 500 or sum(len(x[-1]) for x in out[-20:]) > 1 << 22:
                yield flush()
        finish()
        if out:
            yield flush()

    return run


def split_records(pieces: DataFrame, lists: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Records of documents, and which files are one document each.

    ``pieces``: ``path, start, size`` (of the file)``, n`` (order in the range)``, piece`` (binary, without the ``}`` that ended it), ranges in order of their
    pieces.  ``lists``: kind of record -> keys of the nested lists that hold it.  Returns ``path, kind, i`` (place among the
    file's records of that kind)``, text``, and ``path`` of each file that is one JSON document, with ``known``: whether it has
    one of the outermost lists.
    """
    roots = frozenset(keys[0] for keys in lists.values())
    sums = pieces.select("path", "start", "size", "piece").mapInArrow(_summaries(roots), "path string, start long, size long, n long, made string, piece binary")
    starts = sums.repartition("path").sortWithinPartitions("path", "start").mapInArrow(_starts(roots), "path string, start long, begins string, cut boolean, whole boolean, known boolean")
    whole = starts.filter("whole").select("path", "known")
    # Every range of a file that is no document starts with an empty text, and its pieces are passed over.
    document = F.max("whole").over(Window.partitionBy("path"))  # a row a range
    begins = starts.select("path", "start", F.lit(-1).cast("long").alias("n"), F.when(document, F.col("begins")).otherwise("").alias("begins"), "cut", F.lit(None).cast("binary").alias("piece"))
    rows = begins.unionByName(pieces.select("path", "start", "n", F.lit(None).cast("string").alias("begins"), F.lit(None).cast("boolean").alias("cut"), "piece"))
    met = rows.repartition("path", "start").sortWithinPartitions("path", "start", "n").select("path", "start", "begins", "cut", "piece")
    found = met.mapInArrow(_emitter(lists), "path string, kind string, since long, start long, i long, part boolean, text binary")
    # Parts of a record that runs over ranges carry the range it began in, where it is the last.
    own = F.when(F.col("part"), -1).otherwise(F.col("i")).alias("own")
    records = found.groupBy("path", "kind", "since", own).agg(F.max("i").alias("i"), F.sort_array(F.collect_list(F.struct("start", "text"))).alias("x"))
    records = records.select("path", "kind", "since", "i", F.expr("array_join(transform(x, y -> CAST(y.text AS STRING)), '')").alias("text"))
    counts = found.filter("i >= 0").groupBy("path", "kind", "since").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("path", "kind").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("path", "kind", "since", before.alias("before"))  # a row a range
    return records.join(counts, ["path", "kind", "since"]).select("path", "kind", (F.col("before") + F.col("i")).alias("i"), "text"), whole
