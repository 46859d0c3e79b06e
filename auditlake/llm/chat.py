"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  The grammar is
regular: a turn starts at the start mark, its role ends at the first line
break, its text at the next end mark.  Each rendered turn is parsed again by a
deterministic parser; if the turns that come back differ from the source, the
conflicting content is escaped and the turn rendered again, until both are
identical.  The rendered turns of a conversation then go, as one text, through
the same parser, and the turns that it recovers must be the source's.

Escape: in conflicting content every ``<|`` followed by any number of
backslashes and one of the control names gets one backslash more
(``<|im_end|>`` becomes ``<|\\im_end|>``); reading takes one away.  So it is
reversible for texts that hold escaped marks themselves, and the output never
holds a control string that isn't the template's.

Rows stream through sorted partitions, so a conversation of any length needs
the memory of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start\|>|im_end\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start\|>|im_end\|>)")


def escape(text: str) -> str:
    """One backslash more in every control string, escaped or not."""
    return _CONTROL.sub(r"<|\\\1\2", text)


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return _ESCAPED.sub(r"<|\1\2", text)


def _escape_role(role: str) -> str:
    """Roles hold no line break in the output; ``%`` and line breaks become ``%25`` and ``%0A``."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _read_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class GrammarError(ValueError):
    """Text that no formatted conversation can be."""


class Parser:
    """The grammar over a text that comes in parts: ``feed`` gives the turns that a part completes.

    An open turn is held until its end mark, so memory is that of the longest turn.
    """

    def __init__(self):
        self.open, self.at = "", 0

    def feed(self, part: str) -> list[tuple[str, str, int, int]]:
        """Role, text (both read back), and the span of the raw text part in the whole text."""
        text, out, at = self.open + part if self.open else part, [], 0
        while at < len(text):
            if not text.startswith(START, at):
                if len(text) - at < len(START) and START.startswith(text[at:]):
                    break
                raise GrammarError(f"no turn at {self.at + at}")
            role = at + len(START)
            line = text.find("\n", role)
            end = text.find(END, line + 1) if line >= 0 else -1
            stop = end + len(END)
            if end < 0 or stop == len(text):
                break
            if text[stop] != "\n" or text.find(START, role, end) >= 0 or text.find(END, role, line) >= 0:
                raise GrammarError(f"no turn at {self.at + at}")
            out.append((_read_role(text[role:line]), unescape(text[line + 1 : end]), self.at + line + 1, self.at + end))
            at = stop + 1
        self.open, self.at = text[at:], self.at + at
        return out

    def close(self) -> None:
        """The text must end with a turn."""
        if self.open:
            raise GrammarError(f"open turn at {self.at}")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text (both read back), and the span of the raw text part."""
    parser = Parser()
    out = parser.feed(formatted)
    parser.close()
    return out


def render_turn(role: str, text: str) -> str:
    """A turn whose parse is exactly ``(role, text)``.

    The plain rendering is tried first; content is escaped only where the
    reparse differs.
    """
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), escape(text))):
        formatted = f"{START}{r}\n{t}{END}\n"
        try:
            back = parse(formatted)
        except GrammarError:
            continue
        if [(a, b) for a, b, _, _ in back] == [(role, text)]:
            return formatted
    raise GrammarError("a turn cannot be rendered")  # not reached: the last way always reads back


def format_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, formatted, mask_start, mask_end`` in code points of ``formatted``.

    The mask spans the raw text of assistant turns; others have an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, begin, end = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                formatted = render_turn(role or "", text or "")
                ((r, _, a, z),) = parse(formatted)
                out.append(formatted)
                begin.append(a if r == "assistant" else 0)
                end.append(z if r == "assistant" else 0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["conv_id", "turn", "formatted", "mask_start", "mask_end"])

    return _typed(rows, conv_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, turn long, formatted string, mask_start long, mask_end long")


def _typed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    """Running digests of what is read back from the whole output of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()
        self.parser = Parser()

    def add(self, role: str, text: str) -> None:
        formatted = render_turn(role, text)
        recovered = self.parser.feed(formatted)
        if [x[:2] for x in recovered] != [(role, text)]:
            raise GrammarError(f"turn {self.n} of conversation {self.conv_id} is not recovered from the whole text")
        for role, text, _, _ in recovered:
            self.n += 1
            for part in (role, "\n", text, "\n"):
                self.turns.update(part.encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self) -> tuple:
        self.parser.close()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def conversation_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, read back from its formatted turns (``DIGESTS``).

    Turns go in the order of ``turn``, nulls first; ties in the order of role,
    then text, so repeated rows are turns of their own.  Null text and role count as empty,
    a null ``conv_id`` is a conversation of its own; further columns are ignored; an
    empty table gives no rows.  A turn of any length takes a few times its own
    size in memory; a conversation is one stream through one task, in the memory of its longest turn.
    """
    ordered = _typed(rows, conv_col, turn_col, role_col, text_col).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: _Conversation | None = None
        for batch in batches:
            done = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if open_one is None or open_one.conv_id != conv:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Conversation(conv)
                open_one.add(role or "", text or "")
            if done:
                yield _batch(done)
        if open_one is not None:
            yield _batch([open_one.row()])

    return ordered.mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGESTS.split(", ")])
