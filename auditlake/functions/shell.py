"""Shell commands: argv and flags of a command, and constructs of a small grammar.

Pure Python without Spark below the two UDFs, so both can be tested alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Long options that stand for short ones.
LONG_FLAGS = {"recursive": "r", "force": "f", "verbose": "v"}
#: Names of constructs; any other name in a rule is ignored.
CONSTRUCTS = ("Simple", "Pipeline", "Subshell", "CommandSubstitution", "Heredoc", "Redirection")
ALIASES = {"CommandSubst": "CommandSubstitution"}


def split_argv(command: str) -> list[str] | None:
    """POSIX word splitting; None where a quote or a backslash is left open.

    ``#`` at the start of a word comments out the rest of its line.
    """
    words: list[str] = []
    word: list[str] | None = None
    i, n = 0, len(command)
    while i < n:
        c = command[i]
        i += 1
        if c in " \t\n":
            if word is not None:
                words.append("".join(word))
                word = None
        elif c == "#" and word is None:
            end = command.find("\n", i)
            i = n if end < 0 else end
        elif c == "'":
            end = command.find("'", i)
            if end < 0:
                return None
            word = (word or []) + [command[i:end]]
            i = end + 1
        elif c == '"':
            word = word or []
            while True:
                if i >= n:
                    return None
                c = command[i]
                i += 1
                if c == '"':
                    break
                if c == "\\":
                    if i >= n:
                        return None
                    c = command[i]
                    i += 1
                    if c == "\n":
                        continue
                    word.append(c if c in '$`"\\' else "\\" + c)
                else:
                    word.append(c)
        elif c == "\\":
            if i >= n:
                return None
            c = command[i]
            i += 1
            if c != "\n":
                word = (word or []) + [c]
        else:
            word = (word or []) + [c]
    if word is not None:
        words.append("".join(word))
    return words


def argv_shape(command: str | None) -> tuple[str, list[str]] | None:
    """Base name of the program and its flags: bundles expanded, known long options shortened, none after ``--``."""
    words = split_argv(command) if command is not None else None
    if not words:
        return None
    program = words[0].rsplit("/", 1)[-1]
    if not program:
        return None
    flags: list[str] = []
    for w in words[1:]:
        if w == "--":
            break
        if w.startswith("--"):
            name = w[2:].split("=", 1)[0]
            if name:
                flags.append(LONG_FLAGS.get(name, name))
        elif w.startswith("-"):
            flags.extend(w[1:])
    return program, flags


class ShellSyntaxError(ValueError):
    """Input outside the grammar."""


_OPERATORS = re.compile(rb"\|\||&&|<&|<<|>&|>>|[|();\n<>]")
_BARE = re.compile(rb"[^ \t\n|&;<>()$`\\\"']+")
_DOUBLE = re.compile(rb'"((?:[^"\\]|\\.|\\\Z)*)"', re.S)
_REDIRECTIONS = frozenset(["<", ">", ">>", "<<", ">&", "<&"])


def lex(command: str) -> list[tuple[str, str, str]]:
    """Tokens (kind, text, raw); kind is ``word``, an operator or ``end``.

    Quirks that the rules depend on: ``$`` and a backquote are words of their own,
    a quoted part is a word of its own, a backslash drops itself and the next
    byte, and a single ``&`` is an error.
    """
    data = command.encode("utf-8", "surrogatepass")
    out: list[tuple[str, str, str]] = []
    i, n = 0, len(data)

    def text(a: int, z: int) -> str:
        return data[a:z].decode("utf-8", "replace")

    while True:
        while i < n and (data[i] in b" \t\r" or data[i] == 0x23):
            if data[i] == 0x23:
                end = data.find(b"\n", i)
                i = n if end < 0 else end
            else:
                i += 1
        if i >= n:
            return [*out, ("end", "", "")]
        operator = _OPERATORS.match(data, i)
        if operator:
            op = operator[0].decode()
            out.append((op, op, op))
            i = operator.end()
        elif data[i] == 0x26:
            raise ShellSyntaxError("a single &")
        elif data[i] == 0x27:
            end = data.find(b"'", i + 1)
            if end < 0:
                raise ShellSyntaxError("unbalanced quote")
            out.append(("word", text(i + 1, end), text(i, end + 1)))
            i = end + 1
        elif data[i] == 0x22:
            quoted = _DOUBLE.match(data, i)
            if quoted is None:
                raise ShellSyntaxError("unbalanced quote")
            out.append(("word", text(i + 1, quoted.end() - 1), text(i, quoted.end())))
            i = quoted.end()
        elif data[i] in b"$`":
            out.append(("word", chr(data[i]), chr(data[i])))
            i += 1
        elif data[i] == 0x5C:
            if i + 1 >= n:
                raise ShellSyntaxError("a backslash at the end")
            i += 2
        else:
            bare = _BARE.match(data, i)
            out.append(("word", text(i, bare.end()), text(i, bare.end())))
            i = bare.end()


class _Parser:
    """Recursive descent over the tokens.  Each method returns the constructs of what it has read.

    Of a list of pipelines only the first counts; the others must parse.
    """

    def __init__(self, tokens: list[tuple[str, str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def backquote(self) -> bool:
        return self.tokens[self.at][:2] == ("word", "`")

    def step(self) -> None:
        self.at = min(self.at + 1, len(self.tokens) - 1)

    def expect(self, kind: str) -> None:
        if self.kind != kind:
            raise ShellSyntaxError(f"expected {kind}, got {self.kind}")
        self.step()

    def program(self) -> set[str]:
        while self.kind in (";", "\n"):
            self.step()
        if self.kind == "end":
            raise ShellSyntaxError("nothing to parse")
        return self.pipelines(lambda: self.kind == "end")

    def pipelines(self, over) -> set[str]:
        first = self.pipeline()
        while True:
            while self.kind in (";", "\n"):
                self.step()
            if over():
                return first
            self.pipeline()

    def inner(self) -> set[str]:
        self.depth += 1
        if self.depth > 200:
            raise ShellSyntaxError("nested too deeply")
        found = self.pipelines(lambda: self.kind in ("end", ")") or self.backquote())
        self.depth -= 1
        return found

    def pipeline(self) -> set[str]:
        found, parts = self.command(), 1
        while self.kind == "|":
            self.step()
            found |= self.command()
            parts += 1
        return found | {"Pipeline"} if parts > 1 else found

    def command(self) -> set[str]:
        if self.kind == "(":
            self.step()
            found = self.inner()
            self.expect(")")
            return found | {"Subshell"}
        if self.tokens[self.at][:2] == ("word", "$") and self.tokens[min(self.at + 1, len(self.tokens) - 1)][0] == "(":
            self.step()
            self.step()
            found = self.inner()
            self.expect(")")
            return found | {"CommandSubstitution"}
        if self.backquote():
            self.step()
            found = self.inner()
            if not self.backquote():
                raise ShellSyntaxError("unbalanced backquote")
            self.step()
            return found | {"CommandSubstitution"}
        return self.simple()

    def simple(self) -> set[str]:
        if self.kind != "word":
            raise ShellSyntaxError(f"expected a word, got {self.kind}")
        found, delimiter = {"Simple"}, None
        while True:
            if self.kind == "word":
                if self.backquote():
                    break
                self.step()
            elif self.kind in _REDIRECTIONS:
                op = self.kind
                self.step()
                if self.kind != "word":
                    raise ShellSyntaxError("a redirection without target")
                found.add("Redirection")
                if op == "<<":
                    delimiter = self.tokens[self.at][1]
                self.step()
            else:
                break
        if delimiter is not None and self.heredoc(delimiter):
            found.add("Heredoc")
        return found

    def heredoc(self, delimiter: str) -> bool:
        """Read up to the delimiter; without one everything is read and there is no heredoc."""
        while self.kind != "end":
            kind, text, raw = self.tokens[self.at]
            self.step()
            if kind == "word" and delimiter in (text, raw):
                return True
        return False


def constructs(command: str | None) -> list[str]:
    """Constructs of a command in the order of ``CONSTRUCTS``; none outside the grammar."""
    if command is None:
        return []
    try:
        found = _Parser(lex(command)).program()
    except ShellSyntaxError:
        return []
    return [c for c in CONSTRUCTS if c in found]


def _each(commands: pa.Array, made, kind: pa.DataType) -> pa.Array:
    """What is made of each command, once for equal ones of a batch; most are null there, as few rows ask."""
    coded = commands.dictionary_encode()
    values = pa.array([*(made(c) for c in coded.dictionary.to_pylist()), made(None)], kind)
    return values.take(coded.indices.fill_null(len(coded.dictionary)))


@F.arrow_udf(T.StructType([T.StructField("program", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType()))]))
def argv_udf(commands: pa.Array) -> pa.Array:
    """``argv_shape`` for a column; null fields where a command can't be split."""
    return _each(commands, lambda c: dict(zip(("program", "flags"), argv_shape(c) or (None, None))), pa.struct([("program", pa.string()), ("flags", pa.list_(pa.string()))]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def constructs_udf(commands: pa.Array) -> pa.Array:
    """``constructs`` for a column."""
    return _each(commands, constructs, pa.list_(pa.string()))
