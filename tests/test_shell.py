"""Word splitting, flags and the small grammar."""

import pytest

from auditlake.functions.shell import argv_shape, constructs, split_argv


@pytest.mark.parametrize(
    "command, words",
    [("a b  c", ["a", "b", "c"]), ("a 'b c' \"d e\"", ["a", "b c", "d e"]), ("a\\ b", ["a b"]), ("", []), ("a 'open", None), ("x\\", None), ("a # b c", ["a"]), ("a#b", ["a#b"]), ('"\\$x \\n"', ["$x \\n"])],
)
def test_split(command, words):
    assert split_argv(command) == words


@pytest.mark.parametrize(
    "command, shape",
    [
        ("rm -rf /x", ("rm", ["r", "f"])),
        ("/bin/rm --recursive --force x", ("rm", ["r", "f"])),
        ("rm -- -rf", ("rm", [])),
        ("ls --color=auto -", ("ls", ["color"])),
        ("rm a && ls -rf", ("rm", ["r", "f"])),
        ("", None),
        ("dir/", None),
        ("'", None),
        (None, None),
    ],
)
def test_shape(command, shape):
    assert argv_shape(command) == shape


@pytest.mark.parametrize(
    "command, found",
    [
        ("ls -l", ["Simple"]),
        ("a | b", ["Simple", "Pipeline"]),
        ("(a; b | c)", ["Simple", "Subshell"]),
        ("$(a)", ["Simple", "CommandSubstitution"]),
        ("`a`", ["Simple", "CommandSubstitution"]),
        ("echo $(whoami)", ["Simple"]),  # the dollar sign is a word, and what follows is a second pipeline
        ("a > f", ["Simple", "Redirection"]),
        ("cat << E\nbody\nE", ["Simple", "Heredoc", "Redirection"]),
        ("cat << E body E", ["Simple", "Redirection"]),
        ("a && b", []),
        ("a & b", []),
        ("a; b | c", ["Simple"]),
        ("a '", []),
        ("", []),
        (None, []),
        ("(" * 5000, []),
    ],
)
def test_constructs(command, found):
    assert constructs(command) == found
