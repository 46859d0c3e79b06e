"""A tree walked by one process, to compare with."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from auditlake.sources.repo import _ignore_rules


def walk(root: str | Path, extensions: tuple[str, ...] = ()) -> Iterator[tuple[str, bool]]:
    """(path below the root, whether its extension is wanted) of regular files that no ignore file names, by path.

    Hidden files are in, ``.git`` isn't, and links aren't followed.
    """
    root = Path(root)
    allowed = {e.lower().lstrip(".") for e in extensions}

    def visit(folder: Path, rules: list) -> Iterator[tuple[str, bool]]:
        rules = [*rules, *((folder, _ignore_rules((folder / n).read_text(encoding="utf-8", errors="replace"))) for n in (".gitignore", ".ignore") if (folder / n).is_file())]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            is_dir = entry.is_dir(follow_symlinks=False)
            if is_dir and entry.name == ".git":
                continue
            ignored = False
            for base, own in rules:
                below = Path(entry.path).relative_to(base).as_posix()
                for pattern, negated, only_dirs in own:
                    if (is_dir or not only_dirs) and pattern.match(below):
                        ignored = not negated
            if ignored:
                continue
            if is_dir:
                yield from visit(Path(entry.path), rules)
            elif entry.is_file(follow_symlinks=False):
                name = Path(entry.path)
                yield name.relative_to(root).as_posix(), not allowed or name.suffix.lower().lstrip(".") in allowed

    yield from visit(root, [])
