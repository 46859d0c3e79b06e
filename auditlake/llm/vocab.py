"""Readers of the public tokenizer files; the folder is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Entries that a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 700_000
#: Bytes of words and ids in such a cache before it is emptied.
CACHE_BYTES = 64 << 20
#: Longest key that is cached, so that a cache's bytes are bounded as well.
CACHE_KEY = 64

# Latin letters after lower-casing, for the quick way only.
_LETTERS = "a-zªµºß-öø-ÿ"


def default_dir() -> str:
    """Folder of the installed public tokenizers."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("README.md"))


class WordBpe(dict):
    """White-space-separated chunk -> little-endian 32-bit ids under ``word_bpe_49k.json``.

    The tokenizer drops white space and never merges across it, so chunks are
    independent.  Chunks of Latin letters and ASCII signs are cut into letter
    runs, which the tokenizer's own model encodes; any other chunk goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        import re

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level alphabet: printable bytes stand for themselves, others for 256, 257, ...
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.pieces = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}]+").findall
        self.letters = re.compile(f"[{_LETTERS}]+").fullmatch
        # An apostrophe may start a contraction, and characters beyond Latin may need normalising.
        self.simple = re.compile("[\x21-\x26\x28-\x7e\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
        self.odd_space = re.compile("[\x1c-\x1f]").search
        # Strings of added tokens, which the tokenizer looks for in the text as it stands.
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > CACHE_KEY or not self.simple(chunk) or self.added(chunk):
            out = self._whole(chunk)
            if len(chunk) > CACHE_KEY:
                return out
        else:
            low = chunk.lower()
            if self.letters(low):
                if low != chunk:
                    out = self[low]
                else:
                    word = low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet)
                    out = np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()
            else:
                parts = self.pieces(low)
                out = b"".join([self[p] for p in parts]) if len(parts) > 1 else self._whole(low)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if self.odd_space(text):  # str.split() splits there, the tokenizer doesn't
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder a worker process."""
    return WordBpe(path)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: token bytes -> rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
