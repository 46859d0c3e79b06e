"""Hashes of words and of runs of words, vectorised over a text."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of the two polynomials, and their inverses modulo 2 ** 64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits a word, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(hashes: np.ndarray, length: int, column: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words; column 0 and 1 are independent."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, h = np.array([_BASES[column]], np.uint64), hashes[:, column]  # arrays wrap around silently
    out = np.zeros(n, np.uint64)
    # Horner's rule, all runs at once; doubling steps keep it to log2(length) passes.
    power, done, block = base, 0, h.copy()
    width, parts = 1, []
    while True:
        if length & width:
            parts.append((width, block, power))
        if width * 2 > length:
            break
        block = block[: len(block) - width] * power + block[width:]
        power = power * power
        width *= 2
    for width, block, power in reversed(parts):
        out = out * power + block[done : done + n]
        done += width
    return mix(out)
