"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a doubly linked list of parts.  Every adjacent pair
that the ranks can merge sits in the bucket of its merge rank.  A two-level
bitmap marks the buckets that hold anything: find-first-set on the top word and
on the word below gives the lowest rank in constant time.  Popping a bucket
position whose pair has changed meanwhile (a stale entry) skips it.  A merge
costs a bounded number of bitmap steps, so a pre-token of any length takes time
in proportion to its length, plus the order within a bucket.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.vocab import CACHE_BYTES, CACHE_ENTRIES, CACHE_KEY, default_dir, read_ranks

#: Bits in a bitmap word.  Python integers have no fixed width; 240 is eight of their digits.
_WIDTH = 240


class ByteBpe(dict):
    """Word after a space -> little-endian 32-bit ids; short words are remembered."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.size = max(self.ranks.values()) + 1
        self.loose: dict[str, bytes] = {}
        self.held = 0
        self.words = [0] * (self.size // _WIDTH + 1)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        # Every way to split a token in two known tokens may merge to it: (left id, right id) -> rank.
        self.pair = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left * self.size + right] = rank
        self.single_ids = np.array(self.single)
        self.pair_keys = np.array([*sorted(self.pair), np.iinfo(np.int64).max])
        self.pair_values = np.array([*(self.pair[k] for k in self.pair_keys[:-1].tolist()), -1])
        letters, numbers = _classes(sys.maxunicode)
        self.whole_split = _splitter(pattern, letters, numbers)
        self.latin_split = _splitter(pattern, *_classes(255))
        self.other_space = re.compile(f" (?=[{_SPACE}]|\\Z)").search
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; classes of Latin-1 only, if those will do, as they are several times as quick."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole_split(text)
        return self.latin_split(text)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token.

        ``words`` and ``top`` are the bitmap, all zero between calls: bit ``r`` of
        the words says that ``buckets[r]`` holds positions, a bit of ``top`` that
        a word isn't zero.  A bucket is a heap, so that equal ranks merge from
        left to right.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, pair, words, width = self.size, self.pair.get, self.words, _WIDTH
        top, buckets = 0, {}
        ids = [self.single[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        fresh = [(r, i) for i, r in enumerate(map(pair, [x * size + y for x, y in zip(ids, ids[1:])])) if r is not None]
        while True:
            for rank, i in fresh:  # push
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    w = rank // width
                    if not words[w]:
                        top |= 1 << w
                    words[w] |= 1 << rank - w * width
                else:
                    heappush(bucket, i)
            if not top:
                break
            low = top & -top  # pop: the lowest set bit of the top word, then that of the word below
            w = low.bit_length() - 1
            bit = words[w] & -words[w]
            rank = w * width + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[w] ^= bit
                if not words[w]:
                    top ^= low
            fresh = ()
            j = after[i]
            if j >= n or ids[i] < 0 or pair(ids[i] * size + ids[j]) != rank:
                continue  # stale: a neighbour has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            h = before[i]
            fresh = []
            if h >= 0 and (new := pair(ids[h] * size + rank)) is not None:
                fresh.append((new, h))
            if k < n:
                before[k] = i
                if (new := pair(rank * size + ids[k])) is not None:
                    fresh.append((new, i))
        return [x for x in ids if x >= 0]

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of many short pre-tokens, as little-endian 32-bit integers, by one queue.

        The pre-tokens lie end to end in one linked list that no merge crosses.
        The lowest bucket is drained at once: in every pre-token its leftmost
        position that isn't stale merges, further ones go back to the bucket, so
        each pre-token goes through the same merges as on its own.
        """
        size, words, width = self.size, self.words, _WIDTH
        data = np.frombuffer(b"".join(tokens), np.uint8)
        n, lengths = len(data), np.array([len(t) for t in tokens])
        ids = np.append(self.single_ids[data], -1)  # the last stands for "none"
        owner = np.repeat(np.arange(len(tokens)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(lengths)
        after[ends - 1] = n
        before[ends - lengths] = n
        top, buckets = 0, {}
        at = np.flatnonzero(after[:n] < n)
        while True:
            ranks = self.pair_ranks(ids[at], ids[after[at]])
            known = ranks >= 0
            at, ranks = at[known], ranks[known]
            if len(at):  # push
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                    if rank in buckets:
                        buckets[rank].append(part)
                        continue
                    buckets[rank] = [part]
                    w = rank // width
                    if not words[w]:
                        top |= 1 << w
                    words[w] |= 1 << rank - w * width
            if not top:
                break
            low = top & -top  # pop: the lowest set bit of the top word, then that of the word below
            w = low.bit_length() - 1
            bit = words[w] & -words[w]
            rank = w * width + bit.bit_length() - 1
            parts = buckets.pop(rank)
            i = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            j = after[i]
            i = i[self.pair_ranks(ids[i], ids[j]) == rank]  # others are stale
            own = owner[i]
            first = np.ones(len(i), bool)
            first[1:] = own[1:] != own[:-1]
            if first.all():
                words[w] ^= bit
                if not words[w]:
                    top ^= low
            else:
                buckets[rank] = [i[~first]]
                i = i[first]
            j = after[i]
            k = after[j]
            ids[i], ids[j] = rank, -1
            after[i] = k
            before[k] = i  # that of the sentinel is never read
            h = before[i]
            at = np.concatenate([h[h < n], i[k < n]])
        alive = ids[:n] >= 0
        out = ids[:n][alive].astype("<u4").tobytes()
        stops = np.cumsum(np.bincount(owner[alive], minlength=len(tokens))) * 4
        return [out[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        keys = left * self.size + right
        found = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[found] == keys) & (left >= 0) & (right >= 0), self.pair_values[found], -1)

    def learn(self, texts: list[str]) -> None:
        """Remember the words of some texts, which must be encoded next.

        Once the memory is full it is emptied, and holds these texts' words only.
        """
        words: set[str] = set()
        loose: set[str] = set()
        for text in texts:
            if self.other_space(text):
                loose.update(self.split(text))
            else:
                head, *rest = text.split(" ")
                words.update(rest)
                loose.update(self.split(head))
        if len(self) + len(words) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        fresh = [w for w in words if w not in self]
        split = [self.split(" " + w) for w in fresh]
        loose.update(t for ts in split for t in ts)
        rest = []
        known = dict.fromkeys(loose)
        for token in loose:
            if (rank := self.ranks.get(token.encode())) is not None:
                known[token] = rank.to_bytes(4, "little")
            elif len(token) > CACHE_KEY:
                known[token] = np.array(self.merge(token.encode()), dtype="<u4").tobytes()
            else:
                rest.append(token)
        if rest:
            known.update(zip(rest, self.merge_many([t.encode() for t in rest])))
        self.update((w, b"".join([known[t] for t in ts])) for w, ts in zip(fresh, split))
        self.held += sum(len(w) + len(self[w]) for w in fresh)
        self.loose = known

    def encode(self, text: str) -> bytes:
        """Ids of a learnt text as little-endian unsigned 32-bit integers.

        A space before a character that isn't white space starts a pre-token
        always, so the words after such spaces are looked up one by one; texts
        with other spaces are split by the pattern as a whole.
        """
        if self.other_space(text):
            return b"".join([self.loose[t] for t in self.split(text)])
        head, *rest = text.split(" ")
        return b"".join([*[self.loose[t] for t in self.split(head)], *map(self.__getitem__, rest)])

    def encode_all(self, texts: list[str], block: int = 1 << 22) -> Iterator[bytes]:
        """Ids of each text; texts are learnt in groups of about ``block`` characters."""
        group: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= block or i == len(texts) - 1:
                self.learn(group)
                yield from map(self.encode, group)
                group, size = [], 0

    def decode(self, ids: bytes, block: int = 1 << 20) -> Iterator[bytes]:
        """Bytes of the ids, in blocks of at most ``block`` ids."""
        for at in range(0, len(ids), 4 * block):
            part = np.frombuffer(ids[at : at + 4 * block], "<u4")
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[part] - (ends - lengths), lengths)
            shift += np.arange(len(shift))
            yield self.flat[shift].tobytes()


@lru_cache(maxsize=4)
def _members(pattern: str) -> np.ndarray:
    """Code points that a class of the pattern language holds, ascending.

    The installed tiktoken tells: encoded under the class alone, a text of all
    code points keeps the class's members only.  So Python's own version of
    Unicode, which may be older or newer, plays no part.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return np.frombuffer(only.decode(only.encode_ordinary(every)).encode("utf-32-le"), "<u4")


def _classes(last: int) -> tuple[str, str]:
    """Bodies of character classes of the ``re`` module for letters and numbers up to a code point."""
    out = []
    for pattern in (r"\p{L}", r"\p{N}"):
        found = _members(pattern)
        found = found[found <= last].astype(np.int64)
        cuts = np.flatnonzero(np.diff(found) > 1)
        starts, stops = found[np.append(0, cuts + 1)], found[np.append(cuts, len(found) - 1)]
        out.append("".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(starts.tolist(), stops.tolist())))
    return out[0], out[1]


# The code points of White_Space, which \\s means in the pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _splitter(pattern: str, letters: str, numbers: str):
    """``findall`` of a pre-token pattern.

    The pattern's classes are spelled out for ``re``, several times as quick as
    ``regex`` here.  ``[^\\s\\p{L}\\p{N}]`` needs the classes' bodies inside a class.
    """
    bodies = {"\\p{L}": letters, "\\p{N}": numbers, "\\s": _SPACE, "\\S": "^" + _SPACE}
    out, inside, i = [], False, 0
    while i < len(pattern):
        key = next((k for k in bodies if pattern.startswith(k, i)), None)
        if key:
            out.append(bodies[key] if inside else f"[{bodies[key]}]")
            i += len(key)
            continue
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out)).findall


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode each text, then decode the ids.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and with
    ``keep_ids`` the ids themselves (``ids``: little-endian unsigned 32-bit).
    A null text counts as empty: no tokens.  Null ids and repeated rows stay rows; further
    columns are ignored; an empty table gives no rows.  Texts of any length are
    encoded whole; a pre-token of any length goes through one queue, with
    about 200 bytes of memory for each of its bytes.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = ranks or f"{default_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for ids in bpe.encode_all(texts):
                digest = hashlib.sha256()
                for part in bpe.decode(ids):
                    digest.update(part)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(digest.hexdigest())
                if keep_ids:
                    kept.append(ids)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.record_batch(cols + [pa.array(kept, pa.binary())] * keep_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
