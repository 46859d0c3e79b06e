"""Cross-tokenizer alignment against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auditlake.llm import crosstok
from auditlake.llm.crosstok import align_tokenizers, aligner
from auditlake.llm.vocab import default_dir

FIELDS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def plain(rows):
    """Token by token and pair by pair, from the two libraries alone."""
    side_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    links = []
    out = []
    for doc_id, text in rows:
        text = text or ""
        a = [(i, bytes(chars[c] for c in side_a.id_to_token(i))) for i in side_a.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in side_b.encode(text) if text else []:
            piece = side_b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if side_b.is_byte(i) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, mine = 0, []
            for i, x in side:
                mine.append((i, at, at + len(x)))
                at += len(x)
            spans.append(mine)
        pairs = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, _, f in side if low < f <= e) for side in spans))
            low = e
        links.append(pairs)
        out.append([doc_id, len(a), len(b), len(groups), len(pairs), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    counts = Counter(p for pairs in links for p in set(pairs))
    top = defaultdict(int)
    for (i, _), c in counts.items():
        top[i] = max(top[i], c)
    for row, pairs in zip(out, links):
        row[5] = sum(counts[p] == top[p[0]] for p in pairs)
        row[6] = sum(counts[p] for p in pairs)
    return sorted(map(tuple, out), key=repr)


def made(spark, rows, schema="doc_id long, text string, n_a string, block string"):
    table = spark.createDataFrame([(*r, "clash", None) for r in rows], schema)
    return sorted((tuple(r[f] for f in FIELDS) for r in align_tokenizers(table).collect()), key=repr)


TEXTS = ["", None, " ", "one", "The quick brown fox's tale; 12 34!", "é è ß Ünïcode\n\ttabs  two  spaces ", "x" * 700, "日本 語   text 😀", "<|endoftext|> </s> ▁ <0x41>", "\u0000 nul", "ﬁ ligature ① ", " ", "á"]


@pytest.mark.parametrize("block", [crosstok.BLOCK, 40])
def test_align(spark, monkeypatch, block):
    monkeypatch.setattr(crosstok, "BLOCK", block)
    rng = random.Random(3)
    words = "the of and on in, as. is not; token 1999 größe niño über co-op don't".split()
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (3, "three"), (None, "no id"), *((100 + i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40))]
    assert made(spark, rows) == plain(rows)


def test_align_deals_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(crosstok, "BLOCK", 10)
    monkeypatch.setattr(crosstok, "STRETCH", 2)
    rows = [(i, f"the same words again, {i % 7}") for i in range(60)]
    assert made(spark, rows) == plain(rows)


def test_align_without_rows(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, None), (2, "")]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_quick_side_a_is_the_tokenizer():
    side = aligner(default_dir(), "byte_bpe_50k.json", "piece_bpe_32k.model")
    assert side.quick
    rng = random.Random(5)
    chars = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(161, 592), 0x2010, 0x2019, 0x201C, 0x2026, 0x20AC)]
    for _ in range(3000):
        text = " " + "".join(rng.choices(chars if rng.random() < 0.5 else chars[:98], k=rng.randint(1, 40)))
        assert crosstok._SETTLED(text)
        assert side.quick(text) == side.whole.encode(text, add_special_tokens=False).ids


def test_align_long_text(spark):
    text = "word and another, " * 30_000
    (row,) = made(spark, [(1, text)])
    assert row[1] > 100_000 and row[4] == row[1] + row[2] - row[3]
