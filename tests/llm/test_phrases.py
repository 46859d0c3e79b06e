"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from auditlake.llm import phrases
from auditlake.llm.phrases import collocations

LOWER = {c: c + 32 for c in range(65, 91)}
FIELDS = "lang rank phrase a l r n score".split()


def plain(rows, min_count, max_words, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in found.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in found.items()):
            continue
        cut = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), a, f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return sorted((lang, i, x[2].decode(), *x[3:], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def made(spark, rows, min_count, max_words, top, block=phrases.BLOCK, monkeypatch=None):
    table = spark.createDataFrame([(t, lang, 1, "clash") for t, lang in rows], "text string, lang string, n long, phrase string")
    return sorted(tuple(r[f] for f in FIELDS) for r in collocations(table, min_count=min_count, max_words=max_words, top=top).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "C", "ü", "É", "x\x1cy", "nbsp\xa0in", "new", "york", "city"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("block", [phrases.BLOCK, 24])
def test_collocations(spark, monkeypatch, block):
    # A small block cuts texts: phrases across the cut count once.
    monkeypatch.setattr(phrases.frequent_phrases, "__defaults__", (*phrases.frequent_phrases.__defaults__[:-1], block))
    rows = [*corpus(1, 120), (None, "en"), ("", None), ("New York City. " * 40, "fr"), ("New York City. " * 40, "fr"), ("again " * 90, "it")]
    assert made(spark, rows, 8, 4, 15) == plain(rows, 8, 4, 15)


def test_other_lengths_and_ties(spark):
    rows = [*corpus(2, 60), ("p q, r s. t u; p q, r s. t u", "tie")]
    assert made(spark, rows, 2, 2, 500) == plain(rows, 2, 2, 500)
    assert made(spark, rows, 2, 3, 500) == plain(rows, 2, 3, 500)


def test_no_phrases(spark):
    assert made(spark, [], 2, 4, 10) == []
    assert made(spark, [(None, None), ("", "en"), (" .,\n", "en"), ("once", "en")], 2, 4, 10) == []


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_SLICE", 100)
    rng = random.Random(4)
    text = " ".join(rng.choices(["one", "two", "three,", "four"], k=40_000)) + " " + "w" * 300_000
    assert made(spark, [(text, "en")], 500, 3, 40) == plain([(text, "en")], 500, 3, 40)


def test_exact_beyond_64_bits(spark):
    # 2,000,000 times a count of this size passes a long.
    a = 9 * 10**12
    level = spark.createDataFrame([(a, [a + 1, a], [a + 2, a])], "a long, heads array<long>, tails array<long>")
    whole = phrases.cut_score(1, 2)
    assert level.select(whole.alias("s")).first().s == 2_000_000 * a // (2 * a + 3)


def test_rows_of_a_block_do_not_grow_with_its_words(spark):
    # A row a word and block made the join that names words grow with blocks times vocabulary.
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4000)), "en")] * 4, "text string, lang string").repartition(4)
    lists = phrases.word_lists(docs, "text", "lang", 4, phrases.BLOCK).cache()
    blocks = lists.select("block").distinct().count()
    assert lists.count() <= 64 * blocks
    assert lists.selectExpr("sum(size(words)) AS w").first().w == 4000 * blocks
    assert lists.selectExpr("explode(n) AS n").agg({"n": "sum"}).first()[0] == 16000
