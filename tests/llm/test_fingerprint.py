"""Fingerprints against sets of paragraphs."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from auditlake.llm import fingerprint
from auditlake.llm.fingerprint import differing, digests, fingerprints


def paragraphs(text):
    """The paragraphs of a text, by walking along it."""
    out, i = set(), 0
    while i < len(text):
        if text[i] == "\n":
            i += 1
            continue
        line = text[i : i + 400].split("\n")[0]
        end = next((k + 1 for k in range(80, len(line)) if line[k] in ".!?" and (i + k + 1 == len(text) or text[i + k + 1] in " \n")), len(line))
        out.add(text[i : i + end])
        i += end
    return out


def plain(rows):
    """``doc_id -> results`` of rows, a pair of sets at a time."""
    order = sorted(set(rows), key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, e, x = map(paragraphs, (text, edited, other))
        near = [len(a & b) / len(a | b) if a | b else 1.0 for b in (e, x)]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *near)
    return out


def text(rng, n):
    words = "alpha beta gamma delta. epsilon zeta! eta theta? iota kappa\n lambda mü 😀".split(" ")
    return " ".join(rng.choice(words) for _ in range(n))


def test_fingerprints(spark):
    rng = random.Random(1)
    rows = [(i * 3, text(rng, rng.choice([0, 1, 3, 40, 200, 700]))) for i in range(60)]
    rows += [(500, rows[4][1]), (501, "x" * 5000), (502, "x" * 5000 + "."), (503, "one. " * 2000)]
    rows += [rows[5], rows[5]]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fingerprint string, rid int").repartition(3)
    got = fingerprints(table).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    want = plain(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == want[r.doc_id][2:], r.doc_id
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
        prints.setdefault("edited " + r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_nulls_and_single_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints(spark.createDataFrame([], schema)).collect() == []
    (one,) = fingerprints(spark.createDataFrame([(7, None)], schema)).collect()
    assert (one.doc_id, one.n_chars, one.near_edited, one.near_next) == (7, 0, 1.0, 1.0) and one.edited_sha256 == hashlib.sha256(b"").hexdigest()
    rows = fingerprints(spark.createDataFrame([(None, "ab"), (2, "cd"), (None, None), (2, "ef"), (None, "ab")], schema)).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 2), (False, 2), (True, 0), (True, 2), (True, 2)]


def test_next_document_over_ranges(spark):
    rows = [(i, f"text {i}") for i in range(-40, 200)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = plain(rows)
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: w[1] for i, w in want.items()}


def test_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "_COPIES", 4)
    rows = [(1, "same. " * 30)] * 23 + [(2, "other"), (2, "other")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1] * 23 + [2] * 2


def test_peeling_recovers_what_differs(spark):
    rng = random.Random(2)
    pairs, want = [], {}
    for rid in range(80):
        size = rng.choice([0, 1, 5, 20, 400])
        both = [rng.getrandbits(64) - 2**63 for _ in range(size)]
        # Some digests share all bits that place them, so that a sketch is stuck on them.
        a = both + [(rng.getrandbits(55) << 9) - 2**63 for _ in range(rng.randint(0, 30))]
        b = both + [rng.getrandbits(64) - 2**63 for _ in range(rng.randint(0, 30))]
        pairs.append((rid, 0, a, b))
        want[rid] = (set(a) - set(b), set(b) - set(a))
    table = spark.createDataFrame(pairs, "rid long, kind int, a array<long>, b array<long>")
    got = {rid: (set(), set()) for rid in want}
    for r in differing(table).collect():
        got[r.rid][0].update(r.only_a)
        got[r.rid][1].update(r.only_b)
    assert got == want
    counted = differing(table, counted=True).groupBy("rid").agg(F.sum("only_a").alias("a"), F.sum("only_b").alias("b")).collect()
    assert {r.rid: (r.a, r.b) for r in counted} == {rid: (len(a), len(b)) for rid, (a, b) in want.items()}


def test_paragraphs(spark):
    rng = random.Random(3)
    texts = [text(rng, n) for n in (0, 5, 50, 500)] + ["a." * 300, "w" * 1000, "s. " * 400, "x" * 79 + ". " + "y" * 80 + ". z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", f"{fingerprint.paragraphs('text')} AS p", f"size({digests('text')}) AS n").collect()
    for r in rows:
        assert set(r.p) == paragraphs(r.text) and r.n == len(set(r.p)) and "".join(r.p) == re.sub("\n", "", r.text)
