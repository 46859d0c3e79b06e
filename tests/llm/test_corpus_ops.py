"""Operators that compare documents, against brute force; and the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import neardup, queries, quality, substrings, topk, vecdup
from auditlake.llm.components import connected_components
from auditlake.llm.sharding import SEED, interleave
from auditlake.llm.words import split_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and long ones."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, base = text(60), [text(rng.randint(40, 120)) for _ in range(12)]
    rows = [*base, base[0], base[0], base[1].upper(), None, "", "  \n ", "short", "short", "a b", passage, text(20) + " " + passage, passage + "\n" + text(30), text(4000)]
    for b in base[:6]:
        for edits in (1, 3, 8, 15):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    loop = text(40)
    return [*rows, " ".join([loop, loop]), "é\xa0x " * 50]


def table(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3 if i % 2 else 0}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    texts = corpus()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    found = neardup.near_duplicates(table(spark, texts), shingle=k).collect()
    assert len(found) == len(texts) and len(links) > 8
    for r in found:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(table(spark, ["x"]).limit(0)).count() == 0
    t = "one two three four five six seven"
    rows = [(None, t), (None, None), (5, t), (5, "other words that are not the same at all"), (7, t), (9, "other words that are not the same at all")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(5, 5), (5, 5), (7, 5), (9, 5)]
    assert [r["kept"] for r in found if r["doc_id"] is None] == [True, True]


def test_blocks_of_lists_and_families(spark, monkeypatch):
    """Small blocks give the same result."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 2)
    test_near_duplicates(spark, 4)


@pytest.mark.parametrize("window", [35, 12, 5])
def test_substrings(spark, window):
    texts = [*corpus(), corpus()[0]]
    words = [split_words(t) for t in texts]
    seen = Counter(tuple(w[j : j + window]) for w in words for j in range(len(w) - window + 1))
    found = {r["doc_id"]: r for r in substrings.dedup_substrings(table(spark, texts), window=window).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert substrings.dedup_substrings(table(spark, texts).limit(0)).count() == 0


def test_index_in_two_jobs(spark, tmp_path):
    """Batches added in two jobs give what one job gives, across compaction; runs are read where they lie."""
    rng = random.Random(8)
    batches = [[rng.randrange(60) for _ in range(30)] for _ in range(6)]
    frame = lambda hashes: spark.createDataFrame([(h,) for h in hashes], "fp long")
    seen: set[int] = set()
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), fan_in=3, buckets=3)
    for i, batch in enumerate(batches):
        if i in (1, 4):  # a later job
            index.close()
            index = substrings.FingerprintIndex.open(spark, str(tmp_path / "index"))
        got = {r["fp"] for r in index.add(frame(batch)).collect()}
        assert got == {h for h, n in Counter(batch).items() if n > 1 or h in seen}, i
        seen |= set(batch)
        assert len(index.runs) < 3
    assert index.compactions >= 1 and len([x for x in (tmp_path / "index").iterdir() if x.name.startswith("run")]) == len(index.runs)
    (total,) = {sum(r["n"] for r in index._table(index.runs[0]).collect()) + sum(r["n"] for run in index.runs[1:] for r in index._table(run).collect())}
    assert total == sum(map(len, batches))
    tables = [index._table(index._write(frame(b).groupBy("fp").agg(F.count("*").alias("n")))) for b in batches[:2]]
    plan = tables[0].join(tables[1].hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_query_compacts(spark, monkeypatch):
    done = []
    compact = substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: (done.append(1), compact(self)))
    assert substrings.dedup_substrings(table(spark, corpus()[:6]), window=35).count() == 6 and len(done) == 1


def test_substrings_of_batches(spark, tmp_path):
    """A new batch loses what history or the batch itself holds elsewhere."""
    window, texts = 12, [*corpus(), corpus()[0]]
    parts = [texts[i::3] for i in range(3)]
    index = substrings.FingerprintIndex(spark, str(tmp_path / "index"), fan_in=2, buckets=2)
    past = []
    for part in parts:
        docs = [(i, t) for i, t in enumerate(texts) if any(t is p for p in part)]
        history = spark.createDataFrame(past, "doc_id long, text string")
        found = {r["doc_id"]: r for r in substrings.dedup_batch(spark.createDataFrame(docs, "doc_id long, text string"), index, history, window=window).collect()}
        words = {i: split_words(t) for i, t in docs}
        seen = Counter(tuple(w[j : j + window]) for w in [*words.values(), *(split_words(t) for _, t in past)] for j in range(len(w) - window + 1))
        for i, w in words.items():
            gone = [False] * len(w)
            for j in range(len(w) - window + 1):
                if seen[tuple(w[j : j + window])] > 1:
                    gone[j : j + window] = [True] * window
            assert (found[i]["n_words"], found[i]["n_removed"]) == (len(w), sum(gone)), i
        past += docs
    assert index.compactions == 2
    index.close()


def test_substrings_null_ids(spark):
    t = " ".join(f"v{i}" for i in range(60))
    rows = [(None, t), (None, "x " + t), (3, "other"), (3, "other")]
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=50).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in found) == [(1, 0), (1, 0), (60, 60), (61, 60)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    want = roots({x for l in links for x in l}, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(5)).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((400, 6)), 2)
    x[50:120] = x[0]
    rows = [(i, [float(c) for c in v], "z") for i, v in enumerate(x)] + [(500, None, None), (550, [1.0, None], None), (600, [float("nan")] * 6, None), (None, [1.0] * 6, None), (700, [], None), (750, [3e30] * 6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df.filter("vec_id < 400"), F.col("vec_id") % 50 == 0, block_rows=64).collect())
    y = np.floor(256 * x)
    want = []
    for q in range(0, 400, 50):
        s = y @ y[q]
        want += [(q, n + 1, int(j)) for n, j in enumerate([j for j in np.lexsort((np.arange(400), -s)) if j != q][:5])]
    assert got == want
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).filter("query_id in (500, 550, 600, 700)").isEmpty()
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_edges(spark):
    """Ids that repeat with other vectors, repeated rows, and components beyond the range of a long."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(1, 2, 3 << 16), (2, 1, 2 << 16), (3, 1, 0)]
    big = spark.createDataFrame([(0, [1e30]), (1, [2e30]), (2, [3e30]), (3, [-1e30]), (4, [1e300])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(big, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(4, 2**63 - 1), (2, 2**63 - 1), (1, 2**63 - 1), (3, -(2**63))]


@pytest.mark.parametrize("seed", [0, 1])
def test_bars_and_steps(seed):
    """A block's answer is the brute force's, whatever the bar."""
    rng = np.random.default_rng(seed)
    x, q = np.floor(20 * rng.standard_normal((900, 5))), np.floor(20 * rng.standard_normal((40, 5)))
    x[100:160] = x[0]
    ids, q_ids, pivots = rng.permutation(900), rng.integers(0, 900, 40), x[:7]
    block = topk.Block.unpack(5, *topk.Block(ids, x, pivots).pack())
    for bar in (-np.inf, 0.0, 1500.0):
        for qid, v, best in zip(q_ids, q, topk.block_top_k(q_ids, q, np.full(40, bar), block, pivots, 5)):
            want = sorted((-float(r @ v), int(i)) for r, i in zip(x, ids) if i != qid)[:5]
            assert [b for b in best if -b[0] >= bar] == [w for w in want if -w[0] >= bar]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(12)] + [base[:3]] * 3)
    label = rng.integers(0, 2, len(x))
    rows = [(i, [float(c) for c in v], int(l), "z") for i, (v, l) in enumerate(zip(x, label))]
    odd = [(9000, [0.0] * 16, 1, None), (9001, None, 1, None), (9002, [1.0] * 16, None, None), (None, [1.0] * 16, 1, None), (9003, [float("inf")] * 16, 1, None)]
    found = vecdup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, n_links string")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = roots(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near)))])
    got = {r["vec_id"]: r for r in found}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (9000, 9001, 9002, None, 9003))
    assert vecdup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """Leaves dealt into small blocks give the same result."""
    monkeypatch.setattr(vecdup, "BLOCK", 30)
    test_vectors(spark)


def test_leaves_are_split_further(spark, monkeypatch):
    """More vectors than the sample's trees part: leaves stay small, links at the threshold are found."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, 0.931 * base + (1 - 0.931**2) ** 0.5 * side])  # pairs at 0.931
    for name, value in (("SAMPLE", 300), ("LEAF", 64), ("BLOCK", 200), ("SUB_SAMPLE", 200)):
        monkeypatch.setattr(vecdup, name, value)
    sizes = []
    large = vecdup._large
    monkeypatch.setattr(vecdup, "_large", lambda placed: (sizes.append(placed.groupBy("label", "leaf").count().agg(F.max("count")).first()[0]), large(placed))[1])
    vectors = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in vecdup.near_vectors(vectors).collect()}
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * near.sum() >= 5940
    assert all(found[i]["n_links"] <= near[i].sum() for i in found)
    assert sizes[0] > 400 and sizes[-1] <= 200


def test_large_group_of_near_vectors(spark, monkeypatch):
    """Real depth, and a third of the rows in one group: few copies of its rows, few lost links."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.concatenate([base, base + 0.02 * rng.standard_normal(base.shape), base[0] + 0.02 * rng.standard_normal((1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vecdup.Forest(x, 5, 6, 0.035)
    placed = np.concatenate([forest.leaves(x, t)[0] for t in range(5)])
    assert forest.split.any() and np.bincount(placed)[2000:].mean() < 25
    monkeypatch.setattr(vecdup, "BLOCK", 300)
    monkeypatch.setattr(vecdup, "LEAF", 64)
    vectors = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = vecdup.near_vectors(vectors).collect()
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in found}
    recall = sum(got.values()) / near.sum()
    assert all(got[i] <= near[i].sum() for i in got) and recall >= 0.99, recall
    assert all(got[i] >= 0.99 * near[i].sum() for i in range(2000, 3000))


def test_shards(spark):
    texts = [*corpus(), *corpus()]
    found = interleave(table(spark, texts), shards=7).collect()
    rows = [(f"src{i % 3 if i % 2 else 0}", hashlib.md5(f"{SEED}|{i}".encode()).hexdigest(), i) for i in range(len(texts))]
    n = Counter(r[0] for r in rows)
    order, seen = [], Counter()
    for s, h, i in sorted(rows):
        seen[s] += 1
        order.append(((2 * seen[s] - 1) / (2 * n[s]), "s" + s, h, i))
    place = {x[3]: p for p, x in enumerate(sorted(order))}
    for r in found:
        shard = place[r["doc_id"]] * 7 // len(texts)
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["shard"], r["size"], r["text_crc32"]) == (shard, len(raw) + 16, zlib.crc32(raw))
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(c)) for s, c in counts.items())
    assert interleave(table(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", None)], "doc_id long, text string, source string")
    assert interleave(odd, shards=2).count() == 3


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=80)).capitalize() + "."
    bad = lambda: "!! ".join(rng.choices(["BUY", "NOW", "FREE"], k=60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(500, None), (501, ""), (None, "x"), (502, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r["held"] and r["doc_id"] < 400]
    assert len(held) > 50 and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == len(rows)
    assert quality.fit_quality(docs, labels.limit(0)).score("anything") == 1.0


def test_quality_model_against_the_pair_sum():
    """Scores by the definition: every pair of features on its own, features by plain dictionaries."""
    rng = np.random.default_rng(6)
    model = quality.FactorisationMachine()
    model.bias, model.weights = 0.3, rng.standard_normal(model.weights.shape).astype(np.float32)
    model.factors = rng.standard_normal(model.factors.shape).astype(np.float32)
    words = random.Random(6).choices([f"W{i}" for i in range(3000)] + [f"w{i}" for i in range(50)], k=4000)
    for text in ("", "one", "Aa aA b b b", "x!\n\nx!", " ".join(words[:90])):
        slots, values = quality.features(text)
        assert len(set(slots.tolist())) == len(slots)
        by_slot = Counter()
        for w in text.split():
            by_slot[zlib.crc32(w.lower().encode()) & (quality.BUCKETS - 1)] += 1
        norm = sum(np.log1p(n) ** 2 for n in by_slot.values()) ** 0.5
        x = dict(zip(slots.tolist(), values.tolist()))
        assert all(abs(x[s] - np.log1p(n) / norm) < 1e-12 for s, n in by_slot.items())
        margin = model.bias + sum(float(model.weights[i]) * v for i, v in x.items())
        margin += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        assert abs(model.score(text) - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-5
    assert len(quality.features(" ".join(words))[0]) > 2000  # no feature of a long text is left out


def test_quality_edges(spark):
    """Ids that repeat teach once; no rows, and columns of the same names."""
    rows = [(i % 40, f"good words of number {i}" if i % 2 else "BAD !!! BAD", 7, "clash") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(400)], "doc_id long, quality int")
    seen = []

    class Spy(quality.FactorisationMachine):
        def fit(self, rows, labels, **more):
            seen.append(len(rows))
            super().fit(rows, labels, **more)

    original, quality.FactorisationMachine = quality.FactorisationMachine, Spy
    try:
        model = quality.fit_quality(docs, labels, max_rows=20)
    finally:
        quality.FactorisationMachine = original
    assert 10 < seen[0] <= 20
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, model)
    assert found.count() == 400 and dict(found.dtypes)["score"] == "double" and dict(found.dtypes)["predicted"] == "int"
    assert quality.score_quality(docs.limit(0), model).count() == 0 and quality.fit_quality(docs.limit(0), labels).score("x") == 1.0


def test_pipeline(spark, tmp_path):
    texts = corpus()
    table(spark, texts).drop("component_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert seen[1].count() == len(texts)  # one class only: nothing is known against any
    groups = neardup.near_duplicates(docs).filter("kept").select("doc_id")
    assert sorted(r[0] for r in seen[2].select("doc_id").collect()) == sorted(r[0] for r in groups.collect())
    left = {r["doc_id"]: split_words(r["text"]) for r in seen[3].collect()}
    again = Counter(tuple(w[j : j + 50]) for w in left.values() for j in range(len(w) - 49))
    assert len(left) == seen[2].count() and max(again.values()) == 1
    pieces = seen[4].collect()
    assert {r["doc_id"] for r in pieces} == set(left)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_pipeline_loses_no_text(spark, tmp_path):
    """Rows that share an id, or have none, are documents of their own; clashing names and null texts stay as they are."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices([f"v{i}" for i in range(5000)], k=60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, 1), (1, b, 2), (1, a, 3), (None, c, 4), (None, c, 5), (None, d, 6), (2, b, 7), (None, None, 8), (None, None, 9), (4, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumns({"kept": F.lit("x"), "_h": F.lit(None).cast("string")})
    (_, classify), (_, near), (_, cut), (_, pack) = corpus_pipeline.STAGES
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    first = classify(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and first.count() == len(rows)
    second = near(spark, docs, "")
    assert second.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["score"]) for r in second.collect()) == sorted([(1, a, 1), (1, b, 2), (0, c, 4), (0, d, 6), (0, "", 8), (0, "", 9), (4, "", 10)])
    third = cut(spark, docs, "")
    assert third.columns == docs.columns and sorted(len((r["text"] or "").split()) for r in third.collect()) == sorted([0] * 9 + [60])
    assert pack(spark, docs, "").count() == len(rows)
    lazy = cut(spark, near(spark, docs, ""), "")  # two stages, nothing written in between
    assert lazy.count() == 7
    for stage in (near, cut, pack):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Columns that are named like those a stage works with come out as they went in; very long texts pass whole."""
    names = ["th", "_k", "_n", "_kept", "_th", "_no_id", "row", "_all", "_many", "a.b", "c`d", "n_words", "fp"]
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices([f"v{i}" for i in range(9000)], k=n))
    a, b, long = text(60), text(70), text(200_000)
    texts = [a, a, b + " " + a, None, "", long]
    rows = [(i, t, *(f"mine {i} {c}" for c in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names]).withColumn("n_chars", F.char_length("text"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, docs, str(tmp_path))
    second = stages["MinHash near-dedup"](spark, docs, "")
    third = stages["substring dedup"](spark, docs, "")
    for out, left in ((first, 6), (second, 5), (third, 6)):
        assert out.schema == docs.schema or out.columns == docs.columns
        found = out.collect()
        assert len(found) == left
        for r in found:
            assert list(r)[2:-1] == [f"mine {r['doc_id']} {c}" for c in names]
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    assert texts[0] == texts[1] == "" and texts[2] == b and texts[3] is None and texts[5] == long
    assert {r["doc_id"] for r in second.collect()} == {0, 2, 3, 4, 5}
    packed = stages["best-fit packing"](spark, docs, "").collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 5) > 200_000


def test_shards_spread_a_hot_id(spark):
    """A third of the rows share an id and a text, a third have no id: no bucket of ranks holds more than a few."""
    rows = [(7, "same", "s")] * 900 + [(None, f"t{i % 3}", "s") for i in range(900)] + [(i + 1000, "x" * (i % 50), "s") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = interleave(docs, shards=9).collect()
    assert Counter(r["shard"] for r in found) == {s: 300 for s in range(9)}
    for test in (lambda r: r["doc_id"] == 7, lambda r: r["doc_id"] is None):
        assert all(50 <= n <= 150 for n in Counter(r["shard"] for r in found if test(r)).values())
    assert interleave(spark.createDataFrame([(1, "y" * 3_000_000, None)], "doc_id long, text string, source string"), shards=2).first()["size"] == 3_000_016


def test_near_duplicates_that_share_a_passage_meet_in_no_list(spark, monkeypatch):
    # Lists of a frequent passage's values had all texts that hold it and cost the square of their number.
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(150)]
    texts += [t + " more" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = neardup.shingle_sets(docs, "doc_id", "text", 4).selectExpr("doc_id AS id", "n_shingles AS n", "sig")
    assert neardup._shared_lists(classes).groupBy("key").count().agg({"count": "max"}).first()[0] <= 20
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=4).collect()}
    assert found == {i: i - 150 if i >= 150 else i for i in range(160)}


def test_near_duplicates_with_a_hot_family(spark):
    """A third of the rows are near copies of one text and share an id with nothing else."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(200)]
    rows += [(5000, rows[3][1]), (5000, rows[450][1]), (5000, rows[451][1])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    group = {r["doc_id"] for r in got if r["component_id"] == 0}
    assert group == {*range(400), 5000, rows[450][0], rows[451][0]}
    assert sum(r["kept"] for r in got) == len({r["component_id"] for r in got})


def test_quality_fits_on_books_in_little_memory(spark, tmp_path):
    """Long labelled texts: rows of features are read one at a time, and a long text scores like a short one by itself."""
    import tracemalloc

    rng = random.Random(8)
    text = lambda i: " ".join(f"{'good' if i % 2 else 'bad'}{rng.randrange(40_000)}" for _ in range(20_000))
    rows = [(i, text(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tracemalloc.start()
    model = quality.fit_quality(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # the model and its gradients; all rows at once would take 2 MB each in a list
    some = [rows[0][1], "", rows[1][1], "short"]
    assert np.allclose(model.score_all(some), [model.score(t) for t in some], atol=1e-5)


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
