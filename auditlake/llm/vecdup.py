"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits recursively by random directions at the median; vectors
within ``spill`` of a split go to both sides.  A node whose sampled vectors
mostly would, like a large group of near copies, isn't split.  A pair at cosine 0.93 differs by
about 0.05 along a random direction of 64 dimensions, so a split parts few
pairs, and a pair that one tree parts is found by another.  Directions and
medians are fitted on a bounded hash sample; every vector is routed through
all trees.  A leaf beyond ``BLOCK`` rows, as such a sample leaves in a large
table, gets a subtree of its own, fitted and applied in Spark, and so on until
leaves are small.  All vectors of a leaf are compared; a leaf that can't be
split, a large group of near copies, is dealt into hash blocks, and each pair
of blocks is a group of its own.

No pair leaves its group.  A pair is counted only in its first common leaf, which
both vectors' leaf lists tell, so each group sends one count per vector, and for
the components a spanning forest.  Equal vectors of a label are one class.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import connected_components
from auditlake.llm.scratch import discard, materialize
from auditlake.llm.topk import usable
from auditlake.llm.words import mix

SAMPLE = 32768
LEAF = 256
#: Sampled vectors that a node must have had to be split.
SPLIT_SAMPLE = 32
#: Rows of a leaf that one block takes; a task holds two blocks.  Leaves of more rows are split further.
BLOCK = 4096
#: Vectors of such a leaf, about, that its subtree is fitted on.
SUB_SAMPLE = 4096
_ROWS = 512
#: Leaves that are compared at once when a pair's first common leaf is looked for.
_LEAVES = 1024


class Forest:
    """Directions (tree, node, dimension), thresholds (tree, node) and which nodes are split, of binary trees."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.spill, self.trees = depth, spill, trees
        nodes, dim = (1 << depth) - 1, sample.shape[1] if sample.ndim == 2 else 1
        self.directions = rng.standard_normal((trees, max(nodes, 1), dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, max(nodes, 1)))
        self.split = np.zeros((trees, 2 * nodes + 1), bool)
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                p = sample[mine] @ self.directions[t, node]
                cut = np.median(p) if len(p) else 0.0
                if 2 * np.count_nonzero(np.abs(p - cut) <= spill) >= len(p):  # no vectors, or most would go both ways
                    continue
                self.cuts[t, node], self.split[t, node] = cut, True
                at[mine] = 2 * node + 1 + (p > cut)

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves they fall in, spilled rows several times."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        ended = []
        for _ in range(self.depth):
            ends = ~self.split[tree][node]
            ended.append((row[ends], node[ends]))
            row, node = row[~ends], node[~ends]
            p = np.einsum("ij,ij->i", x[row], self.directions[tree][node]) - self.cuts[tree][node]
            left, right = p <= self.spill, p >= -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return tuple(np.concatenate(c) for c in zip(*ended, (row, node)))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _incidence(leaves: list[np.ndarray]) -> np.ndarray:
    """Vectors and the leaves that more than one of them are in, 1 where one is in the other."""
    sizes = [len(x) for x in leaves]
    names, column, held = np.unique(np.concatenate(leaves), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(leaves)), sizes), held > 1
    place, kept = np.cumsum(shared) - 1, shared[column]
    out = np.zeros((len(leaves), int(shared.sum())), np.uint8)
    out[row[kept], place[column[kept]]] = 1
    return out


def leaf_links(x: np.ndarray, weight: np.ndarray, seen: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the unit vectors of one group: weighted counts of links that no earlier leaf has, and a component label each.

    ``seen`` is an incidence matrix of vectors and earlier leaves.  With
    ``side``, only vectors of different sides are compared.
    """
    n = len(x)
    counts, label = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, _ROWS):
        rows = np.arange(a, min(a + _ROWS, n))
        linked = x[rows] @ x.T >= threshold
        if side is None:
            linked[np.arange(len(rows)), rows] = False
        else:
            linked &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        i = i + a
        while len(i):  # hook labels until every link lies within one
            li, lj = label[i], label[j]
            differ = li != lj
            if not differ.any():
                break
            i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
            low = np.minimum(li, lj)
            np.minimum.at(label, li, low)
            np.minimum.at(label, lj, low)
            while (label[label] != label).any():
                label = label[label]
        for k in range(0, seen.shape[1], _LEAVES):
            part = seen[:, k : k + _LEAVES].astype(np.float32)
            linked &= part[rows] @ part.T == 0
        counts[rows] = linked @ weight
    return counts, label


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, trees: int = 5, spill: float = 0.035) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Only vectors of equal, non-null label and as many components are compared.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without id or label, link with nothing; a null id has a null
    component and is kept.  Rows that repeat an id share its component.  Further columns are
    ignored; an empty table gives no rows.
    """
    nonzero = F.exists(F.col("vec"), lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    able = usable(F.col("vec")) & nonzero & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(7), "vec"))
    whole = rows.filter("able")
    classes = whole.groupBy("label", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("vec_id", "vec")).alias("r"))
    classes = classes.select("label", "h1", "h2", "n", F.col("r.vec_id").alias("id"), F.col("r.vec").alias("vec"), F.size("r.vec").alias("dim"))
    classes = materialize(classes.withColumn("ck", F.xxhash64("label", "h1", "h2")), "vectors")

    parts = []
    for dim, largest in classes.groupBy("dim", "label").agg(F.count("*").alias("c")).groupBy("dim").agg(F.max("c")).orderBy("dim").collect():  # a row per vector length
        parts.append(_search(classes.filter(F.col("dim") == dim), dim, largest, threshold, trees, spill))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = materialize(found, "found")
    counts = found.groupBy("ck").agg(F.sum("links").alias("links"))
    same = whole.groupBy("vec_id").agg((F.min("h1") < F.max("h1")).alias("m"), F.min("h1").alias("h1")).filter("m").select("vec_id")
    again = whole.join(same, "vec_id").join(classes.select("label", "h1", "h2", "id"), ["label", "h1", "h2"]).select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(again))
    known = classes.join(counts, "ck", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "h1", "h2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "label", "h1", "h2", "able").join(known, ["label", "h1", "h2"], "left")
    links = F.when(F.col("able"), F.col("links") + F.col("n") - 1).otherwise(0).cast("long")
    comp = F.when(F.col("able"), F.col("component")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", links.alias("n_links"), comp.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _large(placed: DataFrame) -> DataFrame:
    """Leaves beyond a block: ``label, leaf, c``."""
    return placed.groupBy("label", "leaf").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK)


def _split_further(placed: DataFrame, large: DataFrame, vectors: DataFrame, dim: int, spill: float) -> DataFrame:
    """``label, leaf, ck`` after subtrees have split the large leaves, again and again, except those that no direction splits."""
    leaf = ["label", "leaf"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        depth = max(1, int(math.log2(max(2, len(x) / SPLIT_SAMPLE))))
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "leaf": pdf["leaf"].iloc[:1], "tree": [pickle.dumps(Forest(x, 1, depth, spill, int(pdf["leaf"].iloc[0]) & 0xFFFFFFFF))]})

    def send(key: tuple, pdf: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        tree = pickle.loads(trees["tree"].iloc[0]) if len(trees) else None
        if tree is None or not len(pdf) or not tree.split[0, 0]:
            return pd.DataFrame({"label": pdf["label"], "leaf": pdf["leaf"], "ck": pdf["ck"], "stuck": True})
        x = np.stack(pdf["vec"].to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, node = tree.leaves(x, 0)
        names = mix(np.uint64(int(key[1]) & 0xFFFFFFFFFFFFFFFF) * np.uint64(1 << 14) + node.astype(np.uint64)).view(np.int64)
        return pd.DataFrame({"label": pdf["label"].to_numpy()[row], "leaf": names, "ck": pdf["ck"].to_numpy()[row], "stuck": False})

    done = []
    while not large.isEmpty():
        done.append(placed.join(large.hint("merge"), leaf, "left_anti").select(*leaf, "ck"))
        rows = placed.join(large.hint("merge"), leaf).join(vectors, "ck")
        chunks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("long")
        rows = materialize(rows.select(*leaf, "ck", "vec", "c", F.pmod(F.xxhash64("ck", F.lit(3)), chunks).alias("chunk")), "leaves")
        sample = rows.filter(F.pmod(F.xxhash64("ck", F.lit(9)), F.ceil(F.col("c") / F.lit(SUB_SAMPLE)).cast("long")) == 0)
        trees = sample.groupBy(*leaf).applyInPandas(fit, "label string, leaf long, tree binary")
        trees = trees.join(large.hint("merge"), leaf).select(*leaf, "tree", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        sent = rows.groupBy(*leaf, "chunk").cogroup(trees.groupBy(*leaf, "chunk")).applyInPandas(send, "label string, leaf long, ck long, stuck boolean")
        sent = materialize(sent, "sent")
        discard(rows)
        done.append(sent.filter("stuck").select(*leaf, "ck"))
        placed = sent.filter("NOT stuck").select(*leaf, "ck")
        large = materialize(_large(placed), "large")
    done.append(placed)
    return reduce(DataFrame.union, done)


def _search(classes: DataFrame, dim: int, largest: int, threshold: float, trees: int, spill: float) -> DataFrame:
    """``ck, id, links, root`` from every leaf for every class in it."""
    spark = classes.sparkSession
    sample = classes.select("id", "ck", "vec").orderBy(F.xxhash64("ck"), "id").limit(SAMPLE).select("vec").toArrow()
    x = _unit(sample.column(0).combine_chunks(), dim)
    depth = max(0, min(math.ceil(math.log2(largest / LEAF)), int(math.log2(max(1, len(x) / SPLIT_SAMPLE)))))
    forest = spark.sparkContext.broadcast(Forest(x, trees, depth, spill))  # at most SAMPLE / SPLIT_SAMPLE nodes a tree

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _unit(batch.column(4), dim)
            found = [f.leaves(u, t) for t in range(f.trees)]
            row = np.concatenate([r for r, _ in found])
            code = np.concatenate([(t << f.depth + 1) + leaf for t, (_, leaf) in enumerate(found)])
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(code, pa.int64()))
            at = pa.array(row)
            yield pa.record_batch([pa.array(code, pa.int64()), *(batch.column(i).take(at) for i in range(5)), lists.take(at)], names=["leaf", "label", "ck", "id", "n", "vec", "leaves"])

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in route(batches):
            yield batch.select(["label", "leaf", "ck"])

    members = classes.select("label", "ck", "id", "n", "vec")
    routed = members.mapInArrow(route, "leaf long, label string, ck long, id long, n long, vec array<double>, leaves array<long>")
    large = materialize(_large(members.mapInArrow(only, "label string, leaf long, ck long")), "large")
    if large.isEmpty():
        dealt = routed.withColumn("nb", F.lit(1).cast("long"))
    else:
        placed = materialize(_split_further(members.mapInArrow(only, "label string, leaf long, ck long"), large, members.select("ck", "vec"), dim, spill), "placed")
        lists = placed.groupBy("ck").agg(F.collect_list("leaf").alias("leaves"))  # a vector's own leaves
        large = materialize(_large(placed), "large")
        routed = placed.join(members.join(lists, "ck").drop("label"), "ck")
        dealt = routed.join(large.hint("merge"), ["label", "leaf"], "left").withColumn("nb", F.coalesce(F.ceil(F.col("c") / F.lit(BLOCK)).cast("long"), F.lit(1).cast("long"))).drop("c")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("ck", F.lit(5)), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("nb", "other")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u = np.stack(pdf["vec"].to_numpy())
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        side = None if key[2] == key[3] else pdf["mine"].to_numpy()
        counts, label = leaf_links(u, pdf["n"].to_numpy(), _incidence([x[x < key[1]] for x in pdf["leaves"]]), threshold, side)
        ids = pdf["id"].to_numpy()
        out = pd.DataFrame({"ck": pdf["ck"], "id": ids, "links": counts, "root": ids[label]})
        return out[(counts > 0) | (label != np.arange(len(label)))]

    return dealt.groupBy("label", "leaf", "lo", "hi").applyInPandas(compare, "ck long, id long, links long, root long")
