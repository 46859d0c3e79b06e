"""Connected components of a link table that stays distributed.

Each partition first reduces its links to a spanning forest.  Then large-star
and small-star rounds alternate until nothing changes: every node hangs under
its smallest neighbour, so a star of any size stays a star and a path halves.
The table is written to the shared folder after each round; only a truth value
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.scratch import discard, materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch, reduced to (larger, smallest) stars of its own components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        stars = [(x, root(x)) for x in parent]
        stars = [(x, r) for x, r in stars if x != r]
        cols = list(zip(*stars)) if stars else [(), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether every link hangs a node under its only root: no node has two, and no root has one."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root"), F.lit(0).alias("down")).union(edges.select("b", F.lit(None).cast("long"), F.lit(1)))
    ends = ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("down").alias("down"))
    return ends.filter("low < high OR low IS NOT NULL AND down = 1").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60, forests: bool = False) -> DataFrame:
    """``node, component`` for every node that has a link to another one; ``component`` is its smallest node.

    ``links`` has two long columns ``a`` and ``b``; nulls and self-links count for nothing.
    ``forests``: each partition's links are (larger, smallest) stars already.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = materialize(edges if forests else edges.mapInArrow(_forest, "a long, b long"), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Two written tables with nothing but a shuffle in between: adaptive execution can split a hub of any number of links.
        low = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node has few smaller neighbours by now, at most one for each task of the first step.
        large = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = large.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        old, edges = edges, materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        discard(old, low)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct().union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
