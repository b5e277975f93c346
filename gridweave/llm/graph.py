"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

#: Edges that a task contracts at a time.
EDGES = 50_000


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) for each node of the edges (a, b) of a task: b is the smallest node that the task's edges connect it with."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["a", "b"])

    return edges.mapInArrow(joined, "a long, b long")


def components(edges: DataFrame, shelf: Shelf, most: int = EDGES) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node it is connected with.

    Tasks contract about ``most`` edges each; as soon as one task can take all that are left, its trees are the components. Until
    then alternating large-star and small-star steps. Each step is two grouped minima and joins, so a node with very
    many neighbours is summed before the shuffle; the number of rounds grows with the logarithm of the
    longest path. Null ends and loops are ignored; an empty table gives an empty table.
    """
    now = shelf.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    count = now.count()
    if count > most:
        trees = shelf.put(contracted(now.coalesce(ceil(count / most))).where("a <> b").distinct())
        shelf.drop(now)
        now = trees
    mark = None
    while True:
        here = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if here[0] <= most:
            return contracted(now.coalesce(1)).toDF("node", "label")
        if here == mark:
            break
        mark = here
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = shelf.put(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        shelf.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
