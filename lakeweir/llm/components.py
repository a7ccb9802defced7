"""Connected components of a link table, by alternating star contractions on DataFrames.

Nothing is collected: each round is two grouped minima (combined on the map side) and two joins, and lineage is cut by a
checkpoint. Before the first round every task contracts its own links to a forest, which shortens long chains. The number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweir.llm.common import checkpointed, map_batches


def find(parent: dict, x):
    """The root of x, with the path to it shortened."""
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent: dict = {}
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(parent, x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links (two bigint columns) -> node, component: the smallest node reachable, for every node that has a link."""
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    edges = checkpointed(map_batches(edges, _forest, "u bigint, v bigint").filter("u <> v").distinct())
    before, last = None, edges
    while True:
        # large star: each larger neighbour of a node points to the smallest of its neighbourhood
        around = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(around, "v").select("u", F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each smaller neighbour, and the node itself, points to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        # equal sums say that it may be over, equal rows that it is
        if now == before and edges.join(last, ["u", "v"], "left_anti").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before, last = now, edges
