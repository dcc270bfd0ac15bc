"""Connected components of an edge table: local union-find, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothspan.llm.scratch import cut


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each Arrow batch: every node is tied to the smallest node of its set."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        keep = np.array([x != r for x, r in zip(nodes, roots, strict=True)], dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(nodes, np.int64)[keep]), pa.array(np.array(roots, np.int64)[keep])], names=["u", "v"]
        )


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) of every node that an edge ties to a smaller one; component is the smallest node reachable.

    Nodes without edges and the smallest nodes themselves are left out. Each round is cut to a table; the number of rounds
    grows with the logarithm of the diameter. Edges stay distributed throughout.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    tied = cut(pairs.mapInArrow(_local_forest, "u long, v long").distinct(), name)  # u > v
    while True:
        # Large star: every neighbour above a node is tied to the smallest neighbour (or the node itself).
        both = tied.union(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.where("u <> v"), name)
        # Small star: the smaller neighbours of a node are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct(), name)
        n, roots, nodes = new.agg(F.count("*"), F.count_distinct("v"), F.count_distinct("u")).first()
        # Done when the edges form stars: each node has one edge, and no root is tied to another node.
        if n == nodes and (n == 0 or new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()):
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        tied = new
