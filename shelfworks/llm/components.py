"""Connected components of a link table, without collecting links or labels anywhere.

Each task first runs union-find over its own links and passes on one link per node to its root. Then rounds of hooking
to the smallest neighbour (large star, small star) halve the depth of what is left, each as two shuffles of the links; a
hot node is pre-aggregated before its shuffle and split by the planner in its join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfworks.llm.shared import dropped, in_batches, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: each node of them with its root, the smallest node it reaches there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root has a root of its own."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)")
    return seen.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node that is not its own root; the root is the smallest node of the component."""
    edges = in_batches(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")).mapInArrow(_forest, "u bigint, v bigint")
    edges = written(edges.distinct(), "links")  # u > v
    while not _flat(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.withColumnsRenamed({"u": "w", "v": "u"}).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.union(least.select("u", F.col("m").alias("v"))).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = written(in_batches(small.union(low.select("u", F.col("m").alias("v"))).withColumnsRenamed({"u": "a", "v": "b"})).mapInArrow(_forest, "u bigint, v bigint").distinct(), "links")
        dropped(step.sparkSession, edges)
        edges = step
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
