"""Connected components: one task's union-find for a graph of a checked size, rounds of stars beyond it.

Nothing of the graph reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Edges that one task may hold: 16 MB of them, and about 300 MB of Python's tables.
TASK_EDGES = 1_000_000


def _united(batches):
    """Roots of the nodes of all edges in this task: the smallest node of each tree."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def find_new(x: int) -> int:
        root.setdefault(x, x)
        return find(x)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find_new(a), find_new(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root for every node of the edges a, b (longs): root is the smallest node that links reach.

    Loops, doubled and null-free edges in either direction are fine; no edges give no rows. Up to task_edges edges are
    united in one task. Beyond that, large-star and small-star rounds alternate, each cut by a table in the shared
    folder; a hub's edges are not gathered there, only its smallest neighbour is, by partial aggregation.
    """
    edges = edges.select("a", "b").filter("a <> b")
    if small(edges, task_edges):
        return written(edges.coalesce(1).mapInArrow(_united, "node long, root long"), "roots")
    stars = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(stars.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        # small-star: every larger node points at its smallest neighbour, and so do its other smaller neighbours
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        tied = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).filter("v > m")
        stars = written(tied.unionAll(low.select("v", F.col("low").alias("m"))).distinct(), "stars")
        state = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
