"""Connected components of a graph given by its edges, by contracting stars.

In a round every node points to the least neighbour (or itself) in an order drawn anew for the round; each edge then goes
on between the nodes that its ends point to. A random order leaves a constant share of the nodes, so
the rounds are about the logarithm of the longest path. Least neighbours are a pre-aggregated minimum, so a node with
any number of edges is no burden for one task. When few edges are left (SMALL, a fixed bound), one task finishes them. Each
round's tables are stored; the driver sees one count a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


SMALL = 20_000  # edges that one task may finish


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the few edges that are left: (at, to)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["at", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node that has an edge to another one, with the smallest id of its component. Ids are
    longs. Null ends, loops and repeated edges don't matter; no edges give no rows."""
    left = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    nodes = None  # (id, now): what stands for each node now
    seed, count = 0, left.count()
    while count:
        if count <= SMALL:
            to = left.repartition(1).mapInArrow(_finished, "at long, to long")
        else:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            order = F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), F.col("b").alias("id"))
            own = F.struct(F.xxhash64("a", F.lit(seed)).alias("h"), F.col("a").alias("id"))
            least = both.groupBy("a").agg(F.min(order).alias("least"))
            to = least.select(F.col("a").alias("at"), F.least("least", own)["id"].alias("to"))
        to = stored(to, "pointers")
        if nodes is None:
            nodes = to.select(F.col("at").alias("id"), F.col("to").alias("now"))
        else:
            nodes = stored(nodes.join(to, nodes["now"] == to["at"], "left").select("id", F.coalesce("to", "now").alias("now")), "nodes")
        if count <= SMALL:
            break
        ends = left.join(to.select(F.col("at").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        left = stored(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        seed, count = seed + 1, left.count()
    if nodes is None:
        return left.select(F.col("a").alias("id"), F.col("a").alias("component"))
    names = nodes.groupBy("now").agg(F.min("id").alias("component"))
    return nodes.join(names, "now").select("id", "component")
