"""Connected components of an edge table by alternating star contractions.

Large stars hang every larger neighbour of a node on the smallest one; small stars do
so for the smaller neighbours. Both keep components and end in a forest of stars after
a logarithmic number of rounds in practice. Each round is two aggregations with map-side
combining and joins with the edge table itself, so no neighbour list is ever gathered.
A union-find inside each task first shrinks the edges to a spanning forest; a table of
edges under one block's bound is done with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.llm.common import Scratch


#: Edges of one block of the union-find in a task.
BLOCK_EDGES = 500_000


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of edges: emits (node, root) with root < node.

    A block holds at most half a million edges, which bounds a task's memory; what
    blocks leave unjoined the star rounds join.
    """
    block: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def forest() -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for a, b in zip(
            np.concatenate([x[0] for x in block]).tolist(), np.concatenate([x[1] for x in block]).tolist(), strict=True
        ):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        found = [(x, root(x)) for x in parent]
        found = [x for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"]
        )

    for batch in batches:
        block.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        held += batch.num_rows
        if held >= BLOCK_EDGES:
            yield forest()
            block, held = [], 0
    if held:
        yield forest()


def _star(scratch: Scratch, edges: DataFrame, large: bool, label: str) -> DataFrame:
    """One contraction of edges (u, v) with u > v.

    The minima are written first: joined as a table, a hub with very many neighbours
    is an ordinary skewed join, which Spark splits.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.table(low, label)
        # neighbours larger than the node go to the smallest of the neighbourhood
        return (
            edges.select(F.col("v").alias("u"), F.col("u").alias("n"))
            .join(low, "u")
            .select(F.col("n").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
    low = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), label)
    hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(scratch: Scratch, edges: DataFrame, label: str = "cc", rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable, for every node of an edge.

    ``edges`` has integer columns a and b; loops and repeats do no harm, null ends are
    ignored. An empty edge table gives an empty result.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    one_block = edges.count() < BLOCK_EDGES
    if one_block:  # then the union-find of one task is all there is to do
        pairs = pairs.coalesce(1)
    now = scratch.table(pairs.mapInArrow(spanning_forest, "u long, v long"), f"{label}_0")
    last = f"{label}_0"
    for k in range(1, 1 if one_block else rounds + 1):
        # done when every node has one root and no root hangs on another node
        state = now.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).collect()[0]["n"]
        if state is None or (state == 1 and not now.join(now.select(F.col("v").alias("u")), "u", "left_semi").take(1)):
            break
        names = [f"{label}_{k}{x}" for x in ("_low_large", "_large", "_low_small", "")]
        large = scratch.table(_star(scratch, now, True, names[0]), names[1])
        after = scratch.table(_star(scratch, large, False, names[2]), names[3])
        scratch.drop(last, *names[:3])
        now, last = after, f"{label}_{k}"
    else:
        if not one_block:
            raise RuntimeError("components did not settle; raise rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
