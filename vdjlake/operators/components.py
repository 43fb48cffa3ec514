"""Connected components by spreading the least label, with jumps along labels.

Used for the library's own graphs (clones, lineages, cohort clusters). Before
the first exchange each task contracts its edges: chunk by chunk a union-find
replaces them by one edge from each node to the least node it reaches there, so
dense groups send nodes and not edges. Then rounds over what is left: every node
takes the least label of itself and its neighbours, then the label of its label;
the jumps make long chains settle in a logarithmic number of rounds. Each round is
written to the shared folder and read back. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import discard, table

#: Edges that a task contracts at once.
CHUNK = 200_000


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of the edges x - y."""
    nodes, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    up = list(range(len(nodes)))  # numbers follow the order of the nodes

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    n = len(x)
    for i, j in zip(number[:n].tolist(), number[n:].tolist()):
        i, j = find(i), find(j)
        if i < j:
            up[j] = i
        elif j < i:
            up[i] = j
    return nodes, nodes[[find(i) for i in range(len(nodes))]]


def _contract(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        x, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
        nodes, roots = spanning(x, y)
        kind = held[0].schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(nodes, type=kind), pa.array(roots, type=kind)], names=["x", "y"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= chunk:
            yield done()
            held = []
    if held:
        yield done()


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``node, component``: every node of an edge with the least node of its component.

    Null ends are left out; a self link makes a component of one.
    """
    kind = dict(edges.dtypes)[a]
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    stars = table(e.mapInArrow(_contract, f"x {kind}, y {kind}"), "graph")
    both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = table(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("x"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        nxt = table(spread.join(hop, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = nxt.select("node", "label")
        labels._vdjlake_path = nxt._vdjlake_path
        if not nxt.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    discard(stars)
    return labels.select("node", F.col("label").alias("component"))


def with_singletons(nodes: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Every row of ``nodes`` with its component; rows without an edge are their own."""
    c = components.select(F.col("node").alias("__n"), "component")
    return nodes.join(c, F.col(key) == F.col("__n"), "left").drop("__n").withColumn("component", F.coalesce("component", key))
