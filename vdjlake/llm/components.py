"""Groups of directly or indirectly linked records by large-star / small-star.

Edges are rewritten in rounds until nothing changes. Large-star: every node
links its larger neighbours to the smallest node of its neighbourhood (itself
included). Small-star: every node links its smaller neighbours and itself to
the smallest of them. Both keep connectivity; at the fixed point each node
hangs on the smallest id of its component, and a chain of n records needs a
number of rounds that grows with log n, not with n.

Each half-round is one aggregate and one join on the node, both on the same
exchange key; the minimum per node is combined before the shuffle. A node linked
to a third of all others sends and receives its edges in the join, which AQE's
skew handling splits; its minimum is one row per task. After each round the
edge table is written to the shared folder, so lost executors cost one round at
most, and only two counts per round reach the driver.

Defined cases: self links and null ends are dropped; repeated and turned links
count once; a record without links is in no group; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import discard, table


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: for each node, its larger neighbours to the neighbourhood's minimum."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: for each node, its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Changes with the edge set: number of edges and an order-free sum of hashes."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node."""
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
        .where("__a is not null and __b is not null and u <> v")
        .select("u", "v")
        .distinct()
    )
    edges = table(edges, "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        after = table(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
