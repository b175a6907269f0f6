"""Connected components of an edge table, by minimum neighbours and pointer jumping in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node of an edge.

    Alternates large-star and small-star: each node links its larger, then its smaller neighbours to the least node it
    knows, until nothing changes, in a number of rounds logarithmic in the graph. Each round is a partial aggregate and a
    join on the node, and leaves at most as many edges as before, so no neighbourhood is gathered in one task. Null ends
    and self links are ignored; repeated edges count once; no edges give no rows; an error if ROUNDS rounds don't do.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(ROUNDS):
        turned = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below shuffles both sides and Spark can split the neighbours of a hub over tasks.
        least = written(turned.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large-star: every neighbour above u goes to the least of u's neighbourhood.
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: u and its neighbours below it go to the least of those.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = written(nxt, "edges")
        # Done when every edge leads to a root: no right end is a left end, and no left end has two right ends.
        n, nodes = nxt.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            now = nxt
            break
        discard(now, least)
        now = nxt
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
