"""Connected components of a graph of links, by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.session import written

#: Rounds after which a graph that has not settled raises an error; rounds grow with the logarithm of a component's diameter.
MOST_ROUNDS = 60


def _nearest(edges: DataFrame, key: str, other: str) -> DataFrame:
    """The smallest neighbour of each node; a written table, so that the join with it can split a node with many links."""
    return written(edges.groupBy(key).agg(F.min(other).alias("m")), "nearest")


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node u that isn't the smallest of its component, and that smallest node v. links: columns u and v.

    Each round gives every node's larger neighbours (large star), then its smaller ones (small star) its smallest neighbour as
    theirs. No node's neighbours are ever gathered: the smallest is a partial aggregate, and the rest is a join.
    """
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == (now["n"], now["x"]) or not now["n"]:
            return edges
        before = (now["n"], now["x"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _nearest(both, "u", "v")
        large = written(edges.select(F.col("v").alias("u"), F.col("u").alias("b")).join(low, "u").select(F.col("b").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        low = _nearest(large, "u", "v")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError("the components have not settled")
