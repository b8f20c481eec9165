"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a partition.
ROWS = 1 << 16

def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is one node of its component.

    Each round sends every node to the neighbour (or itself) that comes first in that round's pseudo-random order and
    contracts; a constant share of the nodes goes away per round whatever the graph's shape, so rounds grow with the
    logarithm of the size. Minima are pre-aggregated on the map side, and what is joined is cut first, so that a hub's
    rows can be split. Nothing is collected; loops and repeated edges are allowed, null ends are dropped.
    """
    links = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().filter("u <> v").distinct(), bare=True)
    few = 1 + links.count() // ROWS  # what follows is no more rows than these: no more files than they need
    links = links.coalesce(few)
    steps, k = [], 0
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while links.take(1):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))
        step = cut(both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["n"].alias("to")).coalesce(few), bare=True)
        steps.append(step)
        ends = links.join(step, "u").select(F.col("to").alias("x"), "v").coalesce(few)
        ends = ends.join(step.withColumnRenamed("u", "v"), "v").select("x", F.col("to").alias("y")).coalesce(few)
        links = cut(ends.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().coalesce(few), bare=True)
        k += 1
    found = nodes.select("node", F.col("node").alias("root")).coalesce(few)
    for step in steps:
        found = found.join(step.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")).coalesce(few)
    return cut(found, bare=True)
