"""Connected components of a table of links, by contraction; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import spool


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of a link (a, b): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, shortens the chains fourfold and
    contracts the links; rounds grow with the logarithm of the longest chain. Nulls
    and loops are ignored, repeated links count once, no links give an empty table.
    """
    edges = spool(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("x"), F.least("a", "p").alias("p"))
        up = _jump(spool(up, "cc-up"))
        up = spool(_jump(up), "cc-up")
        roots = spool(roots.join(up.select(F.col("x").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        to = lambda c: up.select(F.col("x").alias(c), F.col("p").alias(f"{c}p"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("ap <> bp")
        edges = spool(moved.select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).distinct(), "cc-edges")
    return roots


def _jump(up: DataFrame) -> DataFrame:
    return up.join(up.select(F.col("x").alias("p"), F.col("p").alias("pp")), "p", "left").select("x", F.coalesce("pp", "p").alias("p"))
