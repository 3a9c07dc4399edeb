"""Set algebra between inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.union, (p.select(*keys) for p in parts)).distinct()


def symmetric_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks, with the side that has them; empty if the inventories are equal."""
    return difference(left, right, keys).withColumn("side", F.lit("left")).union(difference(right, left, keys).withColumn("side", F.lit("right")))


def stale(physical: DataFrame, live: DataFrame, pinned: DataFrame, keys: list[str]) -> DataFrame:
    """What is stored, and neither live nor pinned."""
    return difference(physical, live, keys).join(pinned.select(*keys), keys, "left_anti")


def retained_violations(retained: DataFrame, objects: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """(check, ns, id): retained keys that are unknown, roots and link targets that are not retained."""
    key = ["ns", "id"]
    unknown = difference(retained, objects, key).select(F.lit("unknown").alias("check"), *key)
    lost_roots = difference(roots, retained, key).select(F.lit("root").alias("check"), *key)
    out = links.join(retained.select(F.col("ns").alias("sns"), F.col("id").alias("sid")), ["sns", "sid"], "left_semi")
    targets = out.select(F.col("dns").alias("ns"), F.col("did").alias("id"))
    return unknown.union(lost_roots).union(difference(targets, retained, key).select(F.lit("link").alias("check"), *key))
