"""Synchronization between two inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators.closure import closure


def plan(source: DataFrame, destination: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """For each key of the source: transfer if absent, skip if equal, conflict if different."""
    d = destination.select(*keys, F.col(digest).alias("_there"))
    status = F.when(F.col("_there").isNull(), "transfer").when(F.col("_there") == F.col(digest), "skip").otherwise("conflict")
    return source.join(d, keys, "left").select(*keys, status.alias("status"))


def root_moves(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """(name, old, new) of roots whose target changes or that are new."""
    c = current.select("name", F.col("target").alias("old"))
    return wanted.select("name", F.col("target").alias("new")).join(c, "name", "left").where(~F.col("old").eqNullSafe(F.col("new")))


def bounded_history(heads: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """(commit, depth, shallow): commits within ``depth`` of a head, at their least depth; shallow if parents are cut off.

    ``parents`` (commit, parent). A join per depth; the depth is a limit that the caller states.
    """
    frontier = heads.select("commit").distinct().withColumn("depth", F.lit(1).cast("long"))
    seen = frontier
    for d in range(2, depth + 1):
        frontier = frontier.join(parents, "commit").select(F.col("parent").alias("commit")).distinct().withColumn("depth", F.lit(d).cast("long"))
        seen = seen.union(frontier)
    got = seen.groupBy("commit").agg(F.min("depth").alias("depth"))
    more = parents.select("commit").distinct().withColumn("_more", F.lit(True))
    return got.join(more, "commit", "left").select("commit", "depth", ((F.col("depth") == depth) & F.col("_more").isNotNull()).alias("shallow"))


def finish_statuses(roots: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """(ns, id, status) of transferred roots: missing, incomplete (something it reaches is missing) or complete.

    What cannot be complete is found once for all roots, by walking links backwards from what is missing.
    """
    key = ["ns", "id"]
    there = objects.select(*key)
    lost = links.select(F.col("dns").alias("ns"), F.col("did").alias("id")).distinct().join(there, key, "left_anti")
    back = links.select(F.col("dns").alias("sns"), F.col("did").alias("sid"), F.col("sns").alias("dns"), F.col("sid").alias("did"))
    broken = closure(lost, back).select(*key).withColumn("_broken", F.lit(True))
    met = roots.select(*key).join(there.distinct().withColumn("_there", F.lit(True)), key, "left").join(broken, key, "left")
    return met.select(*key, F.when(F.col("_there").isNull(), "missing").when(F.col("_broken"), "incomplete").otherwise("complete").alias("status"))


def policies(roots: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, policy): of each root the rule (prefix, policy) of its longest prefix of whole components; null without one.

    Each root looks up its own ancestors, so that the rules are met by an equi-join.
    """
    c = F.split("name", "/")
    asked = roots.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array_join(F.slice(c, 1, i), "/"))).alias("n", "prefix"))
    met = asked.join(rules, "prefix", "left")
    return met.groupBy("name").agg(F.max_by("policy", F.when(F.col("policy").isNotNull(), F.col("n"))).alias("policy"))


def touch(roots: DataFrame, uses: DataFrame) -> DataFrame:
    """Roots (name, evictable, last_use) with the use of evictable ones raised to the newest of ``uses`` (name, at); it never falls."""
    newest = uses.groupBy("name").agg(F.max("at").alias("_at"))
    met = roots.join(newest, "name", "left")
    return met.withColumn("last_use", F.when(F.col("evictable"), F.greatest("last_use", "_at")).otherwise(F.col("last_use"))).drop("_at")
