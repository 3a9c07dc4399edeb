"""Collection, integrity and eviction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.plans.spool import spool

KEY = ["ns", "id"]


def dead(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Objects that nothing live reaches."""
    return objects.join(live.select(*KEY), KEY, "left_anti")


def preview(objects: DataFrame, live: DataFrame) -> DataFrame:
    """For each namespace: objects, how many of them are live, and how many a collection would drop."""
    marked = objects.join(live.select(*KEY).withColumn("_live", F.lit(1)), KEY, "left")
    return marked.groupBy("ns").agg(F.count("*").alias("n_objects"), F.count("_live").alias("n_live"), (F.count("*") - F.count("_live")).alias("n_dead"))


def issues(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of findings (issue, ns, id) from a table of keys for each kind of issue."""
    return reduce(DataFrame.union, (df.select(F.lit(k).alias("issue"), *KEY) for k, df in parts.items()))


def dangling(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Targets of links that no object has."""
    return links.join(objects.select(F.col("ns").alias("sns"), F.col("id").alias("sid")), ["sns", "sid"], "left_semi").select(F.col("dns").alias("ns"), F.col("did").alias("id")).distinct().join(objects.select(*KEY), KEY, "left_anti")


def repair_plan(expected: DataFrame, stored: DataFrame, replica: DataFrame, key: str, digest: str) -> DataFrame:
    """For each expected payload: healthy, missing or corrupt, and whether the replica has it intact."""
    s = stored.select(F.col(key), F.col(digest).alias("_stored"))
    r = replica.select(F.col(key), F.col(digest).alias("_replica"))
    met = expected.join(s, key, "left").join(r, key, "left")
    state = F.when(F.col("_stored").isNull(), "missing").when(F.col("_stored") != F.col(digest), "corrupt").otherwise("healthy")
    action = F.when(state == "healthy", "none").when(F.col("_replica") == F.col(digest), "replace").otherwise("unavailable")
    return met.select(key, state.alias("state"), action.alias("action"))


def evict(rows: DataFrame, order: list[str], size: Column, need: int, buckets: Column) -> DataFrame:
    """The least rows, in order, whose sizes sum to ``need`` at least.

    ``buckets`` must rise with the order. Sums of buckets find the one in which the need is
    met; only that one is ordered row by row.
    """
    rows = rows.withColumn("_size", size).withColumn("_bucket", buckets)
    sums = rows.groupBy("_bucket").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row for each bucket
    sums = sums.withColumn("_before", before).where(F.col("_before") < need)
    met = rows.join(F.broadcast(sums), "_bucket")
    whole = met.where(F.col("_before") + F.col("_sum") <= need)
    last = met.where(F.col("_before") + F.col("_sum") > need)
    upto = F.col("_before") + F.coalesce(F.sum("_size").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("_upto", upto).where(F.col("_upto") < need).drop("_upto")
    return whole.unionByName(last).drop("_size", "_bucket", "_sum", "_before")


def counters(calls: DataFrame, operation: str, at: str, amount: Column) -> DataFrame:
    """(operation, calls, first_call, last_call, total) of each operation."""
    return calls.groupBy(operation).agg(F.count("*").alias("calls"), F.min(at).alias("first_call"), F.max(at).alias("last_call"), F.sum(amount).alias("total"))


def pinned_objects(pins: DataFrame, objects: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, pinned, n_retained): of each scope the newest generation that pins (scope, generation) hold, and how many of its objects were born by then."""
    held = pins.groupBy(scope).agg(F.max("generation").alias("pinned"))
    born = objects.select(scope, F.col("generation").alias("_born")).join(held, scope).where("_born <= pinned").groupBy(scope).agg(F.count("*").alias("n_retained"))
    return held.join(born, scope, "left").fillna(0, ["n_retained"])


def quarantine(facts: DataFrame, key: str, fact: str) -> DataFrame:
    """(key, fact, n, quarantined) of facts recorded about each key: the fact if all agree, else none, as no reader may trust any."""
    got = facts.groupBy(key).agg(F.min(fact).alias("_low"), F.max(fact).alias("_high"), F.count("*").alias("n"))
    return got.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(fact), "n", (F.col("_low") != F.col("_high")).alias("quarantined"))


def holders(roots: DataFrame, links: DataFrame, spared: DataFrame) -> DataFrame:
    """(ns, id, rank): of each object that roots (ns, id, rank) reach and that is not ``spared`` (ns, id) the greatest rank that reaches it.

    Ranks move along links in rounds; only what rose in a round moves on in the next.
    """
    out = spool(links.join(spared.select(F.col("ns").alias("dns"), F.col("id").alias("did")), ["dns", "did"], "left_anti"), "holder-links")
    best = spool(roots.join(spared, KEY, "left_anti").groupBy(*KEY).agg(F.max("rank").alias("rank")), "holders")
    fresh = best
    while not fresh.isEmpty():
        met = fresh.join(out, (F.col("ns") == F.col("sns")) & (F.col("id") == F.col("sid"))).groupBy(F.col("dns").alias("ns"), F.col("did").alias("id")).agg(F.max("rank").alias("rank"))
        known = best.select(*KEY, F.col("rank").alias("_known"))
        fresh = spool(met.join(known, KEY, "left").where("_known IS NULL OR rank > _known").select(*KEY, "rank"), "holders-fresh")
        best = spool(best.unionByName(fresh).groupBy(*KEY).agg(F.max("rank").alias("rank")), "holders")
    return best
