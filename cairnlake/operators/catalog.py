"""Catalogs of runs: newest wins, merges, overlays, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], order: Column | list[Column], value: Column) -> DataFrame:
    """For each key the value of its newest change, by partial aggregation rather than by sorting a window."""
    by = F.struct(*order) if isinstance(order, list) else order
    return changes.groupBy(*keys).agg(F.max_by(value, by).alias("value"))


def replay(changes: DataFrame, keys: list[str], order: list[Column], value: Column, removed: Column) -> DataFrame:
    """The state after ordered changes: the newest value of each key that its newest change does not remove."""
    got = changes.groupBy(*keys).agg(F.max_by(F.struct(value.alias("value"), removed.alias("removed")), F.struct(*order)).alias("x"))
    return got.where("NOT x.removed").select(*keys, "x.value")


def merge_runs(runs: DataFrame, pack: str, generation: str) -> DataFrame:
    """Entries of the newest run of each pack; older runs of it are superseded whole."""
    newest = runs.groupBy(pack).agg(F.max(generation).alias(generation))
    return runs.join(newest, [pack, generation], "left_semi")


def overlay(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of either side; the delta's value where it has the key, and where each came from."""
    b = base.select(*keys, F.col(value).alias("_base"), F.lit(True).alias("_in_base"))
    d = delta.select(*keys, F.col(value).alias("_delta"), F.lit(True).alias("_in_delta"))
    both = b.join(d, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_in_delta"), F.col("_delta")).otherwise(F.col("_base")).alias(value), F.when(F.col("_in_delta"), "delta").otherwise("base").alias("tier"))


def newest_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def shard_bits(total: int, target: int, most: int = 16) -> int:
    """The least number of bits b such that ``total`` bytes in 2^b shards are ``target`` each at most."""
    bits = 0
    while bits < most and total > target << bits:
        bits += 1
    return bits


def shards(rows: DataFrame, digest: Column, bits: int) -> DataFrame:
    """Rows with the shard that the first bits of a hexadecimal digest name."""
    return rows.withColumn("shard", F.shiftrightunsigned(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits))


def compose(older: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """One delta (keys, value, removed) that does what ``older`` and then ``newer`` do; removals stay, as what lies below may have the key."""
    o, n = older.select(*keys, F.struct("value", "removed").alias("_o")), newer.select(*keys, F.struct("value", "removed").alias("_n"))
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("_n", "_o").alias("_x")).select(*keys, "_x.value", "_x.removed")


def apply_delta(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` (keys, value) with the delta's values, without what it removes."""
    met = base.select(*keys, F.col("value").alias("_v")).join(delta.select(*keys, "value", "removed", F.lit(True).alias("_in")), keys, "full_outer")
    return met.where("_in IS NULL OR NOT removed").select(*keys, F.when(F.col("_in"), F.col("value")).otherwise(F.col("_v")).alias("value"))


def dense_retention(rows: DataFrame, retained: DataFrame, keys: list[str], shard: str = "shard") -> DataFrame:
    """(shard, n, n_lost, rewrite): entries of each shard, those a collection drops, and whether the shard must be written anew; a dense one stays as it is."""
    met = rows.join(retained.select(*keys).distinct().withColumn("_kept", F.lit(1)), keys, "left")
    lost = F.count("*") - F.count("_kept")
    return met.groupBy(shard).agg(F.count("*").alias("n"), lost.alias("n_lost"), (lost > 0).alias("rewrite"))


def repairing_read(wanted: DataFrame, near: DataFrame, far: DataFrame, key: str) -> DataFrame:
    """(key, digest, data, state) of a read of (key, digest) that heals: ``near`` if it is intact, else ``far``.

    Both have (key, data). ``state``: healthy, repaired (rows to be written back to the near tier) or lost, with null data.
    """
    met = wanted.select(key, "digest").join(near.select(key, F.col("data").alias("_near")), key, "left").join(far.select(key, F.col("data").alias("_far")), key, "left")
    intact = lambda c: F.sha2(F.col(c), 256) == F.col("digest")
    state = F.when(intact("_near"), "healthy").when(intact("_far"), "repaired").otherwise("lost")
    return met.select(key, "digest", F.when(intact("_near"), F.col("_near")).when(intact("_far"), F.col("_far")).alias("data"), state.alias("state"))
