"""Key-value reads: batches, prefixes, pages, generations and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE, MAX_KEYS, MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_BATCH_BYTES = 1024, 4096, 4096, 1 << 20, 16 << 20


def multi_get(requested: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """A row for each requested (ordinal, key), duplicates and misses included; columns of ``table`` are null for misses."""
    return requested.join(table, key, "left")


def flags(requested: DataFrame, table: DataFrame, keys: list[str], name: str = "present") -> DataFrame:
    """Each requested row with whether ``table`` has its key."""
    there = table.select(*keys).distinct().withColumn(name, F.lit(True))
    return requested.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def under(name: Column, prefix: str) -> Column:
    """Whether a name is ``prefix`` or stands under it; "ab" is not under "a"."""
    return (name == prefix) | name.startswith(prefix + "/")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least byte string beyond all that start with ``prefix``; None if there is none."""
    for k in range(len(prefix) - 1, -1, -1):
        if prefix[k] != 0xFF:
            return prefix[:k] + bytes([prefix[k] + 1])
    return None


def text_prefix_end(prefix: str) -> str | None:
    """The same for texts, which are ordered by their bytes as UTF-8, so by code points; surrogates are skipped."""
    for k in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[k]) + 1
        c = 0xE000 if 0xD800 <= c <= 0xDFFF else c
        if c <= 0x10FFFF:
            return prefix[:k] + chr(c)
    return None


def raw_prefix(key: Column, prefix: bytes | str, after: bytes | str | None = None) -> Column:
    """A range condition that reaches the scan: keys with a raw prefix, beyond a cursor. Bytes for a BINARY column, text for a string column."""
    if after is not None and not after.startswith(prefix):
        raise ValueError("the cursor is outside the prefix")
    where = key >= F.lit(prefix)
    if (end := prefix_end(prefix) if isinstance(prefix, bytes) else text_prefix_end(prefix)) is not None:
        where &= key < F.lit(end)
    return where & (key > F.lit(after)) if after is not None else where


def page(table: DataFrame, key: str, limit: int, after: object = None, *, ties: list[str] | None = None) -> DataFrame:
    """The ``limit`` rows of least key beyond ``after``: a keyset page. ``ties`` order rows of one key."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
    rows = table if after is None else table.where(F.col(key) > F.lit(after))
    return rows.orderBy(key, *(ties or [])).limit(limit)


def page_bytes(table: DataFrame, key: str, size: Column, limit: int, most: int, after: object = None) -> DataFrame:
    """A keyset page that also ends before its sizes sum to more than ``most``; its first row always fits."""
    rows = page(table, key, limit, after).withColumn("_size", size)
    order = Window.orderBy(key)  # over the rows of one page
    upto = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto).withColumn("_n", F.row_number().over(order)).where((F.col("_upto") <= most) | (F.col("_n") == 1)).drop("_size", "_upto", "_n")


def as_of(table: DataFrame, generation: int, column: str = "generation") -> DataFrame:
    """Rows born by a generation."""
    return table.where(F.col(column) <= generation)


def as_of_get(requested: DataFrame, table: DataFrame, key: str, generation: int, column: str = "generation") -> DataFrame:
    """A batch read at a generation: what was born later reads as missing."""
    return requested.join(as_of(table, generation, column), key, "left")


def first_conflicts(checks: DataFrame, current: DataFrame, key: str, batch: str = "batch") -> DataFrame:
    """For each batch of checks (batch, ordinal, key, expected) the least ordinal whose expectation fails; none if all hold."""
    met = checks.join(current.select(F.col(key), F.col("value").alias("_now")), key, "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("_now"))).groupBy(batch).agg(F.min("ordinal").alias("first_conflict"))


def first_inserts(rows: DataFrame, keys: list[str], order: list[str], name: str = "inserted") -> DataFrame:
    """Rows with whether each is the one that inserts its key: the least of it by ``order``, which must tell its rows apart. No window sorts a hot key."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, keys).withColumn(name, F.struct(*order) == F.col("_first")).drop("_first")
