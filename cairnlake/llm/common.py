"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.plans.spool import spool_dir

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that a worker holds Python objects of few rows at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def n_words(text: Column) -> Column:
    """Number of words of a string column as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() separates at exactly the six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    path = f"{spool_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A spooled table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def _width(c: Column, t: T.DataType) -> Column:
    """Bytes of a value."""
    if isinstance(t, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StringType | T.BinaryType | T.ArrayType):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + _width(x, t.elementType)), F.lit(0)) + 24
        return F.greatest(F.size(c), F.lit(0)) * _fixed(t.elementType) + 24
    if isinstance(t, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in t.fields), F.lit(16))
    return F.lit(8)


def _fixed(t: T.DataType) -> int:
    return 16 + sum(_fixed(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else 8


def broadcast_if_small(spooled: DataFrame, most: int | None = None) -> DataFrame:
    """A spooled table with a broadcast hint if its rows are of at most ``most`` bytes; else as it is, for a shuffled join."""
    n = spooled.agg(F.sum((sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in spooled.schema.fields), F.lit(16))).cast("long"))).first()[0] or 0
    return F.broadcast(spooled) if n <= (BROADCAST_BYTES if most is None else most) else spooled
