"""Payloads as chunks: by lines in SQL, or by content in Python; dedup, ranges and deltas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_chunks(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, chunk, size): the lines of each text in order, by digest."""
    lines = blobs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("ord", "line"))
    return lines.select(key, F.col("ord").cast("long").alias("ord"), F.sha2("line", 256).alias("chunk"), F.octet_length("line").cast("long").alias("size"))


def dedup_stats(manifest: DataFrame, by: list[str]) -> DataFrame:
    """Chunks and bytes as named by manifests, and as stored once each."""
    once = manifest.groupBy(*by, "chunk").agg(F.min("size").alias("size"), F.count("*").alias("n"))
    return once.groupBy(*by).agg(F.sum("n").alias("n_chunks"), F.sum(F.col("n") * F.col("size")).alias("n_bytes"), F.count("*").alias("n_distinct"), F.sum("size").alias("stored_bytes"))


def offsets(manifest: DataFrame, key: str) -> DataFrame:
    """The manifest with the first byte of each chunk in its payload."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))


def overlapping(manifest: DataFrame, key: str, offset: int, length: int) -> DataFrame:
    """The chunks that hold bytes of [offset, offset + length)."""
    return offsets(manifest, key).where((F.col("start") < offset + length) & (F.col("start") + F.col("size") > offset))


def copy_stats(target: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of target chunks that can be copied from held chunks, and those that must be sent."""
    there = held.select("chunk").distinct().withColumn("_held", F.lit(1))
    met = target.join(there, "chunk", "left")
    copied = F.col("_held").isNotNull()
    return met.groupBy(*by).agg(F.count_if(copied).alias("n_copies"), F.count_if(~copied).alias("n_literals"), F.sum(F.when(copied, F.col("size")).otherwise(0)).alias("copy_bytes"), F.sum(F.when(copied, 0).otherwise(F.col("size"))).alias("literal_bytes"))


def _gear() -> np.ndarray:
    """256 mixing values from a 64-bit generator."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def cut_points(data: bytes, average: int) -> list[int]:
    """Ends of content-defined chunks of average/2 to 2*average bytes.

    The rolling hash at a byte depends on the 64 bytes before it only, so all hashes come
    from 64 shifted sums. A stricter mask holds before the average size and a looser one after it.
    """
    n = len(data)
    if not n:
        return []
    g = GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, np.uint64)
    for k in range(min(64, n)):
        h[k:] += g[: n - k] << np.uint64(k)
    bits = max(2, average.bit_length() - 1)
    top = lambda b: np.uint64(((1 << b) - 1) << (64 - b))
    hard, easy = np.flatnonzero((h & top(bits + 1)) == 0), np.flatnonzero((h & top(bits - 1)) == 0)
    ends, start = [], 0
    while start < n:
        low, middle, high = start + average // 2, start + average, min(n, start + 2 * average)
        end = high
        k = np.searchsorted(hard, low)
        if k < len(hard) and hard[k] < min(middle, high):
            end = int(hard[k]) + 1
        else:
            k = np.searchsorted(easy, max(low, middle))
            if k < len(easy) and easy[k] < high:
                end = int(easy[k]) + 1
        ends.append(end)
        start = end
    return ends


def content_chunks(blobs: DataFrame, key: str, data: Column, average: int = 1024, *, with_data: bool = False) -> DataFrame:
    """(key, ord, chunk, size[, data]): content-defined chunks of each BINARY payload."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = 0
                for o, end in enumerate(cut_points(raw or b"", average)):
                    rows.append((k, o, hashlib.sha256(raw[start:end]).hexdigest(), end - start, raw[start:end]))
                    start = end
            types = (b.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.binary())[: 5 if with_data else 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [key, "ord", "chunk", "size", "data"][: len(types)])

    slim = blobs.select(key, data.alias("_data"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, ord long, chunk string, size long" + (", data binary" if with_data else ""))


def read_range(manifest: DataFrame, chunks: DataFrame, key: str, offset: int, length: int) -> DataFrame:
    """(key, data): bytes [offset, offset + length) of each payload that a manifest (key, ord, chunk, size) puts together from chunks (chunk, data).

    Only chunks that overlap the range are read. A missing or damaged one makes the result null.
    """
    at = overlapping(manifest, key, offset, length).join(chunks.select("chunk", F.col("data").alias("_data")), "chunk", "left")
    ok = F.col("_data").isNotNull() & (F.sha2("_data", 256) == F.col("chunk"))
    low = F.greatest(F.lit(offset) - F.col("start"), F.lit(0)).cast("int")
    high = F.least(F.lit(offset + length) - F.col("start"), F.col("size")).cast("int")
    part = F.when(ok, F.substring("_data", low + 1, high - low))
    got = at.groupBy(key).agg(F.bool_and(ok).alias("_ok"), F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("_parts"))  # the chunks of one range
    return got.select(key, F.when(F.col("_ok"), F.unhex(F.array_join(F.transform("_parts", lambda x: F.hex(x["part"])), ""))).alias("data"))


def overwrite(manifest: DataFrame, chunks: DataFrame, key: str, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, new chunks) after patches (key, offset, patch) of the same length as what they replace; a patch beyond the end of its payload changes what lies inside.

    One patch a payload. Chunks keep their bounds, and only those that a patch touches are read and stored anew.
    """
    at = offsets(manifest, key).join(patches.select(key, "offset", "patch"), key, "left")
    size = F.octet_length("patch")
    hit = F.col("patch").isNotNull() & (size > 0) & (F.col("start") < F.col("offset") + size) & (F.col("start") + F.col("size") > F.col("offset"))
    met = at.where(hit).join(chunks.select("chunk", F.col("data").alias("_data")), "chunk")
    low, skip = F.greatest(F.col("offset") - F.col("start"), F.lit(0)).cast("int"), F.greatest(F.col("start") - F.col("offset"), F.lit(0)).cast("int")
    n = F.least(size - skip, F.col("size").cast("int") - low).cast("int")
    new = F.concat(F.substring("_data", F.lit(1), low), F.substring("patch", skip + 1, n), F.substring("_data", low + n + 1, F.col("size").cast("int")))
    made = met.select(key, "ord", new.alias("data")).withColumn("_chunk", F.sha2("data", 256))
    out = manifest.join(made.select(key, "ord", "_chunk"), [key, "ord"], "left").select(key, "ord", F.coalesce("_chunk", "chunk").alias("chunk"), "size")
    fresh = made.select(F.col("_chunk").alias("chunk"), "data").dropDuplicates(["chunk"]).join(chunks.select("chunk"), "chunk", "left_anti")
    return out, fresh


def earlier_holders(chunks: DataFrame, key: str, n: int = 8) -> DataFrame:
    """(key, base_id, size, held): for each chunk of each payload (key, chunk, size) the newest ``n`` earlier payloads that hold it, and its size there.

    An index that keeps so many places for each chunk; pairs grow with the chunks, not with the square of those who share one.
    """
    before = Window.partitionBy("chunk").orderBy(key).rowsBetween(-n, -1)
    met = chunks.withColumn("_x", F.collect_list(F.struct(F.col(key).alias("base_id"), F.col("size").alias("held"))).over(before))
    return met.select(key, "size", F.explode("_x").alias("_x")).select(key, "_x.base_id", "size", "_x.held")
