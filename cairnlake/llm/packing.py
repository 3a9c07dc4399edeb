"""Best-fit packing into bins of several permitted capacities.

Documents are cut into pieces no longer than the largest capacity. Within a shard (documents
of the same hash) pieces go, longest first, to the open bin with the least room that
holds them. Where none does, a bin is opened of the capacity whose cost for each word it
would hold is least, judged by filling it from the pieces still to come. Finally each bin
shrinks to the smallest permitted capacity that holds its contents.

A shard is a bounded block of rows, so that neither a task's memory nor its time depends on
the size of the corpus, and a lost task redoes its shards only.

Defined results: a document without words gets one row without a bin; repeated rows are
packed each; very long texts are cut into pieces of the largest capacity; ties are ordered by id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import n_words, spool

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents packed together.
SHARD_ROWS = 20_000


def cost(capacity: int) -> float:
    """Cost of one bin: linear work and a share that grows with the square, as attention does."""
    return capacity * (1 + capacity / 65_536) + 16


class _Bag:
    """Numbers with multiplicity; predecessor and successor by bits of one integer."""

    def __init__(self) -> None:
        self.bits, self.n = 0, {}

    def add(self, x: int) -> None:
        self.n[x] = self.n.get(x, 0) + 1
        self.bits |= 1 << x

    def take(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            self.bits &= ~(1 << x)

    def up_to(self, x: int) -> int:
        return (self.bits & ((1 << (x + 1)) - 1)).bit_length() - 1

    def least_from(self, x: int) -> int:
        rest = self.bits >> x
        return x + ((rest & -rest).bit_length() - 1) if rest else -1


def _open(first: int, coming: _Bag, capacities: tuple[int, ...], price: Callable[[int], float]) -> int:
    """The capacity with the least cost per word, if it were filled greedily from the pieces to come."""
    best, at = float("inf"), capacities[-1]
    for c in capacities:
        if c < first:
            continue
        room, used = c - first, {}
        while room and (x := coming.up_to(room)) > 0:
            while x > 0 and used.get(x, 0) >= coming.n[x]:
                x = coming.up_to(x - 1)
            if x <= 0:
                break
            k = min(room // x, coming.n[x] - used.get(x, 0))
            used[x] = used.get(x, 0) + k
            room -= k * x
        each = price(c) / (c - room)
        if each < best:
            best, at = each, c
    return at


Pieces = list[tuple[int, int, int, int, int]]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = cost) -> tuple[Pieces, list[int]]:
    """Pieces as (index, start, length, bin, offset), and the capacity of each bin.

    Judged greedily, several sizes can come out dearer than the largest alone; the cheaper of both is taken.
    """
    capacities = tuple(sorted(capacities))
    tried = [_pack(lengths, opened, capacities, price) for opened in dict.fromkeys((capacities, capacities[-1:]))]
    return min(tried, key=lambda x: (sum(map(price, x[1])), len(x[1])))


def _pack(lengths: list[int], permitted: tuple[int, ...], capacities: tuple[int, ...], price: Callable[[int], float]) -> tuple[Pieces, list[int]]:
    """One packing in which bins of ``permitted`` capacities are opened."""
    top = capacities[-1]
    pieces, out, fill = [], [], []
    for k, n in enumerate(lengths):
        for start in range(0, n, top):
            pieces.append((min(top, n - start), k, start))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    coming, rooms, by_room, opened = _Bag(), _Bag(), {}, []
    for x, _, _ in pieces:
        coming.add(x)
    for x, k, start in pieces:
        coming.take(x)
        room = rooms.least_from(x)
        if room >= 0:
            b = by_room[room].pop()
            rooms.take(room)
        else:
            b = len(fill)
            fill.append(0)
            opened.append(_open(x, coming, permitted, price))
            room = opened[b]
        out.append((k, start, x, b, fill[b]))
        fill[b] += x
        if room > x:
            rooms.add(room - x)
            by_room.setdefault(room - x, []).append(b)
    return out, [next(c for c in capacities if c >= f) for f in fill]


def pack_documents(docs: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, size: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: where it starts in its document (in words), its length, its bin and its place there."""
    size = n_words(F.col("text")) if size is None else size
    slim = spool(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size")), "pack")
    shards = max(1, -(-slim.count() // shard_rows))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "size")
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("capacity", pa.int64()), ("bin_offset", pa.int64())])

    def block(ids: list[int], sizes: list[int], shard: int, first: int) -> tuple[pa.RecordBatch, int]:
        got, caps = pack(sizes, capacities)
        top = max(capacities)
        bin_of = lambda b: (shard << 32) + first + b
        rows = [(ids[k], start // top, start, n, bin_of(b), caps[b], at) for k, start, n, b, at in got]
        rows += [(i, 0, 0, 0, None, None, None) for i, n in zip(ids, sizes, strict=True) if not n]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], schema=out), first + len(caps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, shard, first = [], [], None, 0
        for b in batches:
            for i, n, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "size", "shard")), strict=True):
                if s != shard or len(ids) >= 2 * shard_rows:
                    if ids:
                        done, first = block(ids, sizes, shard, first)
                        yield done
                    ids, sizes, first, shard = [], [], first if s == shard else 0, s
                ids.append(i)
                sizes.append(n)
        if ids:
            yield block(ids, sizes, shard, first)[0]

    return dealt.mapInArrow(run, "doc_id long, piece long, start long, length long, bin_id long, capacity long, bin_offset long")
