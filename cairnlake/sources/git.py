"""Packs and views of object stores: reading and writing packs, and the files that a commit names."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import text as t
from cairnlake.functions.codecs import parse_git_tree
from cairnlake.plans.spool import spool

# Kinds of pack entries.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_OFFSET_DELTA, _NAMED_DELTA = 6, 7


def _sized(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, least first, and where it ends."""
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a pack's delta makes of its base; sizes must hold."""
    n, at = _sized(delta, 0)
    size, at = _sized(delta, at)
    if n != len(base):
        raise ValueError("the delta is of another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            start = count = 0
            for k in range(4):
                if op >> k & 1:
                    start, at = start | delta[at] << 8 * k, at + 1
            for k in range(3):
                if op >> (4 + k) & 1:
                    count, at = count | delta[at] << 8 * k, at + 1
            count = count or 1 << 16
            if start + count > len(base):
                raise ValueError("a copy lies outside of the base")
            out += base[start : start + count]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a reserved instruction")
    if len(out) != size:
        raise ValueError("the delta gives another size")
    return bytes(out)


def object_id(kind: str, body: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest()


def pack_objects(data: bytes) -> list[tuple[str, str, bytes]]:
    """(oid, kind, body) of all objects of a whole pack, deltas resolved; its checksum and count must hold."""
    if data[:4] != b"PACK" or int.from_bytes(data[4:8]) != 2 or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("no whole pack of version 2")
    at, end = 12, len(data) - 20
    entries: dict[int, tuple[int, int | str | None, bytes]] = {}
    for _ in range(int.from_bytes(data[8:12])):
        where, first = at, data[at]
        kind, size, shift, at = first >> 4 & 7, first & 15, 4, at + 1
        while first & 128:
            first = data[at]
            size |= (first & 127) << shift
            at, shift = at + 1, shift + 7
        base: int | str | None = None
        if kind == _OFFSET_DELTA:
            b, at = data[at], at + 1
            back = b & 127
            while b & 128:
                b, at = data[at], at + 1
                back = (back + 1) << 7 | b & 127
            base = where - back
        elif kind == _NAMED_DELTA:
            base, at = data[at : at + 20].hex(), at + 20
        elif kind not in KINDS:
            raise ValueError("unknown kind of pack entry")
        inflate = zlib.decompressobj()
        part = data[at : min(end, at + size + (size >> 9) + 128)]  # as long as a compressed entry of this size can be
        body = inflate.decompress(part, size + 1)
        if len(body) != size or not inflate.eof:
            raise ValueError("an entry has another size")
        at += len(part) - len(inflate.unused_data)
        entries[where] = kind, base, body
    if at != end:
        raise ValueError("bytes after the last entry")
    done: dict[int, tuple[str, str, bytes]] = {}
    named: dict[str, int] = {}
    left = dict(entries)
    while left:
        solved = []
        for where, (kind, base, body) in left.items():
            if kind in KINDS:
                done[where] = object_id(KINDS[kind], body), KINDS[kind], body
            else:
                source = done.get(base if isinstance(base, int) else named.get(base, -1))
                if source is None:
                    continue
                made = apply_delta(source[2], body)
                done[where] = object_id(source[1], made), source[1], made
            named[done[where][0]] = where
            solved.append(where)
        if not solved:
            raise ValueError("a delta's base is not in the pack")
        for where in solved:
            del left[where]
    return [done[k] for k in sorted(done)]


def write_pack(objects: list[tuple[str, bytes]]) -> bytes:
    """A pack of whole objects (kind, body)."""
    code = {v: k for k, v in KINDS.items()}
    out = bytearray(b"PACK" + (2).to_bytes(4) + len(objects).to_bytes(4))
    for kind, body in objects:
        size, head = len(body) >> 4, code[kind] << 4 | len(body) & 15
        while size:
            out.append(head | 128)
            head, size = size & 127, size >> 7
        out.append(head)
        out += zlib.compress(body)
    return bytes(out + hashlib.sha1(out).digest())


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(oid, kind, body) of the packs under a folder, one task a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = pack_objects(raw.as_py())
                for k in range(0, len(rows), 1024):
                    part = rows[k : k + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], x) for i, x in enumerate((pa.string(), pa.string(), pa.binary()))], ["oid", "kind", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").load(path)
    return files.select("content").mapInArrow(run, "oid string, kind string, body binary")


def tree_entries(objects: DataFrame) -> DataFrame:
    """(tree, mode, name, oid) of all trees among objects (oid, kind, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(tree, mode.lstrip("0"), name.decode("utf-8", "surrogateescape") if isinstance(name, bytes) else name, i.hex()) for tree, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for mode, name, i in parse_git_tree(body)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["tree", "mode", "name", "oid"])

    return objects.where("kind = 'tree'").select("oid", "body").mapInArrow(run, "tree string, mode string, name string, oid string")


def view(objects: DataFrame, commit: str) -> DataFrame:
    """(path, data, executable, target) of the files and links that a commit names, by one join a level; submodules are left out.

    A commit, tree or blob that is not among the objects (oid, kind, body) is an error.
    """
    head = objects.where((F.col("oid") == commit) & (F.col("kind") == "commit")).select(t.git_commit_links(F.col("body").cast("string")).alias("x")).select("x.tree").collect()
    if not head:
        raise KeyError(commit)
    entries = spool(tree_entries(objects), "git-trees")
    level = objects.sparkSession.createDataFrame([("", head[0]["tree"])], "path string, tree string")
    found = None
    while not level.isEmpty():
        if not level.join(objects.where("kind = 'tree'").select(F.col("oid").alias("tree")), "tree", "left_anti").isEmpty():
            raise ValueError("a tree is missing")
        below = spool(level.join(entries, "tree").select(F.concat("path", "name").alias("path"), "mode", "oid"), "git-level")
        files = below.where("mode NOT IN ('40000', '160000')")
        found = files if found is None else found.union(files)
        level = below.where("mode = '40000'").select(F.concat("path", F.lit("/")).alias("path"), F.col("oid").alias("tree"))
    met = found.join(objects.where("kind = 'blob'").select("oid", "body"), "oid", "left")
    met = spool(met, "git-files")
    if not met.where("body IS NULL").isEmpty():
        raise ValueError("a blob is missing")
    link = F.col("mode") == "120000"
    return met.select("path", F.when(~link, F.col("body")).alias("data"), (F.col("mode") == "100755").alias("executable"), F.when(link, F.col("body").cast("string")).alias("target"))
