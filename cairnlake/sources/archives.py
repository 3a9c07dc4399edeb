"""Archives and folders as tables of entries, and back.

Every file is read by Spark's ``binaryFile`` source and parsed in Arrow batches on the executors, so that
any store Spark reads will do. An archive is one row; its entries are streamed from it.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, path string, kind string, size long, executable boolean, target string, sha256 string, data binary"
_TYPES = pa.schema([("archive", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("executable", pa.bool_()), ("target", pa.string()), ("sha256", pa.string()), ("data", pa.binary())])

# The first bytes that tell kinds of files apart, and where they stand.
MAGIC = ((0, b"PAR1", "bundle"), (257, b"ustar", "tar"), (0, b"\x1f\x8b", "gzip"), (0, b"\x28\xb5\x2f\xfd", "zstd"))


def detect(head: bytes, names: set[str] | None = None) -> str:
    """The kind of a source, by its first bytes or, of a folder, the names in it; never by its own name."""
    if names is not None:
        return "git" if {"HEAD", "objects", "refs"} <= names or ".git" in names else "filesystem"
    for at, magic, kind in MAGIC:
        if head[at : at + len(magic)] == magic:
            return kind
    raise ValueError("unknown kind of source")


def clean_path(path: str) -> str:
    """A relative path without empty or dot components; leading out of the tree is an error."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in parts or not parts:
        raise ValueError(f"not a valid path: {path!r}")
    return "/".join(parts)


def tar_entries(name: str, data: bytes) -> list[tuple]:
    """Entries of one archive; duplicate or conflicting paths, unsafe links and sparse files are errors."""
    rows, kinds = [], {}
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        for m in tar:
            if m.isdir() and m.name.strip("./") == "":
                continue
            if m.issparse() or any(k.startswith("GNU.sparse") for k in m.pax_headers):
                raise ValueError("sparse entries are not supported")
            path = clean_path(m.name)
            kind = "directory" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "file" if m.isreg() else None
            if kind is None:
                raise ValueError(f"unsupported kind of entry: {path!r}")
            if path in kinds and not kind == kinds[path] == "directory":
                raise ValueError(f"a path is given twice: {path!r}")
            kinds[path] = kind
            body = tar.extractfile(m).read() if kind == "file" else None
            target = clean_path(m.linkname) if kind == "hardlink" else m.linkname if kind == "symlink" else None
            rows.append((name, path, kind, len(body) if body is not None else 0, bool(m.mode & 0o111) and kind == "file", target, hashlib.sha256(body).hexdigest() if body is not None else None, body))
    for path in kinds:
        for k in range(path.count("/")):
            above = "/".join(path.split("/")[: k + 1])
            if kinds.get(above, "directory") != "directory":
                raise ValueError(f"a file is used as a directory: {above!r}")
    by_path = {r[1]: r for r in rows}
    out = []
    for r in rows:  # hard links become the file they lead to
        seen, leaf = set(), r
        while leaf[2] == "hardlink":
            if leaf[1] in seen or leaf[5] not in by_path:
                raise ValueError(f"a link leads nowhere: {r[1]!r}")
            seen.add(leaf[1])
            leaf = by_path[leaf[5]]
        out.append(r if leaf is r else (r[0], r[1], *leaf[2:]))
    return out


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives under a path."""
    return parse_tar(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))


def parse_tar(archives: DataFrame) -> DataFrame:
    """Entries of archives given as (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = tar_entries(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TYPES)], schema=_TYPES)

    return archives.mapInArrow(run, ENTRY)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder as entries (path, size, sha256, data)."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return files.select(F.substring(plain, len(root) + 2, 1 << 20).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("data"))


def write_tar(entries: list[tuple[str, bytes, bool]]) -> bytes:
    """A deterministic archive of (path, data, executable), in order of paths."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for path, data, executable in sorted(entries):
            info = tarfile.TarInfo(path)
            info.size, info.mode = len(data), 0o755 if executable else 0o644
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _nar_string(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + x + b"\0" * (-len(x) % 8)


def nar(node: tuple) -> bytes:
    """The canonical serialisation of a tree: ("file", data, executable), ("symlink", target) or ("directory", {name: node})."""
    s = _nar_string

    def of(n: tuple) -> bytes:
        if n[0] == "file":
            return s(b"(") + s(b"type") + s(b"regular") + (s(b"executable") + s(b"") if n[2] else b"") + s(b"contents") + s(n[1]) + s(b")")
        if n[0] == "symlink":
            return s(b"(") + s(b"type") + s(b"symlink") + s(b"target") + s(n[1]) + s(b")")
        kids = b"".join(s(b"entry") + s(b"(") + s(b"name") + s(k) + s(b"node") + of(v) + s(b")") for k, v in sorted(n[1].items()))
        return s(b"(") + s(b"type") + s(b"directory") + kids + s(b")")

    return s(b"nix-archive-1") + of(node)


def nar_head() -> bytes:
    """What stands before the length of a plain file's data in its archive."""
    return b"".join(map(_nar_string, (b"nix-archive-1", b"(", b"type", b"regular", b"contents")))


def nar_tail() -> bytes:
    """What follows the data of a plain file and its padding."""
    return _nar_string(b")")


def nar_file(data: Column) -> Column:
    """The archive of one plain file as a column expression."""
    n = F.octet_length(data)
    size = F.lpad(F.hex(n.cast("long")), 16, "0")
    little = F.unhex(F.concat(*(F.substring(size, 15 - 2 * k, 2) for k in range(8))))
    return F.concat(F.lit(nar_head()), little, data, F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(8)))), F.lit(nar_tail()))


def write_bundle(records: DataFrame, payloads: DataFrame, roots: DataFrame, path: str, mode: str = "error") -> None:
    """A closure-complete bundle: sorted roots, records, and payloads once each, by digest."""
    roots.orderBy("name").coalesce(1).write.mode(mode).parquet(f"{path}/roots")
    records.repartitionByRange("ns", "id").sortWithinPartitions("ns", "id").write.mode(mode).parquet(f"{path}/records")
    payloads.dropDuplicates(["digest"]).repartitionByRange("digest").sortWithinPartitions("digest").write.mode(mode).parquet(f"{path}/payloads")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, payloads, roots), after checking that payloads and records name each other exactly and digests hold."""
    records, payloads, roots = (spark.read.parquet(f"{path}/{x}") for x in ("records", "payloads", "roots"))
    if not records.join(payloads, "digest", "left_anti").isEmpty() or not payloads.join(records, "digest", "left_anti").isEmpty():
        raise ValueError("payloads and records do not match")
    if not payloads.where(F.sha2("data", 256) != F.col("digest")).isEmpty():
        raise ValueError("a payload does not have its digest")
    if not roots.join(records, ["ns", "id"], "left_anti").isEmpty():
        raise ValueError("a root has no record")
    return records, payloads, roots
