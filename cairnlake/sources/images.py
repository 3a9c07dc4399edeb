"""Image layouts, canonical tree archives and loose object stores as tables."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators.tree import merge_layers
from cairnlake.plans.spool import spool
from cairnlake.sources.archives import clean_path


def select_platform(entries: list[dict], wanted: str | None = None) -> str:
    """The digest of the index entry for OS/ARCH[/VARIANT]; without a wish, of the only entry."""
    if wanted is None:
        if len(entries) != 1:
            raise ValueError("the image has several platforms; name one")
        return entries[0]["digest"]
    os_, arch, *variant = wanted.split("/")
    fits = [e for e in entries if (p := e.get("platform", {})).get("os") == os_ and p.get("architecture") == arch and (not variant or p.get("variant") == variant[0])]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} entries fit {wanted}")
    return fits[0]["digest"]


_LAYER = "layer long, path string, kind string, value string, mark string, executable boolean, data binary"


def read_layout(spark: SparkSession, path: str, platform: str | None = None) -> tuple[dict, DataFrame]:
    """(config, layers) of an image layout: its index, the manifest for a platform, its config, and (layer, content) of its layers.

    Index, manifest and config are small; layers stay a table. Every blob that is read must have its digest and size.
    """
    import json

    def file(name: str) -> bytes:
        return bytes(spark.read.format("binaryFile").load(f"{path}/{name}").select("content").first()["content"])

    def blob(entry: dict) -> bytes:
        algorithm, _, digest = entry["digest"].partition(":")
        data = file(f"blobs/{algorithm}/{digest}")
        if algorithm != "sha256" or hashlib.sha256(data).hexdigest() != digest or len(data) != entry.get("size", len(data)):
            raise ValueError(f"{entry['digest']} is damaged")
        return data

    if json.loads(file("oci-layout")).get("imageLayoutVersion", "").split(".")[0] != "1":
        raise ValueError("not an image layout of version 1")
    found = json.loads(file("index.json"))
    while "manifests" in found:  # an index may name another
        by = {e["digest"]: e for e in found["manifests"]}
        found = json.loads(blob(by[select_platform(list(by.values()), platform if len(by) > 1 else None)]))
    config = json.loads(blob(found["config"]))
    if len(config.get("rootfs", {}).get("diff_ids", found["layers"])) != len(found["layers"]):
        raise ValueError("the config names other layers than the manifest")
    names = [e["digest"].partition(":")[2] for e in found["layers"]]
    if not names:
        return config, spark.createDataFrame([], "layer long, content binary")
    places = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "layer long, digest string")
    files = spark.read.format("binaryFile").load(sorted({f"{path}/blobs/sha256/{n}" for n in names}))
    sound = F.assert_true(F.sha2("content", 256) == F.col("digest"), F.concat("digest", F.lit(" is damaged")))
    layers = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("digest"), "content").join(places, "digest").where(sound.isNull())
    return config, layers.select("layer", "content")


def layer_entries(layers: DataFrame) -> DataFrame:
    """(layer, path, kind, value, mark) of layers given as (layer, content): archives, plain or compressed.

    ``mark`` is ``whiteout`` for an entry that hides its path, ``opaque`` for one that hides what is under it.
    A path given twice in one layer is an error, unless it is a directory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                layer, rows, seen = b.column(0)[k].as_py(), [], {}
                with tarfile.open(fileobj=io.BytesIO(b.column(1)[k].as_py()), mode="r:*") as tar:
                    for m in tar:
                        if m.name.strip("./") == "":
                            continue
                        path = clean_path(m.name)
                        parent, _, name = path.rpartition("/")
                        kind = "directory" if m.isdir() else "symlink" if m.issym() else "file"
                        if seen.setdefault(path, kind) != kind or (path in {r[1] for r in rows if r[2] != "directory"}):
                            raise ValueError(f"a path is given twice in layer {layer}: {path!r}")
                        if name == ".wh..wh..opq":
                            rows.append((layer, parent, "file", None, "opaque", False, None))
                        elif name.startswith(".wh."):
                            rows.append((layer, f"{parent}/{name[4:]}".lstrip("/"), "file", None, "whiteout", False, None))
                        else:
                            data = tar.extractfile(m).read() if m.isreg() or m.islnk() else None
                            value = m.linkname if m.issym() else None if data is None else hashlib.sha256(data).hexdigest()
                            rows.append((layer, path, kind, value, None, bool(m.mode & 0o100), data))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["layer", "path", "kind", "value", "mark", "executable", "data"])

    return layers.select(F.col("layer").cast("long").alias("layer"), "content").mapInArrow(run, _LAYER)


def root_filesystem(layers: DataFrame) -> DataFrame:
    """The merged tree (path, value, layer) of an image's layers."""
    e = layer_entries(layers)
    entries = e.where("mark IS NULL").select("layer", "path", "value", (F.col("kind") == "directory").alias("is_dir"))
    return merge_layers(entries, e.where("mark IS NOT NULL").select("layer", "path", (F.col("mark") == "opaque").alias("opaque")))


def image_files(layers: DataFrame) -> DataFrame:
    """(path, data, executable, target) of the files and links of an image's merged layers; empty directories are left out."""
    e = spool(layer_entries(layers), "image-entries")
    merged = merge_layers(
        e.where("mark IS NULL").select("layer", "path", "value", (F.col("kind") == "directory").alias("is_dir")),
        e.where("mark IS NOT NULL").select("layer", "path", (F.col("mark") == "opaque").alias("opaque")),
    ).select("layer", "path")
    own = e.where("mark IS NULL AND kind <> 'directory'").join(merged, ["layer", "path"], "left_semi")
    link = F.col("kind") == "symlink"
    return own.select("path", "data", "executable", F.when(link, F.col("value")).alias("target"))


def nar_files(node: tuple, at: str = "") -> list[tuple[str, bytes | None, bool, str | None]]:
    """(path, data, executable, target) of the files and links of a tree that ``parse_nar`` read."""
    out, todo = [], [(at, node)]
    while todo:
        path, n = todo.pop()
        if n[0] == "directory":
            todo += [(f"{path}/{k.decode()}".lstrip("/"), v) for k, v in n[1].items()]
        else:
            out.append((path, n[1], n[2], None) if n[0] == "file" else (path, None, False, n[1].decode()))
    return sorted(out)


def parse_nar(data: bytes) -> tuple:
    """The tree of a canonical archive, the inverse of ``archives.nar``; anything not canonical is an error."""
    at = 0

    def s() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 8], "little")
        end = at + 8 + n
        pad = -n % 8
        if end + pad > len(data) or any(data[end : end + pad]):
            raise ValueError("truncated or not padded with zeros")
        out, at = data[at + 8 : end], end + pad
        return out

    def expect(*words: bytes) -> None:
        for w in words:
            if s() != w:
                raise ValueError(f"expected {w!r}")

    def node() -> tuple:
        expect(b"(", b"type")
        kind = s()
        if kind == b"regular":
            word, executable = s(), False
            if word == b"executable":
                expect(b"")
                word, executable = s(), True
            if word != b"contents":
                raise ValueError("expected contents")
            out = ("file", s(), executable)
            expect(b")")
            return out
        if kind == b"symlink":
            expect(b"target")
            out = ("symlink", s())
            expect(b")")
            return out
        if kind != b"directory":
            raise ValueError("unknown kind of node")
        kids: dict[bytes, tuple] = {}
        last = b""
        while (word := s()) == b"entry":
            expect(b"(", b"name")
            name = s()
            if name <= last or b"/" in name or name in (b".", b".."):
                raise ValueError("names are not valid or out of order")
            last = name
            expect(b"node")
            kids[name] = node()
            expect(b")")
        if word != b")":
            raise ValueError("expected the end of a directory")
        return ("directory", kids)

    expect(b"nix-archive-1")
    out = node()
    if at != len(data):
        raise ValueError("trailing bytes")
    return out


def parse_loose(raw: bytes) -> tuple[str, bytes]:
    """(kind, body) of a compressed loose object, with its size checked."""
    data = zlib.decompress(raw)
    head, _, body = data.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if kind not in (b"blob", b"tree", b"commit", b"tag") or not size.isdigit() or int(size) != len(body):
        raise ValueError("not a valid object")
    return kind.decode(), body


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """(oid, kind, body, links) of the loose objects under a folder; ids are recomputed, and links are (kind, oid)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_objects(files.where(F.col("path").rlike("/[0-9a-f]{2}/[0-9a-f]{38,62}$")).select("content"))


def parse_objects(compressed: DataFrame) -> DataFrame:
    """(oid, kind, body, links) of compressed objects given as (content)."""
    from cairnlake.functions.codecs import parse_git_tree

    def links(kind: str, body: bytes) -> list[dict]:
        if kind == "tree":
            return [{"kind": "tree" if mode.endswith("40000") else "blob", "oid": i.hex()} for mode, _, i in parse_git_tree(body) if mode != "160000"]
        if kind == "blob":
            return []
        head: dict[str, str] = {}
        out = []
        for line in body.split(b"\n\n")[0].decode("utf-8", "replace").split("\n"):
            word, _, rest = line.partition(" ")
            head[word] = rest
            if kind == "commit" and word in ("tree", "parent"):
                out.append({"kind": "commit" if word == "parent" else "tree", "oid": rest})
        return out if kind == "commit" else [{"kind": head["type"], "oid": head["object"]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.list_(pa.struct([("kind", pa.string()), ("oid", pa.string())]))
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                kind, body = parse_loose(raw)
                rows.append((hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest(), kind, body, links(kind, body)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), link))], ["oid", "kind", "body", "links"])

    return compressed.mapInArrow(run, "oid string, kind string, body binary, links array<struct<kind: string, oid: string>>")


def object_links(objects: DataFrame) -> DataFrame:
    """(sns, sid, dns, did) of parsed objects, as ``closure`` takes them."""
    return objects.select(F.col("kind").alias("sns"), F.col("oid").alias("sid"), F.inline("links")).select("sns", "sid", F.col("kind").alias("dns"), F.col("oid").alias("did")).distinct()


def advertise(refs: DataFrame) -> DataFrame:
    """(position, oid, name) of references (name, oid), HEAD first, then by bytes of the name.

    Places are counted within ranges of names and then summed over the ranges, so that no task orders all references.
    """
    from pyspark.sql import Window

    key = [F.when(F.col("name") == "HEAD", 0).otherwise(1), F.col("name").cast("binary")]
    dealt = refs.select("oid", "name").repartitionByRange(*key).withColumn("_part", F.spark_partition_id())
    dealt = spool(dealt, "refs")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    return dealt.withColumn("_place", place).join(F.broadcast(parts), "_part").select((F.col("_place") + F.col("_before")).cast("int").alias("position"), "oid", "name")
