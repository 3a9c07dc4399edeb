import hashlib
import io
import json
import os
import tarfile
import zlib

import pytest

from cairnlake.operators.closure import closure
from cairnlake.repository import Repository
from cairnlake.sources import archives, git, images


def layer(files, dirs=()):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for d in dirs:
            i = tarfile.TarInfo(d)
            i.type = tarfile.DIRTYPE
            t.addfile(i)
        for path, data in files:
            i = tarfile.TarInfo(path)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
    return out.getvalue()


def test_layers_merge(spark):
    rows = [(0, layer([("a/x", b"1"), ("a/y", b"2"), ("b", b"3"), ("c/d/e", b"4")], ["a"])), (1, layer([("a/.wh.x", b""), ("c/.wh..wh..opq", b""), ("c/new", b"6")]))]
    got = {r["path"]: r["layer"] for r in images.root_filesystem(spark.createDataFrame(rows, "layer long, content binary")).collect()}
    assert got == {"a": 0, "a/y": 0, "b": 0, "c/new": 1}
    twice = layer([("a", b"1"), ("a", b"2")])
    with pytest.raises(Exception, match="given twice"):
        images.root_filesystem(spark.createDataFrame([(0, twice)], "layer long, content binary")).collect()


def test_platforms():
    index = [{"digest": "x", "platform": {"os": "linux", "architecture": "amd64"}}, {"digest": "y", "platform": {"os": "linux", "architecture": "arm", "variant": "v7"}}]
    assert images.select_platform(index, "linux/amd64") == "x" and images.select_platform(index, "linux/arm/v7") == "y"
    assert images.select_platform(index[:1]) == "x"
    for wanted in (None, "linux/riscv"):
        with pytest.raises(ValueError):
            images.select_platform(index, wanted)


def test_tree_archives_round_trip():
    tree = ("directory", {b"bin": ("file", b"#!/bin/sh\n", True), b"empty": ("directory", {}), b"l": ("symlink", b"bin"), b"z": ("file", b"", False)})
    data = archives.nar(tree)
    assert images.parse_nar(data) == tree
    for bad in (data[:-1], data + b"\0" * 8, data.replace(b"symlink", b"symlinx")):
        with pytest.raises(ValueError):
            images.parse_nar(bad)


def test_objects_and_their_closure(spark):
    def put(kind, body):
        raw = f"{kind} {len(body)}\0".encode() + body
        made.append((zlib.compress(raw),))
        return hashlib.sha1(raw).hexdigest()

    made = []
    blob = put("blob", b"hello\n")
    tree = put("tree", b"100644 f\0" + bytes.fromhex(blob))
    first = put("commit", f"tree {tree}\n\nfirst".encode())
    second = put("commit", f"tree {tree}\nparent {first}\n\nparent nothing".encode())
    tag = put("tag", f"object {second}\ntype commit\ntag v1\n\nx".encode())
    got = images.parse_objects(spark.createDataFrame(made, "content binary"))
    assert blob == "ce013625030ba8dba906f756967f9e9ca394464a" and {r["oid"] for r in got.collect()} == {blob, tree, first, second, tag}
    seeds = spark.createDataFrame([("tag", tag)], "ns string, id string")
    level = {r["id"]: r["level"] for r in closure(seeds, images.object_links(got)).collect()}
    assert level == {tag: 0, second: 1, tree: 2, first: 2, blob: 3}
    with pytest.raises(ValueError):
        images.parse_loose(zlib.compress(b"blob 3\0ab"))
    refs = spark.createDataFrame([("refs/b", "1"), ("HEAD", "2"), ("refs/a", "3")], "name string, oid string")
    assert [r["name"] for r in images.advertise(refs).orderBy("position").collect()] == ["HEAD", "refs/a", "refs/b"]


def git_objects():
    """A small history as (kind, body): files, an executable, a link, nested trees."""
    def oid(kind, body):
        return git.object_id(kind, body)

    blobs = {n: b for n, b in (("a", b"alpha" * 50), ("run", b"#!/bin/sh"), ("ln", b"a"), ("deep", b"deep"))}
    entry = lambda mode, name, i: f"{mode} {name}".encode() + b"\0" + bytes.fromhex(i)
    inner = entry("100644", "deep", oid("blob", blobs["deep"]))
    sub = entry("40000", "inner", oid("tree", inner))
    top = b"".join([entry("100644", "a", oid("blob", blobs["a"])), entry("120000", "ln", oid("blob", blobs["ln"])), entry("100755", "run", oid("blob", blobs["run"])), entry("40000", "sub", oid("tree", sub)), entry("160000", "submodule", "1" * 40)])
    commit = f"tree {oid('tree', top)}\nauthor x <x> 0 +0000\n\nfirst".encode()
    return [("commit", commit), ("tree", top), ("tree", sub), ("tree", inner), *(("blob", b) for b in blobs.values())]


def test_packs(spark, tmp_path):
    objects = git_objects()
    data = git.write_pack(objects)
    assert [(k, b) for _, k, b in git.pack_objects(data)] == objects
    base, delta = b"alpha" * 50, bytes([250, 1, 253, 1, 0b10010000, 250, 3]) + b"end"
    assert git.apply_delta(base, delta) == base + b"end"
    raw = bytearray(b"PACK" + (2).to_bytes(4) + (3).to_bytes(4))
    whole = len(raw)
    raw += bytes([3 << 4 | 250 & 15 | 128, 250 >> 4]) + zlib.compress(base)
    by_offset = len(raw)
    raw += bytes([6 << 4 | len(delta) & 15]) + (lambda n: bytes([n]) if n < 128 else bytes([(n >> 7) - 1 | 128, n & 127]))(by_offset - whole) + zlib.compress(delta)
    raw += bytes([7 << 4 | len(delta) & 15]) + bytes.fromhex(git.object_id("blob", base)) + zlib.compress(delta)
    raw += hashlib.sha1(raw).digest()
    assert [b for _, _, b in git.pack_objects(bytes(raw))] == [base, base + b"end", base + b"end"]
    for bad in (data[:-1], data[:30] + b"x" + data[31:], b"PACK"):
        with pytest.raises(ValueError):
            git.pack_objects(bad)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.pack").write_bytes(data)
    got = git.read_packs(spark, f"{tmp_path}/p")
    assert {(r["kind"], bytes(r["body"])) for r in got.collect()} == set(objects)
    commit = git.object_id(*objects[0])
    files = {r["path"]: (r["data"] and bytes(r["data"]), r["executable"], r["target"]) for r in git.view(got, commit).collect()}
    assert files == {"a": (b"alpha" * 50, False, None), "ln": (None, False, "a"), "run": (b"#!/bin/sh", True, None), "sub/inner/deep": (b"deep", False, None)}
    with pytest.raises(ValueError):
        git.view(got.where("body <> cast('deep' as binary)"), commit)
    repo = Repository(spark, f"file://{tmp_path}/r")
    top = repo.import_git(got, commit, "git/main")
    assert repo.readlink(top, "ln") == "a" and repo.getattr(top, "run")["executable"]
    repo.checkout(top, f"{tmp_path}/out")
    assert (tmp_path / "out" / "sub" / "inner" / "deep").read_bytes() == b"deep" and os.readlink(tmp_path / "out" / "ln") == "a" and repo.fsck().count() == 0


def test_image_layouts(spark, tmp_path):
    """Index, manifest, config and layers of a layout, by platform; damage is an error."""
    blobs = tmp_path / "blobs" / "sha256"
    blobs.mkdir(parents=True)

    def put(data):
        name = hashlib.sha256(data).hexdigest()
        (blobs / name).write_bytes(data)
        return {"digest": f"sha256:{name}", "size": len(data)}

    first, second = layer([("a/x", b"1"), ("b", b"3")], ["a"]), layer([("a/.wh.x", b""), ("c", b"4")])
    manifests = []
    for arch, layers in (("amd64", [first, second]), ("arm64", [first])):
        config = put(json.dumps({"architecture": arch, "rootfs": {"type": "layers", "diff_ids": [str(k) for k in range(len(layers))]}}).encode())
        manifests.append(put(json.dumps({"config": config, "layers": [put(x) for x in layers]}).encode()) | {"platform": {"os": "linux", "architecture": arch}})
    (tmp_path / "index.json").write_text(json.dumps({"manifests": [put(json.dumps({"manifests": manifests}).encode())]}))
    (tmp_path / "oci-layout").write_text('{"imageLayoutVersion": "1.0.0"}')
    repo = Repository(spark, f"file://{tmp_path}/r")
    top, config = repo.import_image(str(tmp_path), "image", "linux/amd64")
    assert config["architecture"] == "amd64" and {r["path"] for r in repo.tree(top).collect()} == {"b", "c"}
    assert repo.cat(repo.getattr(top, "c")["child"]) == b"4"
    with pytest.raises(ValueError):
        repo.import_image(str(tmp_path), "image")
    (blobs / hashlib.sha256(second).hexdigest()).write_bytes(first)
    with pytest.raises(Exception, match="damaged"):
        repo.import_image(str(tmp_path), "other", "linux/amd64")


def test_folders_are_read_once(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    for name in ("a", "d/b"):
        (src / name).write_bytes(name.encode())
    repo = Repository(spark, f"file://{tmp_path}/r")
    first, read = repo.import_folder(str(src), "home")
    assert read == 2 and {r["path"] for r in repo.tree(first).collect()} == {"a", "d", "d/b"}
    assert repo.import_folder(str(src), "home") == (first, 0)
    (src / "new").write_bytes(b"new")
    second, read = repo.import_folder(str(src), "home")
    assert read == 1 and second != first and repo.cat(repo.getattr(second, "d/b")["child"]) == b"d/b" and repo.fsck().count() == 0


def test_references_are_numbered(spark):
    refs = spark.createDataFrame([(f"{k:040d}", f"refs/heads/{k * 37 % 101}") for k in range(101)] + [("f" * 40, "HEAD")], "oid string, name string")
    got = images.advertise(refs).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 103)) and got[0]["name"] == "HEAD"
    assert [r["name"] for r in got[1:]] == sorted(r["name"] for r in got[1:])


def test_tree_archives_as_files():
    node = ("directory", {b"d": ("directory", {b"f": ("file", b"x", True)}), b"l": ("symlink", b"d/f")})
    assert images.nar_files(images.parse_nar(archives.nar(node))) == [("d/f", b"x", True, None), ("l", None, False, "d/f")]
