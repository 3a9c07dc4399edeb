import hashlib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.functions import codecs as c
from cairnlake.functions import text as t


def test_blake3_vectors():
    assert c.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert c.blake3(b"hello").hex() == "ea8f163db38682925e4491c5e58d4bb3506ef8c14eb78a86e908c5624a67200f"
    # from the published test vectors: bytes 0..250 repeated
    data = bytes(k % 251 for k in range(2049))
    assert c.blake3(data[:1024]).hex() == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert c.blake3(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert c.blake3(data[:2048]).hex() == "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a"
    assert c.blake3(data).hex() == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"


names = st.binary(min_size=1, max_size=12).filter(lambda b: b"/" not in b and b"\0" not in b and b not in (b".", b".."))
digests = st.binary(min_size=32, max_size=32)
entries = st.dictionaries(names, st.one_of(st.tuples(st.just("directory"), digests, st.integers(0, 10**6)), st.tuples(st.just("file"), digests, st.integers(0, 10**6), st.booleans()), st.tuples(st.just("symlink"), st.binary(min_size=1, max_size=20))), max_size=8)


def _entry(name, x):
    if x[0] == "symlink":
        return (name, "symlink", None, 0, False, x[1])
    return (name, x[0], x[1], x[2], x[3] if x[0] == "file" else False, None)


@settings(deadline=None)
@given(entries)
def test_directories_round_trip(tree):
    rows = sorted(_entry(n, x) for n, x in tree.items())
    data = c.encode_directory(rows[::-1])
    assert c.decode_directory(data) == rows
    with pytest.raises(ValueError):
        c.decode_directory(data + b"x")
    if rows:
        with pytest.raises(ValueError):
            c.decode_directory(data[:-1])


def test_directory_layout():
    assert c.encode_directory([]) == bytes(8)
    got = c.encode_directory([(b"readme", "file", b"\x33" * 32, 5, False, None), (b"link", "symlink", None, 0, False, b"../bin"), (b"empty", "directory", b"\x11" * 32, 0, False, None), (b"bin", "file", b"\x22" * 32, 3, True, None)])
    want = b"\x04" + bytes(7) + b"\x01\x03" + bytes(7) + b"bin" + b"\x22" * 32 + b"\x03" + bytes(7) + b"\x01" + b"\x00\x05" + bytes(7) + b"empty" + b"\x11" * 32 + bytes(8) + b"\x02\x04" + bytes(7) + b"link\x06" + bytes(7) + b"../bin" + b"\x01\x06" + bytes(7) + b"readme" + b"\x33" * 32 + b"\x05" + bytes(7) + b"\x00"
    assert got == want
    assert c.directory_size(c.decode_directory(got)) == 4


def test_records_round_trip():
    links = [("blob.v1", b"\1" * 32), ("ipld.raw.v1", c.encode_cid(c.RAW_CODEC, c.blake3(b"")))]
    data = c.encode_record(("blob.v1", b"k"), b"\2" * 32, 5, links)
    assert c.decode_record(data) == (("blob.v1", b"k"), b"\2" * 32, 5, links)
    with pytest.raises(ValueError):
        c.encode_record(("blob.v1", b"k"), b"\2" * 32, 5, links[::-1])
    assert c.decode_root(c.encode_root("a/niño", ("x.v1", b"z"))) == ("a/niño", ("x.v1", b"z"))
    assert c.decode_linked(c.encode_linked(links, b"body")) == (links, b"body")
    assert c.decode_cid(links[1][1]) == (0x55, c.blake3(b""))


@given(st.integers(0, 2**64 - 1))
def test_varints(x):
    r = c.Reader(c.encode_uvarint(x))
    assert c.read_uvarint(r) == x
    r.finish()


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 5000), st.integers(0, 4999), st.integers(1, 3000), st.integers(0, 10**6))
def test_ranges_are_verified(size, offset, length, seed):
    data = random.Random(seed).randbytes(size)
    offset = min(offset, max(0, size - 1))
    root = c.block_hashes(data, 256)[-1][0]
    blocks, proof = c.prove_range(data, offset, length, 256)
    assert c.verify_range(root, size, offset, length, blocks, proof, 256) == data[offset : offset + length]
    if blocks and blocks[0]:
        with pytest.raises(ValueError):
            c.verify_range(root, size, offset, length, [b"\xff" + blocks[0][1:] if blocks[0][:1] != b"\xff" else b"\0" + blocks[0][1:], *blocks[1:]], proof, 256)


@settings(deadline=None)
@given(st.binary(max_size=600), st.binary(max_size=60), st.integers(0, 600))
def test_deltas_round_trip(base, edit, at):
    target = base[:at] + edit + base[at:]
    assert c.decode_delta(base, c.encode_delta(base, target, 16)) == target


def test_formats():
    f = c.standard_formats()
    entry = (b"a", "file", c.blake3(b"x"), 1, False, None)
    body = c.encode_directory([entry])
    assert f.verify("directory.v1", c.blake3(body), body) == [("blob.v1", c.blake3(b"x"))]
    with pytest.raises(ValueError):
        f.verify("blob.v1", b"\0" * 32, b"x")
    with pytest.raises(ValueError):
        f.add("blob.v1", lambda i, p: [])
    with pytest.raises(KeyError):
        f.verify("other.v1", b"", b"")


def test_git_trees():
    a, b = b"\1" * 20, b"\2" * 20
    data = b"100644 foo.c\0" + a + b"40000 foo\0" + b + b"100644 foo0\0" + a
    assert [x[1] for x in c.parse_git_tree(data)] == [b"foo.c", b"foo", b"foo0"]
    with pytest.raises(ValueError):
        c.parse_git_tree(b"100644 b\0" + a + b"100644 a\0" + a)


def test_expressions(spark):
    def one(x):
        return spark.range(1).select(x.alias("x")).first()[0]

    lit = F.lit
    raw = bytes(range(40))
    assert bytes(one(t.from_base64url(t.base64url(lit(raw))))) == raw
    assert one(t.from_base64url(lit("ab=="))) is None
    key = one(t.parse_key(t.key_text(lit("blob.v1"), lit(raw))))
    assert key["namespace"] == "blob.v1" and bytes(key["native_id"]) == raw
    assert one(t.parse_key(lit("blob.v1:a:b"))) is None
    for name, ok in (("a/b", True), ("a//b", False), ("/a", False), ("a/..", False), ("a\x07", False), ("é" * 128, False), ("", False)):
        assert one(t.valid_root_name(lit(name))) is ok, name
    for name, ok in (("refs/heads/a", True), ("refs/heads/a.lock", False), ("refs/a..b", False), ("heads/a", False), ("refs/heads/.x", False), ("refs/heads/a b", False)):
        assert one(t.valid_git_ref(lit(name))) is ok, name
    for at, to, bad in ((["a"], "b", False), (["a", "b"], "../c", False), (["a"], "../c", True), (["a"], "/c", True), (["a", "b"], "../../c/..", True)):
        assert one(t.symlink_escapes(F.array(*map(lit, at)), lit(to))) is bad, to
    assert one(t.last_use(lit(b"\1" + (2**64 - 1).to_bytes(8, "big")))) == 2**64 - 1
    assert one(t.last_use(lit(b"\2" + bytes(8)))) is None
    assert one(t.pressured(lit(80), lit(100))) and not one(t.pressured(lit(79), lit(100))) and not one(t.pressured(lit(1), lit(0)))
    assert tuple(one(t.scope_name(lit("s:n"), "d"))) == ("s", "n") and tuple(one(t.scope_name(lit("/a:b"), "d"))) == ("d", "/a:b")
    assert tuple(one(t.host_port(lit("[::1]:80")))) == ("::1", 80) and tuple(one(t.host_port(lit("h")))) == ("h", None)
    assert one(t.git_object_digest("blob", lit(b"hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    body = "tree " + "a" * 40 + "\nparent " + "b" * 40 + "\nparent " + "c" * 40 + "\n\nparent no"
    got = one(t.git_commit_links(lit(body)))
    assert got["tree"] == "a" * 40 and list(got["parents"]) == ["b" * 40, "c" * 40]
    assert one(t.measurements(lit(b"x")))["sha256"] == hashlib.sha256(b"x").hexdigest()
    assert one(t.links_in_order(F.array(lit(1), lit(2)))) and not one(t.links_in_order(F.array(lit(1), lit(1))))
    assert [one(t.valid_windows_name(lit(x))) for x in ("a.txt", "con", "a?", "a.")] == [True, False, False, False]


def test_blake3_in_sql(spark):
    c.register(spark)
    assert bytes(spark.sql("SELECT blake3(CAST('hello' AS BINARY))").first()[0]).hex().startswith("ea8f163d")


def test_compression_is_bounded():
    import pytest

    from cairnlake.functions.codecs import compress, decompress

    data = b"some text " * 5000
    frame = compress(data)
    assert decompress(frame, len(data)) == data and len(frame) < 1000 and decompress(compress(b""), 0) == b""
    for bad, most in ((frame, len(data) - 1), (frame[:-3], len(data)), (frame + b"x", len(data))):
        with pytest.raises(ValueError):
            decompress(bad, most)


def test_blake3_of_many_payloads_together(monkeypatch):
    """A column's payloads are compressed together, not one by one, and each has its own digest."""
    compress, calls = c._compress, []
    monkeypatch.setattr(c, "_compress", lambda *x: calls.append(1) or compress(*x))
    data = [bytes(k % 251 for k in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 8193, 31744, 102400)]
    rows = pd.Series([*data, None] * 20)
    (got,) = c.blake3_udf.func(iter([rows]))
    assert len(calls) < 40
    assert got.tolist() == [*(c.blake3(x) for x in data), None] * 20
    assert got[13].hex().startswith("62b6960e1a44bcc1") and got[14].hex().startswith("bc3e3d41a1146b06")  # published vectors
    monkeypatch.setattr(c, "TILE", 7)
    monkeypatch.setattr(c, "TOGETHER", 3000)
    assert c.blake3_many(data) == got.tolist()[: len(data)] and c.blake3_many([]) == []
