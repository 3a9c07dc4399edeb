import random
import tarfile

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import audit, catalog, chunking, kv, sets, sync, tree
from cairnlake.operators.closure import closure, first_missing
from cairnlake.operators.needles import find_needles
from cairnlake.plans.versioned import Conflict, StaleRevision, Store, commit_if, insert_new
from cairnlake.sources import archives
from cairnlake.streaming.follow import follow


def _links(spark, pairs):
    return spark.createDataFrame([("n", a, "n", b) for a, b in pairs], "sns string, sid long, dns string, did long")


def _keys(spark, ids):
    return spark.createDataFrame([("n", i) for i in ids], "ns string, id long")


def test_closure_against_a_model(spark):
    rnd = random.Random(5)
    pairs = sorted({(a, rnd.randrange(a + 1, 40)) for a in range(39) for _ in range(2)})
    roots, stop = [0, 3], [7, 9]
    level = dict.fromkeys(roots, 0)
    queue = list(roots)
    while queue:
        a = queue.pop(0)
        for x, y in pairs:
            if x == a and a not in stop and y not in level:
                level[y] = level[a] + 1
                queue.append(y)
    got = closure(_keys(spark, roots), _links(spark, pairs), stop=_keys(spark, stop))
    assert {r["id"]: r["level"] for r in got.collect()} == level
    with pytest.raises(ValueError):
        closure(_keys(spark, roots), _links(spark, pairs), max_nodes=3)


def test_diamonds_and_empty_graphs(spark):
    pairs = [(3 * k + a, 3 * k + b) for k in range(6) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    assert closure(_keys(spark, [0]), _links(spark, pairs)).count() == 19
    assert closure(_keys(spark, []), _links(spark, pairs)).count() == 0
    out = _links(spark, [(1, 2), (1, 9), (2, 8)])
    got = first_missing(closure(_keys(spark, [1]), out), out, _keys(spark, [1, 2]))
    assert [tuple(r) for r in got.collect()] == [(0, "n", 1, "n", 9)]


def test_prefixes():
    assert kv.prefix_end(b"a\xff\xff") == b"b" and kv.prefix_end(b"\xff") is None
    with pytest.raises(ValueError):
        kv.raw_prefix(F.lit(b"x"), b"a", after=b"b")
    with pytest.raises(ValueError):
        kv.page(None, "k", 0)


def test_pages_end_by_bytes(spark):
    t = spark.createDataFrame([(k, 10) for k in range(9)], "k long, size long")
    got = lambda most, after=None: [r["k"] for r in kv.page_bytes(t, "k", F.col("size"), 5, most, after).orderBy("k").collect()]
    assert got(35) == [0, 1, 2] and got(1) == [0] and got(1000, 4) == [5, 6, 7, 8]


def test_sets(spark):
    a, b = _keys(spark, [1, 2, 2, 3]), _keys(spark, [3, 4])
    assert {r["id"] for r in sets.difference(a, b, ["ns", "id"]).collect()} == {1, 2}
    assert sets.union([a, b], ["id"]).count() == 4
    assert {(r["id"], r["side"]) for r in sets.symmetric_difference(a, b, ["id"]).collect()} == {(1, "left"), (2, "left"), (4, "right")}
    assert [r["id"] for r in sets.stale(a, b, _keys(spark, [1]), ["id"]).collect()] == [2]


def test_layers(spark):
    e = spark.createDataFrame([(1, "d", "d1", True), (1, "d/a", "a1", False), (1, "d/b", "b1", False), (1, "x", "x1", False), (2, "d/a", "a2", False), (3, "x/y", "y3", False), (3, "d", "file", False)], "layer long, path string, value string, is_dir boolean")
    w = spark.createDataFrame([(2, "d", True), (2, "x", False)], "layer long, path string, opaque boolean")
    got = {r["path"]: r["value"] for r in tree.merge_layers(e, w).collect()}
    assert got == {"d": "file", "x/y": "y3"}
    got = {r["path"]: r["value"] for r in tree.merge_layers(e.where("layer < 3"), w).collect()}
    assert got == {"d": "d1", "d/a": "a2"}  # an opaque mark keeps the directory and what its own layer adds


def test_eviction_is_exact(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(5), rnd.randrange(1, 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "name long, at long, size long")
    for need in (0, 1, 50, 10_000):
        want, total = [], 0
        for k, at, size in sorted(rows, key=lambda r: (r[1], r[0])):
            if total >= need:
                break
            want.append(k)
            total += size
        assert sorted(r["name"] for r in audit.evict(df, ["at", "name"], F.col("size"), need, F.col("at")).collect()) == sorted(want)


def test_chunking_is_stable():
    data = random.Random(1).randbytes(60_000)
    cuts = chunking.cut_points(data, 1024)
    assert cuts[-1] == len(data) and all(b - a <= 2048 for a, b in zip([0, *cuts], cuts, strict=False)) and all(b - a >= 512 for a, b in zip([0, *cuts], cuts[:-1], strict=False))
    other = chunking.cut_points(data[:100] + b"inserted" + data[100:], 1024)
    assert len({c - 8 for c in other} & set(cuts)) > 0.8 * len(cuts)
    assert chunking.cut_points(b"", 1024) == []


def test_content_chunks_cover(spark):
    data = random.Random(3).randbytes(9000)
    got = chunking.content_chunks(spark.createDataFrame([(1, data), (2, b""), (3, None)], "k long, data binary"), "k", F.col("data"))
    assert {r["k"]: r["n"] for r in got.groupBy("k").agg(F.sum("size").alias("n")).collect()} == {1: 9000}


def test_catalogs(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    delta = spark.createDataFrame([(2, "b"), (3, None)], "k long, v string")
    assert {tuple(r) for r in catalog.overlay(base, delta, ["k"], "v").collect()} == {(1, "a", "base"), (2, "b", "delta"), (3, None, "delta")}
    assert catalog.shard_bits(1000, 100) == 4 and catalog.shard_bits(0, 1) == 0


def test_history(spark):
    heads = spark.createDataFrame([("d",)], "commit string")
    parents = spark.createDataFrame([("d", "c"), ("d", "b"), ("c", "b"), ("b", "a")], "commit string, parent string")
    got = {r["commit"]: (r["depth"], r["shallow"]) for r in sync.bounded_history(heads, parents, 2).collect()}
    assert got == {"d": (1, False), "c": (2, True), "b": (2, True)}


def test_needles_in_blocks(spark):
    t = spark.createDataFrame([(1, "abcabd"), (2, ""), (3, None)], "k long, t string")
    n = spark.createDataFrame([(1, "ab"), (2, "abd"), (3, "x"), (4, "ab"), (5, ""), (6, None)], "i long, n string")
    want = {(1, 1), (2, 1), (4, 1), (5, 1), (5, 2)}
    for block in (2, 100):
        assert {tuple(r) for r in find_needles(t, "k", "t", n, "i", "n", block=block).collect()} == want


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key long, value string")
    v1 = store.commit(None, {"kv": rows})
    checks = spark.createDataFrame([(0, 1, "a"), (1, 3, None)], "ordinal long, key long, expected string")
    changes = spark.createDataFrame([(1, "z", False), (2, "", True)], "key long, value string, removed boolean")
    v2 = commit_if(store, v1, "kv", ["key"], checks, changes, F.col("removed"))
    assert v2.generation == 2 and {tuple(r) for r in v2.read("kv").collect()} == {(1, "z")}
    assert v1.read("kv").count() == 2  # an older snapshot stays as it was
    with pytest.raises(StaleRevision):
        store.commit(v1, {"kv": rows})
    with pytest.raises(Conflict) as e:
        commit_if(store, v2, "kv", ["key"], spark.createDataFrame([(0, 1, "z"), (5, 1, "a"), (9, 1, "b")], "ordinal long, key long, expected string"), changes, F.col("removed"))
    assert e.value.check == 5 and store.version().revision == v2.revision
    with pytest.raises(ValueError):
        commit_if(store, v2, "kv", ["key"], checks.limit(0), changes.union(changes), F.col("removed"))
    assert store.vacuum(set()) == 1 and store.numbers() == [2]
    now = spark.createDataFrame([(1, "p", 1)], "key long, payload string, generation long")
    new = spark.createDataFrame([(1, "p"), (2, "q")], "key long, payload string")
    assert {tuple(r) for r in insert_new(now, new, ["key"], 7).collect()} == {(1, "p", 1), (2, "q", 7)}
    with pytest.raises(ValueError):
        insert_new(now, spark.createDataFrame([(1, "other")], "key long, payload string"), ["key"], 7)


def test_archives(spark, tmp_path):
    files = [("a/b.txt", b"hello", False), ("run", b"#!", True)]
    data = archives.write_tar(files)
    (tmp_path / "t.tar").write_bytes(data)
    got = {r["path"]: (bytes(r["data"]), r["executable"]) for r in archives.read_tar(spark, f"{tmp_path}/t.tar").collect()}
    assert got == {p: (d, x) for p, d, x in files} and archives.write_tar(files[::-1]) == data
    assert archives.detect(data[:512]) == "tar" and archives.detect(b"", {"HEAD", "objects", "refs"}) == "git"
    with pytest.raises(ValueError):
        archives.detect(b"nothing")
    with pytest.raises(ValueError):
        archives.clean_path("a/../b")
    with pytest.raises(ValueError):
        archives.tar_entries("t", archives.write_tar([("a", b"", False), ("a/b", b"", False)]))
    link = tmp_path / "l.tar"
    with tarfile.open(link, "w") as t:
        i = tarfile.TarInfo("h")
        i.type, i.linkname = tarfile.LNKTYPE, "missing"
        t.addfile(i)
    with pytest.raises(ValueError):
        archives.tar_entries("l", link.read_bytes())
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "sub" / "f").write_bytes(b"x")
    assert [(r["path"], r["size"]) for r in archives.read_folder(spark, f"{tmp_path}/d").collect()] == [("sub/f", 1)]
    assert archives.nar(("directory", {b"x": ("symlink", b"y")})).startswith(b"\x0d\0\0\0\0\0\0\0nix-archive-1")


def test_bundles(spark, tmp_path):
    payloads = spark.createDataFrame([(b"x",)], "data binary").withColumn("digest", F.sha2("data", 256))
    records = payloads.select(F.lit("n").alias("ns"), F.lit(1).cast("long").alias("id"), "digest")
    roots = spark.createDataFrame([("r", "n", 1)], "name string, ns string, id long")
    archives.write_bundle(records, payloads, roots, f"{tmp_path}/b")
    assert archives.read_bundle(spark, f"{tmp_path}/b")[0].count() == 1
    archives.write_bundle(records, payloads.union(payloads.select(F.lit(b"y"), F.sha2(F.lit(b"y"), 256))), roots, f"{tmp_path}/c")
    with pytest.raises(ValueError):
        archives.read_bundle(spark, f"{tmp_path}/c")


def test_following(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = "key long, value string, at long, removed boolean"
    src = f"{tmp_path}/in"

    def arrive(rows):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(src)
        follow(spark, src, df.schema, store, "kv", ["key"], "at", f"{tmp_path}/ck").awaitTermination()
        return {(r["key"], r["value"]) for r in store.version().read("kv").collect()}

    assert arrive([(1, "a", 1, False), (2, "b", 1, False), (1, "aa", 2, False)]) == {(1, "aa"), (2, "b")}
    assert arrive([(2, "", 3, True), (1, "old", 0, False), (3, "c", 1, False)]) == {(1, "aa"), (3, "c")}


def test_deep_graphs_are_contracted(spark, monkeypatch):
    """A chain of 2,000, branches, a cycle on the way and stops: levels as by plain walking."""
    import random

    from cairnlake.operators import closure as c

    monkeypatch.setattr(c, "PLAIN_LEVELS", 3)
    rnd = random.Random(3)
    edges = {(k, k + 1) for k in range(2000)} | {(2000, 5000), (5000, 5001), (5001, 5002), (5002, 5000)} | {(300, 6000), (6000, 1500), (40, 41), (9000, 9001), (9001, 9000)}
    edges |= {(7000 + k, 7000 + rnd.randrange(k)) for k in range(1, 40)} | {(1999, 7039)}
    links = spark.createDataFrame([("n", a, "n", b) for a, b in edges], "sns string, sid long, dns string, did long")
    seeds = spark.createDataFrame([("n", 0)], "ns string, id long")

    def walk(stop=()):
        level, front = {0: 0}, [0]
        out = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
        while front:
            new = []
            for a in front:
                for b in out.get(a, []) if a not in stop else []:
                    if b not in level:
                        level[b] = level[a] + 1
                        new.append(b)
            front = new
        return level

    assert {r["id"]: r["level"] for r in c.closure(seeds, links).collect()} == walk()
    stop = spark.createDataFrame([("n", 1700)], "ns string, id long")
    assert {r["id"]: r["level"] for r in c.closure(seeds, links, stop=stop).collect()} == walk({1700})
    with pytest.raises(ValueError):
        c.closure(seeds, links, max_nodes=1000)
    assert {r["id"]: r["level"] for r in c.closure(seeds, links, max_level=900).collect()} == {k: v for k, v in walk().items() if v <= 900}


def test_references_end_or_fail(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "nowhere")], "name string, to string")
    got = {r["name"]: (r["target"], r["hops"]) for r in tree.follow_refs(refs, 5).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None), "y": (None, None), "z": ("nowhere", 1)}
    assert {r["name"]: r["target"] for r in tree.follow_refs(refs, 1).collect()}["a"] is None


def test_lost_writers_block_nobody(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "a")], "key long, value string")
    v = store.commit(None, {"kv": rows})
    (tmp_path / "s" / "versions" / "draft-lost").write_bytes(b"")
    rows.write.parquet(f"{tmp_path}/s/data/kv-lost")
    v = store.commit(v, append={"kv": rows})
    assert v.read("kv").count() == 2 and store.sweep(0) == 2 and store.version().read("kv").count() == 2
    with pytest.raises(Exception, match="no such table"):
        store._claim = lambda *_: (_ for _ in ()).throw(OSError("no such table"))
        store.commit(v, append={"kv": rows})  # other failures are not taken for a lost race


def test_healing_reads(spark):
    import hashlib

    rows = [(k, hashlib.sha256(b"%d" % k).hexdigest(), b"%d" % k) for k in range(4)]
    wanted = spark.createDataFrame(rows, "k long, digest string, data binary")
    near = spark.createDataFrame([(0, b"0"), (1, b"bad")], "k long, data binary")
    far = spark.createDataFrame([(1, b"1"), (2, b"2"), (3, b"bad")], "k long, data binary")
    got = {r["k"]: (r["state"], r["data"] and bytes(r["data"])) for r in catalog.repairing_read(wanted, near, far, "k").collect()}
    assert got == {0: ("healthy", b"0"), 1: ("repaired", b"1"), 2: ("repaired", b"2"), 3: ("lost", None)}


def test_composed_deltas_do_what_both_do(spark):
    schema = "k long, value string, removed boolean"
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, value string")
    one = spark.createDataFrame([(1, "aa", False), (2, None, True), (4, "d", False)], schema)
    two = spark.createDataFrame([(2, "bb", False), (4, None, True), (5, "e", False)], schema)
    step = catalog.apply_delta(catalog.apply_delta(base, one, ["k"]), two, ["k"])
    assert {tuple(r) for r in catalog.apply_delta(base, catalog.compose(one, two, ["k"]), ["k"]).collect()} == {tuple(r) for r in step.collect()} == {(1, "aa"), (2, "bb"), (3, "c"), (5, "e")}


def test_overwrites_keep_bounds(spark):
    import hashlib
    import random

    rnd = random.Random(2)
    bodies = {k: bytes(rnd.randrange(97, 100) for _ in range(200)) for k in range(6)}
    cut = chunking.content_chunks(spark.createDataFrame(list(bodies.items()), "k long, data binary"), "k", F.col("data"), 16, with_data=True)
    manifest, chunks = cut.drop("data"), cut.select("chunk", "data").dropDuplicates(["chunk"])
    patches = {0: (0, b"XYZ"), 1: (50, b"long patch " * 5), 2: (190, b"beyond the end"), 3: (199, b"!"), 4: (10, b"")}
    new, fresh = chunking.overwrite(manifest, chunks, "k", spark.createDataFrame([(k, o, p) for k, (o, p) in patches.items()], "k long, offset long, patch binary"))
    held = {r["chunk"]: bytes(r["data"]) for r in chunks.union(fresh.select("chunk", "data")).collect()}
    assert all(hashlib.sha256(v).hexdigest() == k for k, v in held.items())
    got = {}
    for r in new.orderBy("k", "ord").collect():
        got[r["k"]] = got.get(r["k"], b"") + held[r["chunk"]]
    want = {k: (b[:o] + p + b[o + len(p) :])[: len(b)] if (o := patches.get(k, (0, b""))[0]) is not None and (p := patches.get(k, (0, b""))[1]) is not None else b for k, b in bodies.items()}
    assert got == want and fresh.count() < chunks.count()


def test_records(spark, tmp_path):
    from cairnlake.plans.records import Batch, Records

    records = Records(Store(spark, f"file://{tmp_path}/s"))
    b = Batch()
    for k in range(10):
        b.set("n", b"a/%d" % k, b"%d" % k)
    v1 = records.commit(b.set("n", b"b", b"x").set("m", b"a/1", b"other"))
    assert records.get([("n", b"a/3"), ("n", b"none"), ("n", b"a/3"), ("m", b"a/1")]) == [b"3", None, b"3", b"other"]
    v2 = records.commit(Batch().expect("n", b"a/3", b"3").expect("n", b"z", None).set("n", b"a/3", b"three").set("n", b"a/4", None))
    with pytest.raises(Conflict) as e:
        records.commit(Batch().expect("n", b"b", b"x").expect("n", b"a/3", b"3").set("n", b"b", None))
    assert e.value.check == 1
    with pytest.raises(StaleRevision):
        records.commit(Batch().set("n", b"b", None), v1)
    assert records.get([("n", b"a/3"), ("n", b"a/4")]) == [b"three", None] and records.get([("n", b"a/4")], v1) == [b"4"]
    page, cursor = records.scan("n", b"a/", limit=4)
    assert [k for k, _ in page] == [b"a/0", b"a/1", b"a/2", b"a/3"] and cursor == b"a/3"
    rest, end = records.scan("n", b"a/", after=cursor)
    assert [k for k, _ in rest] == [b"a/%d" % k for k in range(5, 10)] and end is None and len(v2.tables["records"]) == 3
    with pytest.raises(ValueError):
        Batch().set("n", b"k", b"1").set("n", b"k", b"2")
    with pytest.raises(ValueError):
        Batch().set("n", b"k" * 5000, b"")
