import pytest
from pyspark.sql import functions as F

from cairnlake.repository import TABLES, Repository

FILES = [("a/one.txt", b"one"), ("a/b/two.txt", b"two"), ("three.txt", b"three"), ("copy.txt", b"one")]


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, data binary")


def test_a_repository_lives(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/r")
    top = repo.import_files(files(spark, FILES), "home/first")
    assert {r["path"]: r["kind"] for r in repo.tree(top).collect()} == {"a": "directory", "a/b": "directory", "a/b/two.txt": "file", "a/one.txt": "file", "three.txt": "file", "copy.txt": "file"}
    assert [r["name"] for r in repo.listing(top).collect()] == ["a", "copy.txt", "three.txt"]
    assert repo.checkout(top, f"{tmp_path}/out") == 4
    assert (tmp_path / "out" / "a" / "b" / "two.txt").read_bytes() == b"two"
    with pytest.raises(FileExistsError):
        repo.checkout(top, f"{tmp_path}/out")
    status = repo.closure_status("directory.v1", top)
    assert status.complete and status.objects == 6 and repo.fsck().count() == 0
    assert repo.cat(repo.tree(top).where("path = 'three.txt'").first()["child"], 1, 3) == b"hre"

    second = repo.import_files(files(spark, FILES[:1] + [("new.txt", b"new")]), "home/second")
    assert repo.version().read("payloads").count() == 9  # "one" is stored once
    assert [r["name"] for r in repo.roots("home").collect()] == ["home/first", "home/second"] and repo.roots("hom").count() == 0
    with pytest.raises(ValueError):
        repo.set_root("x", "blob.v1", "0" * 64)
    with pytest.raises(ValueError):
        repo.set_root("home/second", "directory.v1", top, expected={"home/second": None})

    other = Repository(spark, f"file://{tmp_path}/copy")
    assert other.transfer(repo, ["home/second"]) == {"transfer": 4}
    assert other.transfer(repo, ["home/second"]) == {"skip": 1}
    assert other.transfer(repo) == {"transfer": 5, "skip": 2}
    assert other.fsck().count() == 0 and other.closure_status("directory.v1", top).complete

    pin = repo.pin()
    assert repo.remove_root("home/first") and not repo.remove_root("home/first")
    assert repo.collect(dry_run=True) == {"objects": 0, "payloads": 0}
    repo.unpin(pin)
    preview = repo.collect(dry_run=True)
    assert repo.collect() == preview and preview["objects"] == 5
    assert repo.version().read("objects").count() == 4 and repo.fsck().count() == 0
    assert repo.closure_status("directory.v1", second).complete and not repo.closure_status("directory.v1", top).complete
    assert repo.vacuum() > 0 and repo.version().read("roots").count() == 1

    v = repo.version()
    broken = v.read("payloads").withColumn("data", F.when(F.col("data") == b"new", F.lit(b"bad")).otherwise(F.col("data"))).where(F.col("data") != b"one")
    repo.store.commit(v, {"payloads": broken})
    assert {r["issue"] for r in repo.fsck().collect()} == {"missing payload", "damaged payload"}
    assert repo.repair(other, dry_run=True)["replace"] == 2 and repo.fsck().count() == 2
    assert repo.repair(other)["replace"] == 2 and repo.fsck().count() == 0

    repo.export(f"{tmp_path}/bundle")
    third = Repository(spark, f"file://{tmp_path}/third")
    third.import_bundle(f"{tmp_path}/bundle")
    assert third.closure_status("directory.v1", second).complete and third.fsck().count() == 0


def test_eviction_frees_what_only_the_oldest_hold(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/r")
    ids = [repo.import_files(files(spark, [("f", bytes([65 + k]) * 100), ("shared", b"s" * 50)]), f"r{k}") for k in range(2)]
    for k, i in enumerate(ids):
        repo.set_root(f"r{k}", "directory.v1", i, evictable=True, last_use=10 - k)
    assert repo.evict(100) == ["r1"]
    assert [r["name"] for r in repo.roots().collect()] == ["r0"] and set(TABLES) == set(repo.version().tables)


def test_large_payloads_are_chunked(spark, tmp_path, monkeypatch):
    """Chunks are stored once, ranges read only theirs, and damage is found and repaired from a replica."""
    import random

    from cairnlake import repository

    monkeypatch.setattr(repository, "CHUNKED", 4000)
    monkeypatch.setattr(repository, "CHUNK_BYTES", 256)
    rnd = random.Random(1)
    body = bytes(rnd.randrange(256) for _ in range(20_000))
    repo, other = Repository(spark, f"file://{tmp_path}/r"), Repository(spark, f"file://{tmp_path}/o")
    rows = [("one", body), ("d/two", body[:9000] + b"edit" + body[9000:]), ("small", b"s")]
    top = repo.import_files(files(spark, rows), "home")
    use = repo.usage()
    assert use["stored_bytes"] < 26_000 < 40_000 < use["named_bytes"] and repo.fsck().count() == 0
    one, two = repo.getattr(top, "one")["child"], repo.getattr(top, "d/two")["child"]
    assert repo.cat(two, 8990, 30) == rows[1][1][8990:9020] and repo.cat(one) == body and repo.cat(one, 19_990, 100) == body[-10:]
    assert repo.checkout(top, f"{tmp_path}/out") == 3 and (tmp_path / "out" / "d" / "two").read_bytes() == rows[1][1]
    assert {r["n"] for r in repo.chunk_listing().collect()} >= {1, 2}
    other.transfer(repo)
    v = repo.version()
    first = v.read("manifests").where(F.col("digest") == one).orderBy("ord").first()["chunk"]
    repo.store.commit(v, {"chunks": v.read("chunks").where(F.col("chunk") != first)})
    assert {r["issue"] for r in repo.fsck().collect()} == {"damaged payload"}
    with pytest.raises(ValueError):
        repo.cat(one, 0, 10)
    assert repo.repair(other)["replace"] == 2 and repo.fsck().count() == 0
    assert repo.remove_root("home") and repo.collect()["payloads"] == 5 and repo.chunk_listing().count() == 0


def test_objects_paths_and_roots(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/r")
    tops = repo.import_many(spark.createDataFrame([("r1", *f) for f in FILES] + [("r2", "x", b"x")], "root string, path string, data binary"))
    got = repo.show("directory.v1", tops["r1"])
    assert got["validated"] and len(got["links"]) == 3 and repo.get("blob.v1", "0") is None
    assert repo.getattr(tops["r1"], "a/b/two.txt")["size"] == 3 and repo.getattr(tops["r1"], "")["kind"] == "directory"
    for path in ("a/none", "three.txt/x"):
        with pytest.raises(FileNotFoundError):
            repo.getattr(tops["r1"], path)
    with pytest.raises(ValueError):
        repo.readlink(tops["r1"], "three.txt")
    proof = repo.path_proof(tops["r1"], "a/b")
    assert [p["name"] for p in proof] == ["a", "b"] and proof[0]["dir"] == tops["r1"]
    other = Repository(spark, f"file://{tmp_path}/o")
    assert other.transfer_path(repo, tops["r1"], "a/b", "part") == {"transfer": 2}
    assert [r["name"] for r in other.listing(other.roots().first()["id"]).collect()] == ["two.txt"] and other.fsck().count() == 0
    loose = repo.import_files(files(spark, [("only", b"loose")]), None)
    assert repo.get("directory.v1", loose)["validated"] is False and repo.collect(dry_run=True)["objects"] == 2
    assert not repo.remove_root_if("r2", "0") and repo.remove_root_if("r2", tops["r2"])
    pin = repo.pin()
    assert [r["token"] for r in repo.pins().collect()] == [pin]
    repo.set_root("e", "directory.v1", tops["r1"], evictable=True, last_use=3)
    repo.touch_roots(spark.createDataFrame([("e", 9), ("r1", 9)], "name string, at long"))
    assert {r["name"]: r["last_use"] for r in repo.roots().collect()} == {"e": 9, "r1": 0}


def test_holds(spark, tmp_path):
    """A hold spares what its objects reach; it can be narrowed and ends with its release."""
    repo = Repository(spark, f"file://{tmp_path}/r")
    tops = [repo.import_files(files(spark, [("f", b"%d" % k)]), None) for k in range(2)]
    keys = lambda ids: spark.createDataFrame([("directory.v1", i) for i in ids], "ns string, id string")
    with pytest.raises(KeyError):
        repo.hold(keys(["0"]))
    token = repo.hold(keys(tops), "transfer")
    assert [(r["scope"], r["n"]) for r in repo.holds().collect()] == [("transfer", 2)] and repo.holds("other").count() == 0
    assert repo.collect() == {"objects": 0, "payloads": 0} and repo.access(tops[0], "f") and not repo.access(tops[0], "f", execute=True) and not repo.access(tops[0], "g")
    repo.narrow(token, keys(tops[:1]))
    assert repo.try_collect()["objects"] == 2
    assert repo.release(token) and not repo.release(token) and repo.collect()["objects"] == 2
