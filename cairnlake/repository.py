"""A content-addressed repository on versioned tables: import, read, publish, collect, audit, repair, synchronize.

Tables of a version:

* ``objects`` (ns, id, payload, size, generation): immutable records; ``id`` is text, and for
  blobs and directories the SHA-256 of the payload
* ``verified`` (ns, id): facts, objects whose closures were found complete
* ``links`` (sns, sid, dns, did): what an object names
* ``entries`` (dir, name, kind, child, size, executable, target): directory contents
* ``payloads`` (digest, size, data): bytes, once each; null data of a payload that is kept in chunks
* ``manifests`` (digest, ord, chunk, size), ``chunks`` (chunk, data): payloads of ``CHUNKED`` bytes and more, cut by content
* ``ingested`` (path, at, size, digest): files as they were when a folder was imported
* ``roots`` (name, ns, id, evictable, last_use)
* ``pins`` (token, generation): snapshots that collection must spare
* ``holds`` (token, scope, ns, id): objects, with all they reach, that collection must spare

Every change is one commit against the version it was made from, which appends what is new; collection writes tables anew. Whatever is large stays a DataFrame; the
driver sees counts, versions and first failures.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.operators import audit, chunking, kv, sync
from cairnlake.operators.closure import closure, first_missing
from cairnlake.plans.spool import spool
from cairnlake.plans.versioned import StaleRevision, Store, Version, new_rows
from cairnlake.sources import git, images
from cairnlake.sources.archives import read_bundle, write_bundle

KEY = ["ns", "id"]
TABLES = {
    "objects": "ns string, id string, payload string, size long, generation long",
    "verified": "ns string, id string",
    "links": "sns string, sid string, dns string, did string",
    "entries": "dir string, name string, kind string, child string, size long, executable boolean, target string",
    "payloads": "digest string, size long, data binary",
    "manifests": "digest string, ord long, chunk string, size long",
    "chunks": "chunk string, data binary",
    "ingested": "path string, at timestamp, size long, digest string",
    "roots": "name string, ns string, id string, evictable boolean, last_use long",
    "pins": "token string, generation long",
    "holds": "token string, scope string, ns string, id string",
}
#: Changed files of a folder that are read one by one.
READ_FILES = 100_000
#: Payloads of so many bytes are kept in chunks of this size on average.
CHUNKED, CHUNK_BYTES = 1 << 20, 1 << 16


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


@dataclass
class Status:
    """Of a closure: complete with so many objects, or the first missing link in breadth-first order."""

    complete: bool
    objects: int
    missing: tuple | None = None


class Repository:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        if self.store.version() is None:
            self.store.commit(None, {k: spark.createDataFrame([], s) for k, s in TABLES.items()})

    def version(self, number: int | None = None) -> Version:
        return self.store.version(number)

    # -- reading

    def objects_at(self, version: Version, generation: int | None = None) -> DataFrame:
        """All objects in order of their keys, or those born by a generation."""
        got = version.read("objects")
        return (got if generation is None else kv.as_of(got, generation)).orderBy(*KEY)

    def get(self, ns: str, id: str, version: Version | None = None) -> dict | None:
        """The record of one object, with whether its closure is verified; None if there is none."""
        v = version or self.version()
        rows = v.read("objects").where((F.col("ns") == ns) & (F.col("id") == id)).limit(1).collect()
        if not rows:
            return None
        seen = v.read("verified").where((F.col("ns") == ns) & (F.col("id") == id)).isEmpty()
        return rows[0].asDict() | {"validated": not seen}

    def get_many(self, wanted: DataFrame, *, validated_only: bool = False) -> DataFrame:
        """A row for each requested (ordinal, ns, id), misses included; with ``validated_only`` what is not verified reads as missing."""
        v = self.version()
        have = v.read("objects")
        return wanted.join(have.join(v.read("verified"), KEY, "left_semi") if validated_only else have, KEY, "left")

    def show(self, ns: str, id: str) -> dict:
        """An object's record, and what it links to, in order."""
        got = self.get(ns, id)
        if got is None:
            raise KeyError((ns, id))
        out = self.version().read("links").where((F.col("sns") == ns) & (F.col("sid") == id)).orderBy("dns", "did")
        return got | {"links": [(r["dns"], r["did"]) for r in out.toLocalIterator()]}

    def roots(self, prefix: str | None = None) -> DataFrame:
        got = self.version().read("roots")
        return (got if prefix is None else got.where(kv.under(F.col("name"), prefix))).orderBy("name")

    def pins(self) -> DataFrame:
        """Snapshots that are held, the oldest first."""
        return self.version().read("pins").orderBy("generation", "token")

    def listing(self, directory: str) -> DataFrame:
        """Direct entries of a directory, in order of names."""
        return self.version().read("entries").where(F.col("dir") == directory).orderBy("name")

    def getattr(self, directory: str, path: str) -> dict:
        """The entry that a path names below a directory, which itself is the empty path."""
        if not path.strip("/"):
            return {"name": "", "kind": "directory", "child": directory, "size": None, "executable": False, "target": None}
        at, entries = directory, self.version().read("entries")
        parts = [p for p in path.split("/") if p]
        for k, name in enumerate(parts):
            rows = entries.where((F.col("dir") == at) & (F.col("name") == name)).limit(1).collect()
            if not rows or (k + 1 < len(parts) and rows[0]["kind"] != "directory"):
                raise FileNotFoundError(path)
            at = rows[0]["child"]
        return {c: rows[0][c] for c in _columns("entries")[1:]}

    def access(self, directory: str, path: str, *, execute: bool = False) -> bool:
        """Whether a path can be read below a directory, or run; what is stored is never written to."""
        try:
            got = self.getattr(directory, path)
        except FileNotFoundError:
            return False
        return not execute or got["kind"] == "directory" or bool(got["executable"])

    def readlink(self, directory: str, path: str) -> str:
        got = self.getattr(directory, path)
        if got["kind"] != "symlink":
            raise ValueError(f"{path} is no symbolic link")
        return got["target"]

    def cat(self, digest: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of one payload, after what was read is checked: the whole payload, or of one in chunks those that the range needs."""
        v = self.version()
        rows = v.read("payloads").where(F.col("digest") == digest).withColumn("ok", F.sha2("data", 256) == F.col("digest")).limit(1).collect()
        if not rows:
            raise KeyError(digest)
        end = rows[0]["size"] if length is None else min(rows[0]["size"], offset + length)
        if rows[0]["data"] is None and end > offset:
            got = chunking.read_range(v.read("manifests").where(F.col("digest") == digest), v.read("chunks"), "digest", offset, end - offset).first()
            if got is None or got["data"] is None or len(got["data"]) != end - offset:
                raise ValueError(f"the payload of {digest} is damaged")
            return bytes(got["data"])
        if rows[0]["data"] is not None and not rows[0]["ok"]:
            raise ValueError(f"the payload of {digest} is damaged")
        return bytes(rows[0]["data"] or b"")[offset:end]

    def bodies(self, version: Version | None = None) -> DataFrame:
        """(digest, size, data) of all payloads, those in chunks put together; null data where a chunk is missing."""
        v = version or self.version()
        own = v.read("payloads")
        cut = v.read("manifests").join(v.read("chunks"), "chunk", "left")
        made = cut.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("data").alias("x")))).alias("x"), F.count_if(F.col("data").isNull()).alias("n"))  # one payload's chunks
        made = made.select("digest", F.when(F.col("n") == 0, F.unhex(F.array_join("x.x", ""))).alias("_made"))
        return own.join(made, "digest", "left").select("digest", "size", F.coalesce("data", "_made").alias("data"))

    def chunk_listing(self) -> DataFrame:
        """(chunk, size, n) of stored chunks, and how many places of manifests name each."""
        v = self.version()
        uses = v.read("manifests").groupBy("chunk").agg(F.count("*").alias("n"))
        return v.read("chunks").select("chunk", F.octet_length("data").cast("long").alias("size")).join(uses, "chunk", "left").fillna(0, ["n"])

    def usage(self) -> dict[str, int]:
        """Objects, payloads, their bytes as named by objects and as stored."""
        v = self.version()
        named = v.read("objects").agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        inline = v.read("payloads").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("size")).first()
        held = v.read("chunks").agg(F.sum(F.octet_length("data")).alias("size")).first()
        return {"objects": named["n"], "named_bytes": named["size"] or 0, "payloads": inline["n"], "stored_bytes": (inline["size"] or 0) + (held["size"] or 0)}

    def tree(self, directory: str) -> DataFrame:
        """(path, kind, child, size, executable, target) of all that a directory holds, level by level, each written once."""
        entries = self.version().read("entries")
        level = spool(entries.where(F.col("dir") == directory).withColumn("path", F.col("name")), "tree")
        out = level
        while not (deeper := level.where("kind = 'directory'")).isEmpty():
            up = deeper.select(F.col("child").alias("dir"), F.col("path").alias("_at"))
            level = spool(entries.join(up, "dir").withColumn("path", F.concat_ws("/", "_at", "name")).drop("_at"), "tree")
            out = out.unionByName(level)
        return out.select("path", "kind", "child", "size", "executable", "target")

    def path_proof(self, directory: str, path: str) -> list[dict]:
        """The entries that lead from a directory to a path, each of the directory before it: what a reader needs to trust the last one."""
        out, at = [], directory
        parts = [p for p in path.split("/") if p]
        for k in range(len(parts)):
            own = {r["name"]: {c: r[c] for c in _columns("entries")[1:]} for r in self.listing(at).collect()}  # one directory
            if parts[k] not in own:
                raise FileNotFoundError(path)
            out.append({"dir": at, "name": parts[k], "entries": [own[n] for n in sorted(own)]})
            at = own[parts[k]]["child"]
        return out

    def closure_status(self, ns: str, id: str, max_objects: int = 10_000_000) -> Status:
        v = self.version()
        links, objects = v.read("links"), v.read("objects")
        got = closure(self.spark.createDataFrame([(ns, id)], "ns string, id string"), links, max_nodes=max_objects)
        if objects.where((F.col("ns") == ns) & (F.col("id") == id)).isEmpty():
            return Status(False, 0, (ns, id))
        bad = first_missing(got, links, objects).collect()
        return Status(not bad, got.count(), (bad[0]["dns"], bad[0]["did"]) if bad else None)

    # -- writing

    def publish(self, objects: DataFrame, links: DataFrame, payloads: DataFrame, roots: DataFrame | None = None, entries: DataFrame | None = None, *, base: Version | None = None, expected: dict[str, str | None] | None = None, retries: int = 4) -> Version:
        """Insert records and set roots in one commit, if the new roots' closures are complete.

        ``objects`` (ns, id, payload, size). ``expected``: ids that roots must have now (None: absent). Without
        ``base`` a commit that came between is met by trying again.
        """
        for attempt in range(retries):
            v = base or self.version()
            now = {r["name"]: r["id"] for r in v.read("roots").where(F.col("name").isin(list(expected or {}))).collect()}
            for name, want in (expected or {}).items():
                if now.get(name) != want:
                    raise ValueError(f"root {name} is not what was expected")
            fresh = new_rows(v.read("objects"), objects.select("ns", "id", "payload", "size"), KEY).withColumn("generation", F.lit(v.generation + 1).cast("long"))
            fresh = spool(fresh.select(*_columns("objects")), "publish-objects")
            new_links = spool(links.select(*_columns("links")).distinct().join(v.read("links"), _columns("links"), "left_anti"), "publish-links")
            append = {"objects": fresh, "links": new_links} | self._stored(v, payloads)
            tables = {}
            if roots is not None:
                seeds, all_links = roots.select(*KEY), v.read("links").union(new_links)
                every = v.read("objects").union(fresh)
                reached = closure(seeds, all_links, stop=v.read("verified"))
                bad = first_missing(reached, all_links, every).collect()
                if bad or not seeds.join(every, KEY, "left_anti").isEmpty():
                    raise ValueError(f"a root's closure is incomplete: {tuple(bad[0]) if bad else 'the root itself'}")
                append["verified"] = reached.select(*KEY).join(v.read("verified"), KEY, "left_anti")
                own = v.read("roots")
                tables["roots"] = own.join(roots.select("name"), "name", "left_anti").unionByName(roots.select(*own.columns))
            if entries is not None:
                append["entries"] = entries.select(*_columns("entries")).distinct().join(v.read("entries").select("dir").distinct(), "dir", "left_anti").select(*_columns("entries"))
            try:
                return self.store.commit(v, tables, append=append)
            except StaleRevision:
                if base is not None or attempt + 1 == retries:
                    raise
        raise StaleRevision

    def _stored(self, v: Version, payloads: DataFrame) -> dict[str, DataFrame]:
        """What payloads (digest, size, data) add to the tables: bytes of small ones, manifests and new chunks of large ones."""
        new = spool(payloads.select("digest", "size", "data").dropDuplicates(["digest"]).join(v.read("payloads").select("digest"), "digest", "left_anti"), "publish-payloads")
        large = new.where(F.octet_length("data") >= CHUNKED)
        out = {"payloads": new.withColumn("data", F.when(F.octet_length("data") < CHUNKED, F.col("data")))}
        if not large.isEmpty():
            cut = spool(chunking.content_chunks(large, "digest", F.col("data"), CHUNK_BYTES, with_data=True), "publish-chunks")
            out["manifests"] = cut.select(*_columns("manifests"))
            out["chunks"] = cut.select("chunk", "data").dropDuplicates(["chunk"]).join(v.read("chunks").select("chunk"), "chunk", "left_anti")
        return out

    def set_root(self, name: str, ns: str, id: str, *, evictable: bool = False, last_use: int = 0, expected: dict | None = None) -> Version:
        none = {k: self.spark.createDataFrame([], TABLES[k]) for k in ("objects", "links", "payloads")}
        roots = self.spark.createDataFrame([(name, ns, id, evictable, last_use)], TABLES["roots"])
        return self.publish(none["objects"].select("ns", "id", "payload", "size"), none["links"], none["payloads"], roots, expected=expected)

    def remove_root(self, name: str) -> bool:
        v = self.version()
        own = v.read("roots")
        if own.where(F.col("name") == name).isEmpty():
            return False
        self.store.commit(v, {"roots": own.where(F.col("name") != name)})
        return True

    def remove_root_if(self, name: str, id: str) -> bool:
        """Remove a root if it is what the caller knows; whether it was."""
        v = self.version()
        own = v.read("roots")
        if own.where((F.col("name") == name) & (F.col("id") == id)).isEmpty():
            return False
        self.store.commit(v, {"roots": own.where(F.col("name") != name)})
        return True

    def touch_roots(self, uses: DataFrame) -> Version:
        """Raise the last use of evictable roots to the newest of ``uses`` (name, at)."""
        v = self.version()
        own = v.read("roots")
        return self.store.commit(v, {"roots": sync.touch(own, uses).select(*own.columns)})

    def import_many(self, files: DataFrame) -> dict[str, str]:
        """Publish files (root, path, data[, executable]) under as many roots; the tree's id of each."""
        names = sorted(r["root"] for r in files.select("root").distinct().collect())  # a row for each root
        return {name: self.import_files(files.where(F.col("root") == name).drop("root"), name) for name in names}

    def import_files(self, files: DataFrame, root: str | None) -> str:
        """Publish files (path, data[, executable, target]) as a directory tree under a root, or without one; returns the tree's id.

        A file with a ``target`` is a symbolic link. Files whose ``digest`` and ``size`` are given may have no data, if it is stored already.

        A level of directories is written once; the entries of one directory are one row, as its digest is of all of them.
        """
        given = {"executable": F.lit(False), "target": F.lit(None).cast("string"), "digest": F.sha2("data", 256), "size": F.octet_length("data").cast("long")}
        f = spool(files.select("path", "data", *(F.col(c) if c in files.columns else x.alias(c) for c, x in given.items())), "import-files")
        kind = F.when(F.col("target").isNotNull(), "symlink").otherwise("file")
        level = f.select("path", kind.alias("kind"), F.when(kind == "file", F.col("digest")).alias("child"), F.when(kind == "file", F.col("size")).otherwise(F.octet_length("target")).cast("long").alias("size"), "executable", "target")
        f = f.where("target IS NULL")
        depth = level.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
        every = None
        parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
        fields = ["name", "kind", "child", "size", "executable", "target"]
        for d in range(depth, 0, -1):  # one aggregation for each level
            own = level.where(F.size(F.split("path", "/")) == d).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
            rest = level.where(F.size(F.split("path", "/")) < d)
            dirs = own.groupBy(parent.alias("path")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
            dirs = dirs.withColumn("text", F.to_json("e")).withColumn("child", F.sha2("text", 256)).withColumn("n", F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + 1 + F.when(x["kind"] == "directory", x["size"]).otherwise(0)))
            dirs = spool(dirs, "import-level")
            every = dirs if every is None else every.union(dirs)
            up = dirs.where("path <> ''").select("path", F.lit("directory").alias("kind"), "child", F.col("n").alias("size"), F.lit(False).alias("executable"), F.lit(None).cast("string").alias("target"))
            level = rest.union(up)
        if every is None:
            raise ValueError("there are no files")
        top = every.where("path = ''").first()["child"]
        entries = every.select(F.col("child").alias("dir"), F.inline("e")).distinct()
        bodies = every.select(F.col("child").alias("digest"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("data")).unionByName(f.where("data IS NOT NULL").select("digest", "size", "data")).dropDuplicates(["digest"])
        ns = lambda kind: F.when(kind == "directory", "directory.v1").otherwise("blob.v1")
        links = entries.where("kind <> 'symlink'").select(F.lit("directory.v1").alias("sns"), F.col("dir").alias("sid"), ns(F.col("kind")).alias("dns"), F.col("child").alias("did")).distinct()
        objects = every.select(F.lit("directory.v1").alias("ns"), F.col("child").alias("id"), F.col("child").alias("payload"), F.octet_length("text").cast("long").alias("size")).union(f.select(F.lit("blob.v1"), "digest", "digest", "size")).distinct()
        roots = None if root is None else self.spark.createDataFrame([(root, "directory.v1", top, False, 0)], TABLES["roots"])
        self.publish(objects, links, bodies, roots, entries)
        return top

    def import_image(self, path: str, root: str, platform: str | None = None) -> tuple[str, dict]:
        """Publish the merged tree of an image layout; its id, and the image's config."""
        config, layers = images.read_layout(self.spark, path, platform)
        return self.import_files(images.image_files(layers), root), config

    def import_git(self, objects: DataFrame, commit: str, root: str) -> str:
        """Publish the tree that a commit names among objects (oid, kind, body), of packs or loose."""
        return self.import_files(git.view(objects, commit), root)

    def import_folder(self, folder: str, root: str) -> tuple[str, int]:
        """Publish the files under a folder; the tree's id, and how many files were read.

        Files of the path, size and time of change of an earlier import are not read again. Files to be read are named by the driver, at most
        ``READ_FILES`` of them; beyond that all are read.
        """
        top = folder.rstrip("/")
        every = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
        seen = spool(every.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size")), "folder")
        known = self.version().read("ingested").groupBy("path", "at", "size").agg(F.max("digest").alias("digest"))
        known = known.join(self.version().read("payloads").select("digest"), "digest", "left_semi")
        met = spool(seen.join(known, ["path", "at", "size"], "left"), "folder-met")
        fresh = [r["path"] for r in met.where("digest IS NULL").select("path").limit(READ_FILES + 1).collect()]
        if len(fresh) > READ_FILES:
            met, read = seen.withColumn("digest", F.lit(None).cast("string")), every
        else:
            read = self.spark.read.format("binaryFile").load(fresh) if fresh else every.limit(0)
        read = spool(read.select("path", F.sha2("content", 256).alias("_new"), F.col("content").alias("data")), "folder-read")
        plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
        start = len(self.spark.range(1).select(plain(F.lit(f"{top}/"))).first()[0]) + 1
        files = met.join(read, "path", "left").select("path", "at", F.substring(plain(F.col("path")), start, 1 << 20).alias("name"), "size", F.coalesce("digest", "_new").alias("digest"), "data")
        files = spool(files, "folder-files")
        tree = self.import_files(files.select(F.col("name").alias("path"), "data", "digest", "size"), root)
        self.store.commit(self.version(), append={"ingested": files.where("data IS NOT NULL").select(*_columns("ingested"))})
        return tree, read.count()

    def checkout(self, directory: str, target: str) -> int:
        """Write a tree beside ``target`` and rename it into place; ``target`` must not exist. Returns the files written.

        ``target`` must be on a file system that executors and driver share.
        """
        if os.path.exists(target) and os.listdir(target):
            raise FileExistsError(target)
        stage = f"{target}.{uuid.uuid4().hex}"
        files = self.tree(directory).where("kind <> 'directory'").join(self.bodies().select(F.col("digest").alias("child"), "data"), "child", "left")

        def write(rows) -> None:
            import hashlib

            for r in rows:
                at = os.path.join(stage, r["path"])
                os.makedirs(os.path.dirname(at), exist_ok=True)
                draft = f"{at}.{uuid.uuid4().hex}"  # a task that is tried again writes beside what it left
                if r["kind"] == "symlink":
                    os.symlink(r["target"], draft)
                    os.replace(draft, at)
                    continue
                if r["data"] is None or hashlib.sha256(r["data"]).hexdigest() != r["child"]:
                    raise ValueError(f"the payload of {r['path']} is missing or damaged")
                with open(draft, "wb") as out:
                    out.write(r["data"])
                if r["executable"]:
                    os.chmod(draft, 0o755)
                os.replace(draft, at)

        os.makedirs(stage)
        n = files.count()
        files.foreachPartition(write)
        if os.path.exists(target):
            os.rmdir(target)
        os.rename(stage, target)
        return n

    # -- maintenance

    def pin(self) -> str:
        """Keep the objects of now readable until ``unpin``."""
        v, token = self.version(), uuid.uuid4().hex
        self.store.commit(v, {"pins": v.read("pins").union(self.spark.createDataFrame([(token, v.generation)], TABLES["pins"]))})
        return token

    def unpin(self, token: str) -> None:
        v = self.version()
        self.store.commit(v, {"pins": v.read("pins").where(F.col("token") != token)})

    def hold(self, objects: DataFrame, scope: str = "") -> str:
        """Keep objects (ns, id) and what they reach until ``release``; the token of the hold. One that is not stored is an error."""
        v, token = self.version(), uuid.uuid4().hex
        own = spool(objects.select(*KEY).distinct(), "hold")
        if not own.join(v.read("objects"), KEY, "left_anti").isEmpty():
            raise KeyError("an object to be held is not stored")
        self.store.commit(v, append={"holds": own.select(F.lit(token).alias("token"), F.lit(scope).alias("scope"), *KEY)})
        return token

    def narrow(self, token: str, objects: DataFrame) -> None:
        """Let a hold keep only those of its objects that are given; it never grows."""
        v = self.version()
        own = v.read("holds")
        kept = own.where(F.col("token") == token).join(objects.select(*KEY).distinct(), KEY, "left_semi")
        self.store.commit(v, {"holds": own.where(F.col("token") != token).unionByName(kept.select(*_columns("holds")))})

    def release(self, token: str) -> bool:
        """End a hold; whether there was one."""
        v = self.version()
        own = v.read("holds")
        if own.where(F.col("token") == token).isEmpty():
            return False
        self.store.commit(v, {"holds": own.where(F.col("token") != token)})
        return True

    def holds(self, scope: str | None = None) -> DataFrame:
        """(token, scope, n) of the holds there are."""
        own = self.version().read("holds")
        return (own if scope is None else own.where(F.col("scope") == scope)).groupBy("token", "scope").agg(F.count("*").alias("n"))

    def live(self, v: Version) -> DataFrame:
        """What roots and holds reach, and what was born by a pinned generation."""
        pinned = v.read("pins").agg(F.max("generation")).first()[0]
        seeds = v.read("roots").select(*KEY).union(v.read("holds").select(*KEY))
        if pinned is not None:
            seeds = seeds.union(kv.as_of(v.read("objects"), pinned).select(*KEY))
        return closure(seeds, v.read("links")).select(*KEY)

    def collect(self, *, dry_run: bool = False) -> dict[str, int]:
        """Drop objects that nothing live reaches, and payloads that no object left has; counts of what went, or would."""
        v = self.version()
        objects, live = v.read("objects"), self.live(v)
        if not v.read("roots").select(*KEY).join(objects, KEY, "left_anti").isEmpty():
            raise ValueError("a root's object is missing")
        kept = objects.join(live, KEY, "left_semi")
        payloads = v.read("payloads").join(kept.select(F.col("payload").alias("digest")), "digest", "left_semi")
        out = {"objects": objects.count() - kept.count(), "payloads": v.read("payloads").count() - payloads.count()}
        if not dry_run and any(out.values()):
            alive = kept.select(*KEY)
            links = v.read("links").join(alive.select(F.col("ns").alias("sns"), F.col("id").alias("sid")), ["sns", "sid"], "left_semi")
            entries = v.read("entries").join(alive.where("ns = 'directory.v1'").select(F.col("id").alias("dir")), "dir", "left_semi")
            manifests = v.read("manifests").join(payloads.select("digest"), "digest", "left_semi")
            chunks = v.read("chunks").join(manifests.select("chunk"), "chunk", "left_semi")
            verified = v.read("verified").distinct().join(alive, KEY, "left_semi")
            new = {"objects": kept, "payloads": payloads, "links": links, "entries": entries, "manifests": manifests, "chunks": chunks, "verified": verified}
            self.store.commit(v, {k: df.select(*_columns(k)) for k, df in new.items()})
        return out

    def try_collect(self) -> dict[str, int] | None:
        """Collect if no other commit comes between; None if one does."""
        try:
            return self.collect()
        except StaleRevision:
            return None

    def eviction_plan(self, need: int) -> DataFrame:
        """(name, rank, freed): the evictable roots to remove, least recently used first, so that ``need`` bytes that only they hold are free.

        A payload is free once the last root that reaches it is gone; the rank of that root is carried along links once for all roots.
        """
        v = self.version()
        order = ["last_use", "name"]
        evictable = spool(v.read("roots").where("evictable"), "evict-roots")
        ranked = evictable.select("name", *KEY, F.struct(*order).alias("rank"))
        pinned = v.read("pins").agg(F.max("generation")).first()[0]
        kept = v.read("roots").where("NOT evictable").select(*KEY).union(v.read("holds").select(*KEY))
        if pinned is not None:
            kept = kept.union(kv.as_of(v.read("objects"), pinned).select(*KEY))
        spared = closure(kept, v.read("links")).select(*KEY)
        held = audit.holders(ranked.select(*KEY, "rank"), v.read("links"), spared)
        safe = v.read("objects").join(spared, KEY, "left_semi").select("payload")
        own = v.read("objects").join(held, KEY).groupBy("payload").agg(F.max("rank").alias("rank"), F.max("size").alias("size")).join(safe, "payload", "left_anti")
        freed = own.groupBy("rank").agg(F.sum("size").alias("freed"))
        rows = spool(ranked.select("name", "rank").join(freed, "rank", "left").select("name", "rank.last_use", F.coalesce("freed", F.lit(0)).cast("long").alias("freed")), "evict-rows")
        return audit.evict(rows, order, F.col("freed"), need, F.col("last_use"))

    def evict(self, need: int) -> list[str]:
        """Remove evictable roots, least recently used first, until ``need`` bytes that only they hold are free: one plan, one commit, one collection."""
        gone = [r["name"] for r in self.eviction_plan(need).orderBy("last_use", "name").select("name").collect()]  # names only
        if gone:
            v = self.version()
            self.store.commit(v, {"roots": v.read("roots").join(self.spark.createDataFrame([(n,) for n in gone], "name string"), "name", "left_anti").select(*_columns("roots"))})
            self.collect()
        return gone

    def vacuum(self) -> int:
        """Delete old versions, the files that only they have, and what lost writers left a day ago or earlier."""
        self.store.sweep()
        return self.store.vacuum(set())

    def fsck(self) -> DataFrame:
        """(issue, ns, id) of all findings."""
        v = self.version()
        objects, links, payloads = v.read("objects"), v.read("links"), spool(self.bodies(v), "fsck-payloads")
        stored = payloads.select(F.col("digest").alias("payload"), F.col("size").alias("_size"), F.coalesce(F.sha2("data", 256) == F.col("digest"), F.lit(False)).alias("_ok"))
        met = objects.join(stored, "payload", "left")
        return audit.issues(
            {
                "dangling link": audit.dangling(objects, links),
                "missing root object": v.read("roots").select(*KEY).join(objects, KEY, "left_anti"),
                "missing payload": met.where("_ok IS NULL").select(*KEY),
                "damaged payload": met.where("NOT _ok").select(*KEY),
                "wrong size": met.where("_ok AND _size <> size").select(*KEY),
                "stale payload": payloads.join(objects.select(F.col("payload").alias("digest")), "digest", "left_anti").select(F.lit("payload").alias("ns"), F.col("digest").alias("id")),
            }
        )

    def repair(self, replica: Repository, *, dry_run: bool = False) -> dict[str, int]:
        """Replace missing and damaged payloads by intact ones of a replica; how many of each action."""
        v = self.version()
        check = lambda df: df.withColumn("_seen", F.sha2("data", 256))
        expected = v.read("objects").select(F.col("payload").alias("digest")).distinct()
        mine, other = (check(spool(x, "repair")).where("data IS NOT NULL") for x in (self.bodies(v), replica.bodies()))
        plan = audit.repair_plan(expected.withColumn("_seen", F.col("digest")), mine, other, "digest", "_seen")
        out = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        if not dry_run and out.get("replace"):
            fix = plan.where("action = 'replace'").select("digest")
            new = v.read("payloads").join(fix, "digest", "left_anti").unionByName(other.drop("_seen").join(fix, "digest", "left_semi"))
            self.store.commit(v, {"payloads": new.select("digest", "size", "data"), "manifests": v.read("manifests").join(fix, "digest", "left_anti").select(*_columns("manifests"))})
        return out

    def transfer(self, source: Repository, names: list[str] | None = None, *, reuse: bool = True, roots: DataFrame | None = None) -> dict[str, int]:
        """Copy roots, all, named or given ones, and their closures from another repository; equal objects are skipped, different ones are an error.

        With ``reuse``, descendants of objects whose closures are verified here are not looked at.
        """
        s, d = source.version(), self.version()
        if roots is None:
            roots = s.read("roots") if names is None else s.read("roots").where(F.col("name").isin(names))
        have = d.read("objects")
        reached = closure(roots, s.read("links"), stop=d.read("verified") if reuse else None).select(*KEY)
        offered = s.read("objects").join(reached, KEY, "left_semi")
        plan = sync.plan(offered.select(*KEY, "payload"), have, KEY, "payload")
        counts = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
        if counts.get("conflict"):
            raise ValueError("an object differs at the destination")
        new = offered.join(plan.where("status = 'transfer'"), KEY, "left_semi")
        bodies = source.bodies(s).join(new.select(F.col("payload").alias("digest")), "digest", "left_semi").join(d.read("payloads").select("digest"), "digest", "left_anti")
        bodies = spool(bodies, "transfer")
        if not bodies.where("data IS NULL").union(bodies.where(F.sha2("data", 256) != F.col("digest"))).isEmpty():
            raise ValueError("a payload of the source is damaged")
        links = s.read("links").join(reached.select(F.col("ns").alias("sns"), F.col("id").alias("sid")), ["sns", "sid"], "left_semi").select("sns", "sid", "dns", "did")
        entries = s.read("entries").join(new.where("ns = 'directory.v1'").select(F.col("id").alias("dir")), "dir", "left_semi").select(*s.read("entries").columns)
        self.publish(new.select("ns", "id", "payload", "size"), links, bodies.select("digest", "size", "data"), roots, entries)
        return counts

    def transfer_path(self, source: Repository, directory: str, path: str, root: str) -> dict[str, int]:
        """Copy what a path below a directory of another repository names, and only that, and set a root on it here.

        The directories on the way are not copied: their listings prove where the path leads.
        """
        proof = source.path_proof(directory, path)
        last = next(e for e in proof[-1]["entries"] if e["name"] == proof[-1]["name"]) if proof else source.getattr(directory, "")
        ns = "directory.v1" if last["kind"] == "directory" else "blob.v1"
        if last["kind"] == "symlink":
            raise ValueError(f"{path} is a symbolic link")
        return self.transfer(source, roots=self.spark.createDataFrame([(root, ns, last["child"], False, 0)], TABLES["roots"]))

    def export(self, path: str, names: list[str] | None = None) -> None:
        """A closure-complete bundle of roots."""
        v = self.version()
        roots = v.read("roots") if names is None else v.read("roots").where(F.col("name").isin(names))
        own = v.read("objects").join(closure(roots, v.read("links")).select(*KEY), KEY, "left_semi")
        write_bundle(own.select(*KEY, F.col("payload").alias("digest"), "size"), self.bodies(v).join(own.select(F.col("payload").alias("digest")), "digest", "left_semi"), roots, path)
        key = own.select(F.col("ns").alias("sns"), F.col("id").alias("sid"))
        v.read("links").join(key, ["sns", "sid"], "left_semi").write.parquet(f"{path}/links")
        v.read("entries").join(own.select(F.col("id").alias("dir")), "dir", "left_semi").write.parquet(f"{path}/entries")

    def import_bundle(self, path: str) -> Version:
        records, payloads, roots = read_bundle(self.spark, path)
        links, entries = self.spark.read.parquet(f"{path}/links"), self.spark.read.parquet(f"{path}/entries")
        return self.publish(records.select(*KEY, F.col("digest").alias("payload"), "size"), links.select("sns", "sid", "dns", "did"), payloads, roots, entries.select(*[c.split()[0] for c in TABLES["entries"].split(", ")]))
