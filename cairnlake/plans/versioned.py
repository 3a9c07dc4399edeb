"""A versioned table set with optimistic commits.

Each version is a manifest with its generation, a fresh random revision and the Parquet folders of each table. A commit
writes new folders, appended to those of the version it was made from or instead of them, then writes its manifest beside its place and
claims the next version number by moving it there, which only one writer can; the loser gets ``StaleRevision`` and changes nothing. A
writer lost on the way leaves files that no version names, which ``sweep`` deletes, and blocks nobody. Readers hold on to
one version, so that theirs never changes.

The move must fail where the target exists. It is a hard link on local and mounted file systems, and a rename without overwriting on
HDFS and its like, which does both at once. Plain object stores do not: there, only one writer may commit at a time.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of a batch.
MAX_CHANGES, MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_BATCH_BYTES = 4096, 4096, 1 << 20, 16 << 20
#: Folders of a table from which it is written anew as one.
MAX_PARTS = 32


class StaleRevision(Exception):
    """Another commit came first."""


class Conflict(Exception):
    """A check of the commit does not hold; ``check`` is the first that fails, in the caller's order."""

    def __init__(self, check: int) -> None:
        super().__init__(f"check {check} does not hold")
        self.check = check


@dataclass(frozen=True)
class Version:
    """One immutable state."""

    store: Store
    number: int
    generation: int
    revision: str
    tables: dict[str, list[str]]
    logs: dict[str, dict]

    def read(self, name: str) -> DataFrame:
        """A table; of a log of changes the state that it stands for."""
        rows = self.store.spark.read.parquet(*self.tables[name])
        if name not in self.logs:
            return rows
        log = self.logs[name]
        return newest(rows, log["keys"], log["order"]).where(~F.col(log["removed"]))


class Store:
    """Versions of named tables under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._path = self._hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json") and s.getLen() > 0)

    def version(self, number: int | None = None) -> Version | None:
        """A version, the newest by default; None before the first commit."""
        known = self.numbers()
        if not known:
            return None
        n = known[-1] if number is None else number
        stream = self._fs.open(self._path(self._marker(n)))
        try:
            got = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(self, n, got["generation"], got["revision"], got["tables"], got["logs"])

    def _claim(self, number: int, body: bytes) -> None:
        """Put a whole manifest in place, if none stands there."""
        draft, marker = f"{self.path}/versions/draft-{uuid.uuid4().hex}", self._marker(number)
        out = self._fs.create(self._path(draft), False)
        try:
            out.write(body)
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                plain = lambda p: self._path(p).toUri().getPath()
                os.link(plain(draft), plain(marker))
            else:
                context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                gateway = self.spark.sparkContext._gateway
                how = gateway.new_array(getattr(self._hadoop.fs, "Options$Rename"), 1)
                how[0] = getattr(self._hadoop.fs, "Options$Rename").NONE
                context.rename(self._path(draft), self._path(marker), how)
        except Exception as e:
            if isinstance(e, FileExistsError) or "FileAlreadyExists" in str(e):
                raise StaleRevision from e
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    def commit(self, base: Version | None, tables: dict[str, DataFrame] | None = None, *, append: dict[str, DataFrame] | None = None, logs: dict[str, dict] | None = None) -> Version:
        """Publish tables instead of those of ``base``, and rows to be added to others; all else is shared with it.

        ``logs``: tables that are logs of changes, each with its ``keys``, ``order`` and ``removed``: newest wins when they are read.
        """
        newest = self.version()
        if (newest and newest.revision) != (base and base.revision):
            raise StaleRevision
        number, revision = (base.number + 1 if base else 1), os.urandom(32).hex()
        parts = {k: list(v) for k, v in base.tables.items()} if base else {}
        kinds = (base.logs if base else {}) | (logs or {})

        def write(name: str, df: DataFrame) -> str:
            at = f"{self.path}/data/{name}-{revision}"
            df.write.parquet(at)
            return at

        for name, df in (tables or {}).items():
            parts[name] = [write(name, df)]
        for name, df in (append or {}).items():
            if len(parts.get(name, [])) >= MAX_PARTS:
                old = self.spark.read.parquet(*parts[name])
                every = old.unionByName(df.select(*old.columns))
                parts[name] = [write(name, newest(every, kinds[name]["keys"], kinds[name]["order"]) if name in kinds else every)]
            else:
                parts.setdefault(name, []).append(write(name, df))
        body = json.dumps({"generation": (base.generation if base else 0) + 1, "revision": revision, "tables": parts, "logs": kinds}).encode()
        self._claim(number, body)
        return self.version(number)

    def vacuum(self, keep: set[int]) -> int:
        """Delete versions that are neither ``keep`` nor the newest, and the folders that only they have; returns how many."""
        known = self.numbers()
        keep = keep | set(known[-1:])
        live = {p for n in known if n in keep for parts in self.version(n).tables.values() for p in parts}
        dropped = [n for n in known if n not in keep]
        for n in dropped:
            for p in {p for parts in self.version(n).tables.values() for p in parts} - live:
                self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(self._marker(n)), False)
        return len(dropped)

    def sweep(self, seconds: float = 86_400) -> int:
        """Delete what lost writers left: folders and drafts that no version names, untouched for so long; returns how many."""
        named = {p.rsplit("/", 1)[1] for n in self.numbers() for parts in self.version(n).tables.values() for p in parts}
        old = (time.time() - seconds) * 1000
        gone = 0
        for folder, is_left in (("data", lambda x: x not in named), ("versions", lambda x: x.startswith("draft-"))):
            at = self._path(f"{self.path}/{folder}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if is_left(s.getPath().getName()) and s.getModificationTime() <= old:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], removed: Column | None = None) -> DataFrame:
    """``current`` with changed keys replaced; those that are ``removed`` go."""
    left = current.join(changes.select(*keys), keys, "left_anti")
    new = changes if removed is None else changes.where(~removed)
    return left.unionByName(new.select(*current.columns))


def newest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key of an appended log of changes the newest row, removals included. By partial aggregation, no window."""
    body = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*body), F.col(order)).alias("_x")).select(*keys, "_x.*").select(*log.columns)


def commit_if(store: Store, base: Version, table: str, keys: list[str], checks: DataFrame, changes: DataFrame, removed: Column | None = None) -> Version:
    """Apply changes if every check (ordinal, *keys, expected) meets the value of its key (null: absent); else ``Conflict``.

    A key given twice, or a batch beyond the limits, is an error before anything is read.
    """
    given = changes.select(*keys).groupBy(*keys).count().agg(F.count("*").alias("n"), F.max("count").alias("m")).first()
    if (given["m"] or 0) > 1:
        raise ValueError("a key is given twice")
    if given["n"] > MAX_CHANGES or checks.count() > MAX_CHANGES:
        raise ValueError(f"more than {MAX_CHANGES} changes")
    now = base.read(table)
    failed = checks.join(now.select(*keys, F.col("value").alias("_now")), keys, "left").where(~F.col("expected").eqNullSafe(F.col("_now"))).agg(F.min("ordinal")).first()[0]
    if failed is not None:
        raise Conflict(failed)
    return store.commit(base, {table: upsert(now, changes, keys, removed)})


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str], generation: int) -> DataFrame:
    """Immutable records: equal ones are not inserted again, different ones under a known key are an error."""
    return current.unionByName(new_rows(current, rows, keys).withColumn("generation", F.lit(generation).cast("long")).select(*current.columns))


def new_rows(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of immutable ``rows`` whose keys ``current`` lacks; a different row under a known key is an error."""
    body = [c for c in current.columns if c in rows.columns and c not in (*keys, "generation")]
    same = F.lit(True)
    for c in body:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    if not rows.alias("a").join(current.alias("b"), keys).where(~same).isEmpty():
        raise ValueError("a different record is stored under a key")
    return rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
