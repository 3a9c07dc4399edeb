"""Application records: a key-value table of namespaces, an appended log of changes in a versioned store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.operators import kv
from cairnlake.plans.versioned import MAX_BATCH_BYTES, MAX_CHANGES, MAX_KEY_BYTES, MAX_VALUE_BYTES, Conflict, Store, Version

SCHEMA = "namespace string, key binary, value binary, generation long, removed boolean"
_LOG = {"keys": ["namespace", "key"], "order": "generation", "removed": "removed"}


@dataclass
class Batch:
    """Checks and changes to be committed together, in the caller's order; bounded by the limits of a batch."""

    checks: list[tuple[str, bytes, bytes | None]] = field(default_factory=list)
    changes: dict[tuple[str, bytes], bytes | None] = field(default_factory=dict)
    _bytes: int = 0

    def _add(self, namespace: str, key: bytes, value: bytes | None) -> None:
        if not namespace or len(key) > MAX_KEY_BYTES or len(value or b"") > MAX_VALUE_BYTES:
            raise ValueError("a namespace is empty, or a key or value too long")
        self._bytes += len(key) + len(value or b"")
        if self._bytes > MAX_BATCH_BYTES or len(self.checks) >= MAX_CHANGES or len(self.changes) >= MAX_CHANGES:
            raise ValueError("the batch is too large")

    def expect(self, namespace: str, key: bytes, value: bytes | None) -> Batch:
        """The commit holds only if the key has this value now; None: is absent."""
        self._add(namespace, key, value)
        self.checks.append((namespace, key, value))
        return self

    def set(self, namespace: str, key: bytes, value: bytes | None) -> Batch:
        """Set a key, or remove it with None. A key may be given once."""
        if (namespace, key) in self.changes:
            raise ValueError("a key is given twice")
        self._add(namespace, key, value)
        self.changes[namespace, key] = value
        return self


class Records:
    """Records of a store. A commit appends its changes only; reading takes the newest change of each key."""

    def __init__(self, store: Store, table: str = "records") -> None:
        self.store, self.table, self.spark = store, table, store.spark
        if (v := store.version()) is None or table not in v.tables:
            store.commit(v, {table: self.spark.createDataFrame([], SCHEMA)}, logs={table: _LOG})

    def all(self, version: Version | None = None) -> DataFrame:
        return (version or self.store.version()).read(self.table).select("namespace", "key", "value")

    def get(self, wanted: list[tuple[str, bytes]], version: Version | None = None) -> list[bytes | None]:
        """Values in the order asked, misses and repeats included; MAX_KEYS keys at most."""
        if len(wanted) > kv.MAX_KEYS or any(len(k) > MAX_KEY_BYTES for _, k in wanted):
            raise ValueError("too many keys, or one too long")
        asked = self.spark.createDataFrame([(i, n, bytearray(k)) for i, (n, k) in enumerate(wanted)], "ordinal int, namespace string, key binary")
        log = (version or self.store.version()).read(self.table).join(F.broadcast(asked.select("namespace", "key").distinct()), ["namespace", "key"], "left_semi")
        got = {r["ordinal"]: r["value"] for r in asked.join(log, ["namespace", "key"], "left").collect()}
        return [None if got[i] is None else bytes(got[i]) for i in range(len(wanted))]

    def scan(self, namespace: str, prefix: bytes = b"", *, after: bytes | None = None, limit: int = kv.MAX_PAGE, most: int = MAX_BATCH_BYTES, version: Version | None = None) -> tuple[list[tuple[bytes, bytes]], bytes | None]:
        """A page of (key, value) under a raw prefix, and the cursor of the next one; None after the last."""
        rows = self.all(version).where((F.col("namespace") == namespace) & kv.raw_prefix(F.col("key"), prefix, after))
        page = [(bytes(r["key"]), bytes(r["value"])) for r in kv.page_bytes(rows, "key", F.octet_length("key") + F.octet_length("value"), limit, most).collect()]
        page.sort()
        more = bool(page) and not rows.where(F.col("key") > F.lit(page[-1][0])).isEmpty()
        return page, page[-1][0] if more else None

    def commit(self, batch: Batch, base: Version | None = None) -> Version:
        """Append a batch's changes if all its checks hold; else ``Conflict`` with the first that does not."""
        base = base or self.store.version()
        now = self.get([(n, k) for n, k, _ in batch.checks], base) if batch.checks else []
        for i, ((_, _, want), have) in enumerate(zip(batch.checks, now, strict=True)):
            if want != have:
                raise Conflict(i)
        rows = [(n, bytearray(k), None if v is None else bytearray(v), base.generation + 1, v is None) for (n, k), v in batch.changes.items()]
        return self.store.commit(base, append={self.table: self.spark.createDataFrame(rows, SCHEMA)})
