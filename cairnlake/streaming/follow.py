"""Incremental synchronization: a stream of new rows appended to a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cairnlake.plans.versioned import Store


def follow(spark: SparkSession, source: str, schema: StructType, store: Store, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append files that arrive under ``source`` to ``table`` of ``store``, a log of changes: newest by ``order`` wins, rows with ``removed`` go.

    Each micro-batch is one commit of its own newest rows that records its number, so that a batch that is run again after
    a failure changes nothing. What is stored already is not read or written again; the log is written anew once it has many parts.
    """

    def merge(batch: DataFrame, number: int) -> None:
        base = store.version()
        if base is not None and "progress" in base.tables and base.read("progress").first()["batch"] >= number:
            return
        columns = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select(*keys, "x.*")
        store.commit(base, {"progress": spark.createDataFrame([(number,)], "batch long")}, append={table: newest}, logs={table: {"keys": keys, "order": order, "removed": "removed"}})

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
