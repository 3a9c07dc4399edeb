"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import html, langid, licenses, linedup, merkle, mixing, neardup, packing, pii, quality, sql
from cairnlake.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    side = F.crc32(F.col("doc_id").cast("string")) % 5  # null for a null id, which is neither held out nor learned from
    held_out = F.coalesce(side == 0, F.lit(False))
    found = langid.identify(docs, langid.train(docs, side != 0))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), lambda k: 1 + k % 3)


def mixing_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that belong to two sources each, their own and one for their language, so that the flow must choose."""
    both = F.array("source", F.concat(F.lit("lang "), F.coalesce("lang", F.lit("none"))))
    return mixing.mix(table(spark, sf_dir, "documents"), lambda k: 1 + k % 3, members=both)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.dedup(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("repeated", lambda x: F.concat_ws(":", x["line_no"], x["class_doc"], x["class_line"])), ",")
    return found.select("row.doc_id", "text", "n_lines", "n_removed", "n_links", said.alias("repeated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith(("op", "mixing_")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle": sql.MERKLE, "op6_neardup": sql.NEAR_DUPLICATES, "op10_linedup": sql.LINES}
