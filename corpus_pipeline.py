"""A corpus from documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import linedup, mixing, neardup, packing, quality
from cairnlake.llm.common import broadcast_if_small, n_words, spool, table

#: Documents of this similarity are near-duplicates in the pipeline, in per cent; op6 has its own threshold.
NEAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others have first, whatever their share; those that only consisted of such lines go.

    Near copies of the document that has a line first keep it, so that they reach near-dedup whole.
    """
    found = linedup.dedup(docs, copies_percent=NEAR_PERCENT, details=False)
    changed = F.col("n_removed") > 0
    own = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return found.where(~(changed & (n_words(F.col("text")) == 0))).select(*(own.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    gone = spool(neardup.near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept").select("doc_id").distinct(), "pipeline-gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole; each row by its own count, whether its id is repeated or null."""
    taken = mixing.mix(docs, lambda k: 1 + k % 3, whole_only=True, carry=docs.columns).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.expr("int(taken DIV size)")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted sequence lengths."""
    return packing.pack_documents(docs)


STAGES = [("quality", good), ("line_dedup", without_repeated_lines), ("near_dedup", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the boosted trees, the edit join's classes, the flow or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the corpus made from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spool(docs, f"pipeline-{name}")
    return docs
