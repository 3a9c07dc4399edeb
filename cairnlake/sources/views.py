"""The driver's tables read as an object graph, a key-value store, payloads, trees and layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OBJECTS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
_LINKS = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ns, id) of each row of the dimension tables and orders."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("ns"), F.col(c).cast("long").alias("id")) for t, c in _OBJECTS.items()]
    return reduce(DataFrame.union, parts)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sns, sid, dns, did) of each foreign key; an order also links to the parts and suppliers of its lines."""
    key = lambda t, c, d, k: table(spark, sf_dir, t).select(F.lit(t).alias("sns"), F.col(c).cast("long").alias("sid"), F.lit(d).alias("dns"), F.col(k).cast("long").alias("did"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array(F.struct(F.lit("part").alias("dns"), F.col("l_partkey").alias("did")), F.struct(F.lit("supplier").alias("dns"), F.col("l_suppkey").alias("did")))).alias("x"))
    lines = lines.select(F.lit("orders").alias("sns"), F.col("l_orderkey").cast("long").alias("sid"), "x.dns", F.col("x.did").cast("long").alias("did")).distinct()
    return reduce(DataFrame.union, [*(key(*x) for x in _LINKS), lines])


def urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots: urgent orders."""
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("orders").alias("ns"), F.col("o_orderkey").cast("long").alias("id"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, digest) of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("digest"))


def url_path(url: str = "url") -> Column:
    """Host and path of an address as one path; queries and fragments are cut."""
    return F.regexp_replace(F.regexp_replace(F.col(url), "[?#].*$", ""), "^[a-z]+://", "")
