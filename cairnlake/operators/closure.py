"""Transitive closure over links by a frontier loop, one join per level.

Paths are never enumerated: a level's frontier is distinct and without what was visited, so
shared subgraphs are expanded once. All levels are one written table, which a level is anti-joined with once.

Graphs deeper than ``PLAIN_LEVELS`` are contracted: stretches of nodes with one link in and one out become one weighted
link, found by doubling, so that a chain of any length costs rounds that grow with its logarithm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.plans.spool import spool, spool_dir

KEY = ["ns", "id"]
#: Levels that are walked one by one before what is left is contracted.
PLAIN_LEVELS = 16


def closure(seeds: DataFrame, links: DataFrame, *, stop: DataFrame | None = None, max_nodes: int | None = None, max_level: int | None = None) -> DataFrame:
    """(ns, id, level) of all that ``seeds`` (ns, id) reach over ``links`` (sns, sid, dns, did).

    ``level`` is the least distance. Nodes of ``stop`` are reached and not expanded. More than
    ``max_nodes`` nodes are an error.
    """
    spark, base = seeds.sparkSession, f"{spool_dir(seeds.sparkSession)}/closure-{uuid.uuid4().hex}"
    paths: list[str] = []
    schema = None

    def add(rows: DataFrame) -> DataFrame:
        """Append a level to the visited table."""
        nonlocal schema
        paths.append(f"{base}/{len(paths)}")
        rows.write.parquet(paths[-1])
        schema = schema or rows.schema
        return spark.read.schema(schema).parquet(paths[-1])

    visited = lambda: spark.read.schema(schema).parquet(*paths)
    frontier = add(seeds.select(*KEY).distinct().withColumn("level", F.lit(0).cast("long")))
    count = level = 0
    while True:
        count += (n := frontier.count())
        if max_nodes is not None and count > max_nodes:
            raise ValueError(f"closure has more than {max_nodes} nodes")
        if not n or (max_level is not None and level >= max_level):
            break
        level += 1
        if level > PLAIN_LEVELS:
            deep = _deep(frontier, visited(), links, stop)
            if max_level is not None:
                deep = deep.where(F.col("level") <= max_level)
            deep = add(deep)
            if max_nodes is not None and count + deep.count() > max_nodes:
                raise ValueError(f"closure has more than {max_nodes} nodes")
            break
        grow = frontier if stop is None else frontier.join(stop.select(*KEY), KEY, "left_anti")
        met = grow.join(links, (grow["ns"] == links["sns"]) & (grow["id"] == links["sid"])).select(F.col("dns").alias("ns"), F.col("did").alias("id")).distinct()
        frontier = add(met.join(visited().select(*KEY), KEY, "left_anti").withColumn("level", F.lit(level).cast("long")))
    return visited()


def _leads(step: DataFrame, inner: DataFrame) -> DataFrame:
    """(node, to, d): where steps (node, to) lead that go on from every node of ``inner`` (node), and how far that is; endless ones are left out."""
    at = spool(step.withColumn("d", F.lit(1).cast("long")), "chain")
    most = max(1, at.count()).bit_length() + 1
    for _ in range(most):
        if at.join(inner.select(F.col("node").alias("to")), "to", "left_semi").isEmpty():
            break
        on = at.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        at = spool(at.join(on, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")), "chain")
    return at.join(inner.select(F.col("node").alias("to")), "to", "left_anti")


def _deep(frontier: DataFrame, visited: DataFrame, links: DataFrame, stop: DataFrame | None) -> DataFrame:
    """(ns, id, level) of what the frontier reaches beyond ``visited``, over chains contracted to weighted links."""
    key = lambda a, b, c: F.struct(F.col(a).alias("ns"), F.col(b).alias("id")).alias(c)
    out = links if stop is None else links.join(stop.select(F.col("ns").alias("sns"), F.col("id").alias("sid")), ["sns", "sid"], "left_anti")
    out = out.join(visited.select(F.col("ns").alias("dns"), F.col("id").alias("did")), ["dns", "did"], "left_anti")
    edges = spool(out.select(key("sns", "sid", "a"), key("dns", "did", "b")).distinct(), "deep-links")
    start = frontier.select(key("ns", "id", "node"), "level")
    one = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = spool(one("a").join(one("b"), "node").join(start, "node", "left_anti"), "deep-inner")
    ends = _leads(edges.join(inner.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("to")), inner)
    heads = spool(_leads(edges.join(inner.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("to")), inner), "deep-heads")
    hubs = edges.join(inner.select(F.col("node").alias("a")), "a", "left_anti").join(ends.select(F.col("node").alias("b"), "to", "d"), "b", "left")
    hubs = spool(hubs.select("a", F.coalesce("to", "b").alias("b"), (F.coalesce("d", F.lit(0)) + 1).alias("w")), "deep-hubs")
    best = spool(start, "deep-best")
    fresh = best
    while not fresh.isEmpty():
        met = fresh.join(hubs, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.col("level") + F.col("w")).alias("level"))
        known = best.select("node", F.col("level").alias("_known"))
        fresh = spool(met.join(known, "node", "left").where("_known IS NULL OR level < _known").select("node", "level"), "deep-fresh")
        best = spool(best.union(fresh).groupBy("node").agg(F.min("level").alias("level")), "deep-best")
    between = heads.join(best.withColumnRenamed("node", "to"), "to").select("node", (F.col("level") + F.col("d")).alias("level"))
    found = best.join(start.select("node"), "node", "left_anti").unionByName(between)
    return found.select("node.ns", "node.id", "level")


def missing(reached: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links from reached objects to keys that no object has, with the level of their source."""
    there = reached.join(objects.select(*KEY), KEY, "left_semi")
    out = there.join(links, (F.col("ns") == F.col("sns")) & (F.col("id") == F.col("sid"))).select("level", "sns", "sid", "dns", "did")
    return out.join(objects.select(F.col("ns").alias("dns"), F.col("id").alias("did")), ["dns", "did"], "left_anti")


def first_missing(reached: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """The failure that a breadth-first walk would meet first: least level, then source, then target."""
    order = ["level", "sns", "sid", "dns", "did"]
    return missing(reached, links, objects).orderBy(*order).limit(1).select(*order)


def available(seeds: DataFrame, links: DataFrame, gone: DataFrame, **options) -> DataFrame:
    """The closure over what is available: nodes of ``gone`` are neither reached nor walked through."""
    away = gone.select(*KEY)
    open_ = links.join(away.select(F.col("ns").alias("dns"), F.col("id").alias("did")), ["dns", "did"], "left_anti")
    return closure(seeds.join(away, KEY, "left_anti"), open_, **options)


def first_sources(links: DataFrame) -> DataFrame:
    """(dns, did, sns, sid): of each target the least key that links to it, by partial aggregation."""
    least = links.groupBy("dns", "did").agg(F.min(F.struct("sns", "sid")).alias("x"))
    return least.select("dns", "did", "x.*")


def proof_frontier(seeds: DataFrame, links: DataFrame, proven: DataFrame) -> DataFrame:
    """(ns, id, level, proven) of a walk that ends at nodes whose closures are proven already."""
    reached = closure(seeds, links, stop=proven)
    return reached.join(proven.select(*KEY).distinct().withColumn("proven", F.lit(True)), KEY, "left").select(*KEY, "level", F.coalesce("proven", F.lit(False)).alias("proven"))
