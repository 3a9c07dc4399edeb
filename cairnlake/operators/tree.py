"""Paths, directory trees and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.plans.spool import spool


def parts(path: Column) -> Column:
    """Non-empty components of a slash-separated path."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parents(components: Column) -> Column:
    """All proper prefixes of an array of components, the empty one (the root) included; none of an empty path."""
    n = F.size(components)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(components, 1, i))).otherwise(F.array())


def rollup(entries: DataFrame, path: str = "path") -> DataFrame:
    """(dir, n_entries, n_bytes): what each directory holds in all depths, counting directories as entries.

    ``entries`` are files (path, size), by distinct path. Each is sent to all its ancestors once; their number is its depth.
    """
    files = entries.select(parts(F.col(path)).alias("p"), "size")
    up = files.select(F.explode(parents(F.col("p"))).alias("dir"), F.col("size"), F.lit(1).alias("n"))
    dirs = files.select(F.explode(parents(F.col("p"))).alias("p")).where(F.size("p") > 0).distinct()
    up_dirs = dirs.select(F.explode(parents(F.col("p"))).alias("dir"), F.lit(0).alias("size"), F.lit(1).alias("n"))
    got = up.unionByName(up_dirs).groupBy("dir").agg(F.sum("n").cast("long").alias("n_entries"), F.sum("size").cast("long").alias("n_bytes"))
    return got.select(F.array_join("dir", "/").alias("dir"), "n_entries", "n_bytes")


def conflicts(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind): paths given twice, and files that others use as a directory."""
    p = paths.select(F.array_join(parts(F.col(path)), "/").alias("path"))
    twice = p.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate").alias("kind"))
    above = p.select(F.explode(parents(F.split("path", "/"))).alias("d")).where(F.size("d") > 0).select(F.array_join("d", "/").alias("path")).distinct()
    return twice.union(p.distinct().join(above, "path", "left_semi").select("path", F.lit("file as directory").alias("kind")))


def resolve(wanted: DataFrame, entries: DataFrame, depth: int | None = None) -> DataFrame:
    """Walk paths (path_id, components) from entries (dir, name, child) of the root "": one join per component.

    (path_id, child, steps): the node reached, null if a component is missing, and the components resolved. ``depth``: components that are
    walked, all by default; a longer path has no child.
    """
    if depth is None:
        depth = wanted.agg(F.max(F.size("components"))).first()[0] or 0
    at = wanted.withColumn("node", F.lit("")).withColumn("steps", F.lit(0).cast("long"))
    e = entries.select(F.col("dir").alias("_dir"), F.col("name").alias("_name"), "child")
    for k in range(depth):
        name = F.get("components", k)
        at = at.withColumn("_want", F.when(F.col("node").isNotNull(), name))
        at = at.join(e, (F.col("node") == F.col("_dir")) & (F.col("_want") == F.col("_name")), "left")
        done = F.size("components") <= k
        at = at.withColumn("node", F.when(done, F.col("node")).otherwise(F.col("child"))).withColumn("steps", F.col("steps") + (~done & F.col("child").isNotNull()).cast("long")).select("path_id", "components", "node", "steps")
    return at.select("path_id", F.when(F.size("components") <= depth, F.col("node")).alias("child"), "steps")


def merge_layers(entries: DataFrame, whiteouts: DataFrame) -> DataFrame:
    """The visible entry of each path: the highest layer's that no higher whiteout hides.

    ``entries`` (layer, path, value, is_dir), ``whiteouts`` (layer, path, opaque): a whiteout hides its path
    and all under it in lower layers, an opaque one only what is under it. A higher entry that is no
    directory hides the lower subtree. Each entry looks up its own ancestors, so that
    hiding is an equi-join.
    """
    hides = whiteouts.select(F.col("path").alias("at"), F.col("layer").alias("by"), F.col("opaque").alias("inside"))
    hides = hides.union(entries.where("NOT is_dir").select("path", "layer", F.lit(True)))
    hides = hides.groupBy("at", "inside").agg(F.max("by").alias("by"))
    c = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array_join(F.slice(c, 1, i), "/"))
    asked = entries.select("layer", "path", F.explode(chain).alias("at"))
    hidden = asked.join(hides, "at").where((F.col("by") > F.col("layer")) & (~F.col("inside") | (F.col("at") != F.col("path")))).select("layer", "path").distinct()
    left = entries.join(hidden, ["layer", "path"], "left_anti")
    return left.groupBy("path").agg(F.max_by(F.struct("value", "is_dir", "layer"), F.col("layer")).alias("x")).select("path", "x.value", "x.layer")


def git_order(name: Column, is_dir: Column) -> Column:
    """Sort key of tree entries: bytes of the name, directories as if they ended in a slash."""
    return F.concat(name, F.when(is_dir, F.lit("/")).otherwise(F.lit("\0"))).cast("binary")


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def follow_refs(refs: DataFrame, hops: int) -> DataFrame:
    """(name, target, hops): where symbolic references (name, to) end within ``hops`` steps; a null ``to`` is an end.

    What has not ended by then, as in a cycle, has no target; a reference to what does not exist ends there. Each round doubles the
    length of the jumps, so that the joins grow with the logarithm of ``hops``.
    """
    jump = refs.select("name", F.coalesce("to", "name").alias("target"), F.col("to").isNotNull().cast("long").alias("n"))
    at = refs.select("name", F.col("name").alias("target"), F.lit(0).cast("long").alias("hops"))
    left = hops
    while left:
        step = jump.select(F.col("name").alias("target"), F.col("target").alias("_to"), F.col("n").alias("_n"))
        if left & 1:
            at = at.join(step, "target", "left").select("name", F.coalesce("_to", "target").alias("target"), (F.col("hops") + F.coalesce("_n", F.lit(0))).alias("hops"))
        left >>= 1
        if left:
            jump = jump.join(step, "target", "left").select("name", F.coalesce("_to", "target").alias("target"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
    open_ = refs.where("to IS NOT NULL").select(F.col("name").alias("target"), F.lit(True).alias("_open"))
    ended = F.col("_open").isNull()
    return at.join(open_, "target", "left").select("name", F.when(ended, F.col("target")).alias("target"), F.when(ended, F.col("hops")).alias("hops"))


def directory_digests(files: DataFrame) -> DataFrame:
    """(path, n_entries, digest) of each directory, the root as "": from the deepest level up, each level written once.

    A directory's digest is the SHA-256 of its entries' kinds, names, digests and sizes, in order of names.
    Entries of one directory are gathered in one row, as its encoding demands: a directory must fit a task's memory.
    """
    up = lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))
    files = spool(files.select("path", "kind", "digest", "size", F.size(F.split("path", "/")).alias("depth")), "tree-files")
    deepest = files.agg(F.max("depth")).first()[0] or 0
    out = below = None
    for d in range(deepest, 0, -1):
        own = files.where(F.col("depth") == d)
        own = own if below is None else own.unionByName(below)
        entry = F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "kind", "digest", "size")
        dirs = own.groupBy(up(F.col("path")).alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        text = F.array_join(F.transform("e", lambda x: F.concat_ws("\0", x["kind"], x["name"], x["digest"], x["size"])), "\n")
        dirs = spool(dirs.select("path", F.size("e").cast("long").alias("n_entries"), F.sha2(text, 256).alias("digest"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + 1 + F.when(x["kind"] == "directory", x["size"]).otherwise(0)).alias("size")), "tree-level")
        below = dirs.where("path <> ''").select("path", F.lit("directory").alias("kind"), "digest", "size", F.lit(d - 1).alias("depth"))
        done = dirs.select("path", "n_entries", "digest")
        out = done if out is None else out.union(done)
    return out if out is not None else files.sparkSession.createDataFrame([], "path string, n_entries long, digest string")
