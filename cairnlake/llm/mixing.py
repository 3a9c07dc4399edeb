"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by the set of sources they belong to. A flow routes the words of
each pattern to the quotas of its sources; a pattern's words may be used up to
``MAX_EPOCHS`` times, each time at a higher cost, so that repeats are spread thin. The
flow fixes how many words each pattern gives: whole epochs of all its documents, and one
more of those first in the order of a seeded hash.

Only sums by pattern and by part of the hash range reach the driver or one task: first by 1/4096 of the range, then by 1/4096 of the part in
which a pattern's remainder ends. The exact order is needed only inside the one of these parts in which it ends.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source
of its own, last in order; repeated rows count each; very long texts are counted whole; ties of the hash are ordered by id
and size; more than ``MAX_PATTERNS`` different sets of sources are an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import n_words, spool

MAX_EPOCHS = 3
SEED = 20_24
BUCKET_BITS = 12
#: The driver solves the flow over at most so many patterns, and is sent a row for each.
MAX_PATTERNS = 100_000


def targets(sizes: dict[str | None, int], total: float, weight: Callable[[int], float], most: float = MAX_EPOCHS) -> dict[str | None, float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weight(k) for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        left = total - sum(out.values())
        all_w = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / all_w > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / all_w for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int], epochs: int = MAX_EPOCHS) -> list[int]:
    """Words each pattern gives so that quotas are met at least cost.

    The cost of a pattern's k-th epoch grows with k and is the same for all patterns, so
    the optimum fills epoch by epoch: shortest paths never undo a cheaper epoch.
    Each epoch is a maximum flow by shortest augmenting paths on the residual graph.
    """
    taken = [0] * len(patterns)
    left = dict(quotas)
    flow: list[dict] = [dict.fromkeys(members, 0) for members, _ in patterns]
    users: dict = {}
    for p, (members, _) in enumerate(patterns):
        for s in members:
            users.setdefault(s, []).append(p)
    for _ in range(epochs):
        free = [size for _, size in patterns]
        for p, (members, _) in enumerate(patterns):  # direct paths first
            for s in members:
                x = min(free[p], left[s])
                flow[p][s] += x
                free[p] -= x
                left[s] -= x
                taken[p] += x
        for p in range(len(patterns)):
            while free[p] and (path := _augment(p, patterns, users, flow, left)):
                x = min([free[p], left[path[-1]], *(flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2))])
                for k in range(0, len(path) - 1, 2):
                    flow[path[k]][path[k + 1]] += x
                    if k + 2 < len(path):
                        flow[path[k + 2]][path[k + 1]] -= x
                free[p] -= x
                left[path[-1]] -= x
                taken[p] += x
    return taken


def _augment(p: int, patterns, users, flow, left) -> list | None:
    """The shortest path pattern, source, pattern, source ... to a source that wants more."""
    came: dict = {("p", p): None}
    queue = deque([("p", p)])
    while queue:
        kind, at = node = queue.popleft()
        if kind == "s" and left[at]:
            path = []
            while node:
                path.append(node[1])
                node = came[node]
            return path[::-1]
        nexts = (("s", s) for s in patterns[at][0]) if kind == "p" else (("p", q) for q in users[at] if flow[q][at])
        for x in nexts:
            if x not in came:
                came[x] = node
                queue.append(x)
    return None


def mix(docs: DataFrame, weight: Callable[[int], float], *, members: Column | None = None, size: Column | None = None, epochs: int = MAX_EPOCHS, seed: int = SEED, whole_only: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """A row for each document: its size, its pattern's size and summed targets, and the words the mix takes.

    ``members``: array of the sources a document belongs to; its ``source`` by default. The document in
    which a pattern's remainder ends is taken in part, so that quotas are met exactly; with
    ``whole_only`` it is taken if that comes nearer. Columns named by ``carry`` come along in a struct ``row``, so
    that rows of one id, or of none, each keep their own words.
    """
    spark = docs.sparkSession
    members = F.array("source") if members is None else members
    size = n_words(F.col("text")) if size is None else size
    along = ["row"] if carry else []
    slim = docs.select("doc_id", F.array_sort(F.array_distinct(members)).alias("members"), size.cast("long").alias("size"), *([F.struct(*carry).alias("row")] if carry else []))
    slim = slim.select("doc_id", "size", "members", *along, F.to_json("members", {"ignoreNullFields": "false"}).alias("pattern"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    part = lambda level: F.shiftrightunsigned("h", 64 - level * BUCKET_BITS).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    slim = spool(slim.withColumn("bucket", part(1)).withColumn("inner", part(2)), "mix")
    buckets = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("members").alias("members"))
    rows = buckets.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows.sort(key=lambda r: r["pattern"])
    sizes: dict[str | None, int] = {}
    for r in rows:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    want = targets(sizes, sum(r["words"] for r in rows), weight, epochs)
    given = route([(tuple(r["members"]), r["words"]) for r in rows], {s: round(t) for s, t in want.items()}, epochs)
    plan = []
    for r, f in zip(rows, given, strict=True):
        whole, rest = divmod(f, r["words"]) if r["words"] else (0, 0)
        plan.append((r["pattern"], sum(sizes[s] for s in r["members"]), float(sum(want[s] for s in r["members"])), whole, rest))
    schema = "pattern string, source_size long, target double, whole long, rest long"
    plans = spark.createDataFrame(plan, schema)
    upto = lambda at: F.sum("words").over(Window.partitionBy("pattern").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))

    def ends(parts: DataFrame, at: str) -> dict[str, tuple[int, int]]:
        """The part of each pattern in which its remainder ends, and how much of the remainder is left there."""
        found = parts.withColumn("upto", upto(at)).where("upto - words < rest AND rest <= upto")
        return {r["pattern"]: (r[at], r["rest"] - r["upto"] + r["words"]) for r in found.select("pattern", at, "rest", "upto", "words").collect()}

    cuts = ends(buckets.join(F.broadcast(plans.select("pattern", "rest")), "pattern"), "bucket")
    first = F.broadcast(spark.createDataFrame([(p, *x) for p, x in cuts.items()], "pattern string, cut int, rest long"))
    inner = slim.join(first, "pattern").where("bucket = cut").groupBy("pattern", "inner", "rest").agg(F.sum("size").alias("words"))
    inside = ends(inner, "inner")
    known = spark.createDataFrame([(*p[:4], cuts.get(p[0], (-1, 0))[0], *inside.get(p[0], (-1, 0))) for p in plan], "pattern string, source_size long, target double, whole long, cut int, inner_cut int, inside long")
    # a row for each pattern: at most MAX_PATTERNS, so it may be broadcast
    all_rows = slim.select("doc_id", "size", "pattern", "h", "bucket", "inner", *along).join(F.broadcast(known), "pattern")
    at_end = (F.col("bucket") == F.col("cut")) & (F.col("inner") == F.col("inner_cut"))
    before = (F.col("bucket") < F.col("cut")) | (F.col("bucket") == F.col("cut")) & (F.col("inner") < F.col("inner_cut"))
    plain = all_rows.where(~at_end).withColumn("extra", F.when(before, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = all_rows.where(at_end).withColumn("upto", F.sum("size").over(order))
    room = F.col("inside") - F.col("upto") + F.col("size")
    some = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole_only else F.greatest(F.lit(0), F.least(F.col("size"), room))
    at_cut = at_cut.withColumn("extra", some.cast("long")).drop("upto")
    return plain.unionByName(at_cut).select("doc_id", "size", *along, "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))
