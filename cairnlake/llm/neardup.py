"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct five-word shingles. Its sketch has ``REGISTERS``
registers, each the truncated logarithm, to a base near one, of the least of
exponentially distributed values of its shingles. Registers of a union are maxima of
registers, and two registers are equal with nearly the probability of the Jaccard
similarity. Bands of registers give candidates, the likelihood of the register
comparisons gives a joint estimate that discards the hopeless, and full sets decide.

Work is kept linear in groups of copies without losing a link between different texts:

* equal sets are one node;
* shingles that no other candidate has bound what a node, or a pair, can reach, exactly;
* in a band bucket each node meets two leaders only; where they have not joined all, pairs
  across components follow: all of them in small buckets, and in large ones those whose
  differences to a pivot overlap enough, an exact prefix filter, so that no possible link is left out.

Defined results: null and empty texts have no set, link with nothing and are kept; rows with a
null id are kept, in no component; rows of one id are one document, of which any copy of the least id is kept; very long texts are
sketched whole; a pair exactly at the threshold is a link; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import broadcast_if_small, slices, spool
from cairnlake.llm.components import components

WORDS = 5
PERCENT = 85
REGISTERS = 280
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Bands share no bucket for at most this share of the pairs at the threshold.
MISSED = 2e-7
#: In buckets of more nodes, pairs across components are found by their differences to a pivot.
FEW = 8
#: Words hashed at a time.
BLOCK_WORDS = 250_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def least_set(percent: int) -> int:
    """Sets of fewer shingles link with equal sets only: n / (n + 1) is under the threshold."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**31


def band_rows(percent: int) -> int:
    """The most registers a band can have so that pairs at the threshold are missed at most at the rate MISSED."""
    return max((r for r in range(1, REGISTERS + 1) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED), default=1)


def margin(percent: int) -> int:
    """Per cent that an estimate must be under the threshold to be discarded: six standard deviations of REGISTERS registers."""
    return int(np.ceil(6 * np.sqrt(percent * (100 - percent) / REGISTERS)))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, bytes | None]:
    """Sorted hashes of the distinct shingles of a whole text, and a digest of the set; empty and None without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64), None
    if len(found) < WORDS:
        whole = b"\x00" + b" ".join(found)
        return np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64), xxhash.xxh3_128_digest(whole)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - WORDS + 1
    s = h[:n].copy()
    for k in range(1, WORDS):
        s = s * _A + h[k : k + n]
    s = np.sort(_mix(s))
    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
    return s, xxhash.xxh3_128_digest(s.tobytes())


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set, as rows of 16-bit registers; sets must not be empty.

    Each element is a Poisson process over all registers: rising times, each dealt to one
    register. An element is done once its time is beyond the largest minimum of its sketch.
    """
    m, n = REGISTERS, len(sets)
    least = np.full(n * m, np.inf)
    state = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    time = np.zeros(len(state))
    while len(state):
        state = state + _A
        z = _mix(state)
        time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * RATE)
        at = (_mix(z ^ _C) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        np.minimum.at(least, doc * m + at.astype(np.int64), time)
        alive = time < least.reshape(n, m).max(1)[doc]
        state, doc, time = state[alive], doc[alive], time[alive]
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16).reshape(n, m)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers of each sketch."""
    bands = REGISTERS // rows
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64) + np.uint64(1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = _mix(key * _A + parts[:, :, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood for pairs of sketches of sets with known sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likely = more * log(up) + less * log(down) + equal * log(1 - up - down)
    return j[np.arange(len(j)), likely.argmax(1)]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[np.ndarray, bytes | None]]]]:
    start, block, words = 0, [], 0
    for k, t in enumerate(texts):
        block.append(shingles(t))
        words += len(block[-1][0])
        if words >= BLOCK_WORDS or len(block) >= 1024:
            yield start, block
            start, block, words = k + 1, [], 0
    if block:
        yield start, block


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands) of each document; bands only for sets that can link with others."""
    least, rows = least_set(percent), band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id").cast(pa.int64())
            for start, block in _blocks(b.column("text").to_pylist()):
                big = [k for k, (s, _) in enumerate(block) if len(s) >= least]
                keys = dict(zip(big, band_keys(registers([block[k][0] for k in big]), rows).tolist(), strict=True)) if big else {}
                own = ids.slice(start, len(block))
                hashes = [h if i is not None else None for (_, h), i in zip(block, own.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array([len(s) for s, _ in block], pa.int64()), pa.array(hashes, pa.binary()), pa.array([keys.get(k) for k in range(len(block))], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    """(node, n, shingles, regs) of candidate documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id").cast(pa.int64())
            for start, block in _blocks(b.column("text").to_pylist()):
                sets = [s for s, _ in block]
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(block)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([r.tobytes() for r in regs], pa.binary())], ["node", "n", "shingles", "regs"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, n long, shingles array<long>, regs binary")


def _possible(percent: int) -> Column:
    """Whether sets of sizes n and m, of which u and v shingles occur in no other candidate, can reach the threshold."""
    c, d = F.col("n") - F.col("u"), F.col("m") - F.col("v")
    return F.least(c, d) * 100 >= (F.greatest(c, d) + F.col("u") + F.col("v")) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    regs = sets.select("node", "n", "regs")
    side = lambda df, c: df.select(*(F.col(x).alias(c if x == "node" else f"{x}_{c}") for x in df.columns))
    both = pairs.join(side(regs, "b"), "b").join(side(regs, "a"), "a").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            r = [np.frombuffer(b"".join(x.column(f"regs_{c}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in "ab"]
            j = estimate(*r, *(x.column(f"n_{c}").to_numpy() for c in "ab"))
            yield x.select(["a", "b"]).filter(pa.array(j * 100 >= percent - margin(percent)))

    likely = both.mapInArrow(run, "a long, b long")
    full = sets.select("node", "n", "shingles")
    met = likely.join(side(full, "b"), "b").join(side(full, "a"), "a")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    return met.select("a", "b", "n_a", "n_b", shared.alias("s")).where(F.col("s") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("s")) * percent).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (p, node, n, root) of one pivot p, of different roots, that may reach the threshold, and members near p.

    Sets x and y differ as much as their differences to the pivot differ, and those are
    short. For x and y to be close, their differences must share t elements, which their lengths
    give; with elements ordered rarest first, both must have t elements from the first
    shared one on, for the largest partner already before the join. This drops no possible pair but those near the pivot on both sides, whose
    pairs with the pivot are given. Elements that no other difference has are counted, not joined.
    """
    s = sets.select("node", "shingles")
    both = members.join(s.select(F.col("node").alias("p"), F.col("shingles").alias("q")), "p").join(s, "node")
    delta = F.concat(F.array_except("shingles", "q"), F.array_except("q", "shingles"))
    both = spool(both.select("p", "node", "n", "root", F.size("q").alias("m"), delta.alias("d")).withColumn("size", F.size("d")), "near-delta")
    each = both.select("p", "node", F.explode("d").alias("e"))
    often = each.groupBy("p", "e").agg(F.count("*").alias("f")).where("f > 1")
    ranked = each.join(often, ["p", "e"]).groupBy("p", "node").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("d"))
    ranked = both.drop("d").join(ranked, ["p", "node"]).select("p", "node", "n", "root", "size", F.posexplode("d").alias("at", "x"), (F.col("size") - F.size("d")).alias("alone"))
    most = lambda total: total - 2 * F.ceil(total * percent / (100 + percent) - 1e-9)  # noqa: E731  that close sets differ in
    ranked = ranked.select("p", F.col("x.e").alias("e"), "node", "n", "root", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"))
    own = F.col("size") - most(F.col("n") + F.floor(F.col("n") * 100 / percent)) - 2  # what any close set, of a size it can have, must share from here on
    ranked = spool(ranked.where(F.col("left") >= own), "near-ranked")
    other = ranked.select("p", "e", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "root", "size", "left")))
    need = F.col("size") + F.col("size_") - most(F.col("n") + F.col("n_"))
    met = ranked.join(other, ["p", "e"]).where("node < node_ AND root <> root_").where((2 * F.col("left") >= need) & (2 * F.col("left_") >= need))
    near = both.where(F.col("size") <= most(F.col("n") + F.col("m"))).select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    return near.union(met.select(F.col("node").alias("a"), F.col("node_").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """A row for each document: n_shingles, component_id (least id it can reach by links), kept."""
    sk = spool(sketch(docs, percent), "near-sketch")
    reps = sk.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = spool(reps.select("set_hash", F.col("r.doc_id").alias("node"), "r.bands", "copies"), "near-reps")
    keys = reps.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    entries = spool(keys.join(shared, "key"), "near-entries")
    chosen = spool(entries.select(F.col("node").alias("doc_id")).distinct(), "near-chosen")
    sets = spool(_full_sets(docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id", "left_semi")), "near-sets")
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("u"))
    nodes = sets.select("node", "n").join(alone, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))
    nodes = nodes.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent)
    entries = spool(entries.join(nodes, "node"), "near-entries")

    lead = F.struct(F.col("node").alias("b"), F.col("n").alias("m"), F.col("u").alias("v"))
    leaders = entries.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("o"), lead.alias("x"))).alias("p"), F.min(F.struct(F.xxhash64("node").alias("o"), lead.alias("x"))).alias("q"), F.count("*").alias("c")).where("c > 1")
    met = entries.join(leaders.select("key", F.explode(F.array("p.x", "q.x")).alias("x")), "key").select("node", "n", "u", "x.*").where(F.col("node") != F.col("b")).where(_possible(percent))
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tested = spool(pair(met, "node", "b"), "near-tested")
    links = spool(_verified(tested, sets, percent), "near-links")
    roots = components(links)

    labelled = spool(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-labelled")
    central = F.min(F.struct((F.col("u") / F.col("n")).alias("o"), "node"))
    centres = labelled.groupBy("root").agg(central.alias("p")).select("root", F.col("p.node").alias("p"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("roots"))
    open_ = sizes.where("roots > 1 AND c > 2").select("key", "c", F.col("top.root").alias("root")).join(centres, "root")
    open_ = spool(open_.select("key", "c", "p"), "near-open")
    few = labelled.join(open_.where(F.col("c") <= FEW).select("key"), "key")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("root").alias("other"))
    rest = pair(few.join(other, "key").where("node < b AND root <> other").where(_possible(percent)), "node", "b")
    many = labelled.join(open_.where(F.col("c") > FEW).select("key", "p"), "key").where("node <> p").select("p", "node", "n", "root").distinct()
    rest = rest.union(_across(spool(many, "near-many"), sets, percent)).distinct().join(tested, ["a", "b"], "left_anti")
    more = spool(_verified(spool(rest, "near-rest"), sets, percent), "near-links")
    if not more.isEmpty():
        roots = components(links.union(more))

    groups = reps.join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").select("set_hash", F.coalesce("root", "node").alias("component"))
    out = sk.select("doc_id", "n_shingles", "set_hash").join(groups, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
