"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines of at least ``min_chars`` code points are split into ``max_edits`` + 1 segments. Two lines within
``max_edits`` edits share a segment, so a line probes, for each length down to
``max_edits`` less than its own, the index of segments with the few substrings at which that
segment can stand. Candidates are verified by a banded, bit-parallel automaton: one bit
for each diagonal of the band, one mask for each number of edits (``within``).

A segment that many lines share is split, not joined all with all: what is left of such lines on
the side where edits must be is cut into segments again, and only lines that share one of those too stay together. This
goes on until groups are small or nothing is left to cut (``_pairs``).

Lines within the threshold, directly or through others, are a class. Of a class with more than ``max_copies``
lines in the corpus only the first, by document and place, stays. With ``copies_percent``, a line also stays in a document whose whole
text is shown to be a copy, of at least that similarity, of the document of that first line: copies are left to the deduplication of
documents.

Defined results: a null text stays null and an empty one empty, with one line; rows with a null id
are left alone; rows of one id and one text are one document, counted once and all treated alike; of rows of one id with different texts each is a
document, ordered by a hash of the text; lines shorter than ``min_chars`` are never removed; very long lines and texts are compared whole; of lines at
one place of equal ids the hash decides which is first; lines are told apart by 128 bits of hash; an empty table gives an empty result; other columns, whatever
their names, are kept by ``dedup_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import broadcast_if_small, spool
from cairnlake.llm.components import components

MAX_EDITS = 1
MIN_CHARS = 24
MAX_COPIES = 1
#: A key under which more pairs would be compared is split.
BUSY = 256
#: Code points that the automaton reads at a time.
BLOCK = 16
#: Words of a shingle, and pairs with one first document that one task compares.
WORDS, PAIRS = 5, 256
#: Least shingles of a document by which hopeless pairs are told.
SKETCH = 64


def _segment(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k of n code points; the last ones are longer by one."""
    base = F.floor(n / k).cast("int")
    longer = n - base * k
    start = base * (i - 1) + F.greatest(F.lit(0), longer - (k - i + 1)) + 1
    return start.cast("int"), (base + (i > k - longer).cast("int")).cast("int")


def _key(line: Column, n: Column, k: int, i: int, shift: int) -> Column:
    """Hash of what stands at segment i of a line of n code points, moved by ``shift``."""
    start, length = _segment(n, F.lit(k), F.lit(i))
    return F.xxhash64(F.lit(i), n, F.substring(line, start + shift, length))


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) at which a longer line must look for a shorter one's segment.

    With d the difference, i-1 edits at most stand left of segment i and max_edits+1-i right of it
    in the alignment that matters, which bounds the shift from both sides.
    """
    out = []
    for d in range(max_edits + 1):
        for i in range(1, max_edits + 2):
            low, high = max(1 - i, d - (max_edits + 1 - i)), min(i - 1, d + (max_edits + 1 - i))
            out += [(d, i, shift) for shift in range(low, high + 1)]
    return out


def _looks(max_edits: int) -> list[tuple[int, int, int]]:
    """The index, (0, segment, 0), and then all other probes."""
    index = [(0, i, 0) for i in range(1, max_edits + 2)]
    return index + [x for x in probes(max_edits) if x not in index]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: a bit-parallel automaton over the band of 2*edits+1 diagonals.

    Bit k of mask e is set if the code points of ``a`` read so far can become as many of ``b``, and
    k - edits more, by e edits. A step keeps the bits whose diagonal matches, and admits one edit more by
    substitution (same diagonal), deletion (one lower) or insertion (one higher).

    Code points are read in blocks. While no edit was needed the masks hold all that e edits can reach, which a
    block equal in both strings leaves as it is; once all masks are empty nothing follows. Neither is read further.
    """
    full, middle = (1 << (2 * edits + 1)) - 1, 1 << edits
    start = [sum(1 << k for k in range(edits - e, edits + e + 1)) for e in range(edits + 1)]
    names = [f"r{e}" for e in range(edits + 1)]
    blocks = lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = -(-max(edits, 1) // BLOCK)  # blocks on each side that the band reaches into

    def step(s: Column, c: Column) -> Column:
        match = F.lit(0)
        for k in range(2 * edits + 1):
            match = match + F.when(F.get(s["b"], s["j"] + (k - edits)) == c, F.lit(1 << k)).otherwise(F.lit(0))

        def masks_of(m: Column) -> Column:
            masks: list[Column] = []
            for e, name in enumerate(names):
                kept = s[name].bitwiseAND(m)
                if e:
                    before = s[names[e - 1]]
                    kept = kept.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(masks[e - 1], 1)).bitwiseAND(F.lit(full))
                masks.append(kept)
            return F.struct((s["j"] + 1).alias("j"), s["b"].alias("b"), *(x.alias(n) for n, x in zip(names, masks, strict=True)))

        return F.get(F.transform(F.array(match), masks_of), 0)  # so that the match is computed once

    def read(s: Column, i: Column) -> Column:
        at = lambda j: F.coalesce(F.get(s["y"], j), F.lit(""))
        left = F.concat(*(at(i - k) for k in range(reach, 0, -1)))
        window = F.concat(left, at(i), *(at(i + k) for k in range(1, reach + 1)))
        first = F.struct(F.length(left).alias("j"), F.split(window, "").alias("b"), *(s[n].alias(n) for n in names))
        done = F.aggregate(F.split(F.get(s["x"], i), ""), first, step)
        moved = F.get(F.transform(F.array(done), lambda z: F.struct(s["x"].alias("x"), s["y"].alias("y"), *(z[n].alias(n) for n in names))), 0)
        same = (s["r0"] == middle) & F.coalesce(F.get(s["x"], i) == F.get(s["y"], i), F.lit(False))
        return F.when((s[names[-1]] == 0) | same, s).otherwise(moved)

    state = F.struct(blocks(a).alias("x"), blocks(b).alias("y"), *(F.lit(x).alias(n) for n, x in zip(names, start, strict=True)))
    last = F.aggregate(F.sequence(F.lit(0), F.floor((F.length(a) - 1) / BLOCK).cast("int")), state, read, lambda s: s[names[-1]])
    end = F.length(b) - F.length(a) + edits
    reached = F.when((end < 0) | (end > 2 * edits), F.lit(False)).otherwise(F.call_function("shiftright", last, end).bitwiseAND(F.lit(1)) == 1)
    return F.when((a == "") | (b == ""), F.abs(F.length(a) - F.length(b)) <= edits).otherwise(reached)


def line_table(docs: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """(doc_id, t, line_no, h, g, n, k0, k1, ...) of each line that takes part; t: hash of the text, (h, g): of the line, n: code points, k: a key for each of ``_looks``."""
    at = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    at = at.withColumn("n", F.length("line")).where(F.col("n") >= max(min_chars, max_edits + 1))
    keys = [_key(F.col("line"), F.col("n") - d, max_edits + 1, i, shift).alias(f"k{j}") for j, (d, i, shift) in enumerate(_looks(max_edits))]
    return at.select("doc_id", "t", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "n", *keys)


def _each_key(at: DataFrame, max_edits: int, *columns: str) -> DataFrame:
    """A row for each key of each line: ``columns``, key, look (which of ``_looks``)."""
    looks = F.array(*(F.struct(F.col(f"k{j}").alias("key"), F.lit(j).alias("look")) for j in range(len(_looks(max_edits)))))
    return at.select(*columns, F.explode(looks).alias("x")).select(*columns, "x.*")


def _meet(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of lines of one key: those in the index, and those that probe it with them."""
    index = rows.where("indexed").select("key", "id")
    other = rows.select("key", "indexed", F.col("id").alias("o"))
    met = index.join(other, "key").where("id <> o AND (NOT indexed OR id < o)")
    return met.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def _split(rows: DataFrame) -> DataFrame:
    """Rows of busy keys under finer keys: ``m`` code points of the indexed line are left, from ``lo`` on ``len`` of the own, with ``t`` edits.

    Of t + 1 segments of them one stands in both lines, with u - 1 edits at most left of segment u and t + 1 - u right of it. Edits are next looked for
    on the right, or left of the last segment.
    """
    t, m, size, lo = F.col("t"), F.col("m"), F.col("len"), F.col("lo")

    def looks(u: Column) -> Column:
        start, length = _segment(m, t + 1, u)
        d = size - m
        low = F.greatest(1 - u, d - (t + 1 - u))
        high = F.least(u - 1, d + (t + 1 - u))

        def look(shift: Column) -> Column:
            used = start - 1 + length
            right = u <= t
            return F.struct(
                F.xxhash64(F.col("key"), u, F.substring(F.col("line"), lo + start - 1 + shift, length)).alias("key"),
                (F.col("indexed") & (shift == 0)).alias("indexed"),
                F.when(right, m - used).otherwise(start - 1).cast("int").alias("m"),
                F.when(right, lo + used + shift).otherwise(lo).cast("int").alias("lo"),
                F.when(right, size - used - shift).otherwise(start - 1 + shift).cast("int").alias("len"),
                F.when(right, t + 1 - u).otherwise(t).cast("int").alias("t"),
            )

        return F.when(low <= high, F.transform(F.sequence(low, high), look)).otherwise(F.array().cast("array<struct<key: bigint, indexed: boolean, m: int, lo: int, len: int, t: int>>"))

    every = F.flatten(F.transform(F.sequence(F.lit(1), t + 1), looks))
    return rows.select("id", "line", F.explode(every).alias("x")).select("id", "line", "x.*").where("len >= 0")


def _with_load(rows: DataFrame) -> DataFrame:
    """``rows`` whose key has lines to compare, with ``busy``: whether these are more than BUSY pairs."""
    n, p = F.sum(F.col("indexed").cast("long")), F.sum((~F.col("indexed")).cast("long"))
    load = rows.groupBy("key").agg(n.alias("n"), p.alias("p")).where("n > 0 AND n + p > 1").select("key", (F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("p") > BUSY).alias("busy"))
    return rows.join(broadcast_if_small(spool(load, "line-load")), "key")


def _pairs(entries: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Candidate pairs (a, b) of lines by id, from (key, look, id, n); keys of many lines are split until they are few."""
    plan = F.array(*(F.struct(F.lit(j < max_edits + 1).alias("indexed"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for j, (d, i, shift) in enumerate(_looks(max_edits))))
    rows = spool(_with_load(entries.withColumn("x", F.get(plan, F.col("look"))).select("key", "id", "n", "x.*")), "line-entries")
    found = spool(_meet(rows.where("NOT busy")), "line-candidates")
    busy = rows.where("busy")
    if busy.isEmpty():
        return found
    m = F.col("n") - F.col("d")
    start, length = _segment(m, F.lit(max_edits + 1), F.col("i"))
    used, right = start - 1 + length, F.col("i") <= max_edits
    busy = busy.select(
        "key", "id", "indexed", F.when(right, m - used).otherwise(start - 1).cast("int").alias("m"), F.when(right, used + F.col("shift") + 1).otherwise(1).cast("int").alias("lo"),
        F.when(right, F.col("n") - used - F.col("shift")).otherwise(start - 1 + F.col("shift")).cast("int").alias("len"), F.when(right, max_edits + 1 - F.col("i")).otherwise(max_edits).cast("int").alias("t"),
    )
    busy = busy.join(texts, "id")
    while True:
        rows = spool(_with_load(_split(busy)), "line-split")
        last = F.col("m") <= F.col("t")  # too short to cut: such lines differ in these few code points only
        found = found.union(spool(_meet(rows.where(~F.col("busy") | last)), "line-candidates"))
        busy = rows.where(F.col("busy") & ~last).drop("busy")
        if busy.isEmpty():
            return found.distinct()


def edit_links(at: DataFrame, docs: DataFrame, max_edits: int) -> DataFrame:
    """The pairs (a, b), a < b, of different lines of a spooled ``line_table`` that are within ``max_edits`` edits, as structs (h, g)."""
    looked = _each_key(at, max_edits, "h").groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.min("look").alias("look"))
    shared = spool(looked.where((F.col("x") != F.col("y")) & (F.col("look") <= max_edits)).select("key"), "line-keys")
    entries = _each_key(at, max_edits, "h", "g", "n", "doc_id", "t").join(broadcast_if_small(shared), "key")
    entries = entries.groupBy("key", "look", "h", "g").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    entries = spool(entries.withColumn("id", F.struct("h", "g")), "line-entries")
    want = spool(entries.groupBy("id").agg(F.min("doc_id").alias("doc_id")), "line-wanted")
    some = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(spool(want.select("doc_id").distinct(), "line-docs")), "doc_id", "left_semi")
    lines = some.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("id", F.struct(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")))
    texts = spool(lines.join(broadcast_if_small(want), ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "line"), "line-texts")
    pairs = spool(_pairs(entries.select("key", "look", "id", "n"), texts, max_edits), "line-pairs")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(within(F.col("line_a"), F.col("line_b"), max_edits)).select("a", "b")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(d, s, n, h, k): hashes of the distinct five-word shingles of each document (d, text) with words, in order; their number, their hash, and the least SKETCH of them."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("d", F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    s = F.when(n < WORDS, F.array(F.xxhash64("w"))).otherwise(F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(F.slice("w", i, WORDS))))
    sets = rows.select("d", F.sort_array(F.array_distinct(s)).alias("s"))
    return sets.select("d", "s", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("h"), F.slice("s", 1, SKETCH).alias("k"))


def copies(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (d, first) of documents whose texts have a Jaccard similarity of ``percent`` or more.

    Sizes are compared first; equal sets are copies, and of the others the least shingles of both discard pairs that are six standard deviations
    under the threshold. Full sets decide on what is left. A document that is the first of many is dealt to several tasks.
    """
    ends = spool(pairs.select(F.explode(F.array("d", "first")).alias("d")).distinct(), "line-ends")
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t")).alias("d"), "text")
    sets = spool(shingle_sets(named.join(broadcast_if_small(ends), "d", "left_semi")), "line-sets")
    if sets.count() > sets.select("d").distinct().count():  # rows of one document
        sets = spool(sets.dropDuplicates(["d"]), "line-sets")
    named = broadcast_if_small(spool(pairs.select("first").distinct(), "line-named"))
    firsts = sets.select(F.col("d").alias("first"), F.col("n").alias("m"), F.col("h").alias("g")).join(named, "first", "left_semi")
    met = sets.select("d", "n", "h").join(broadcast_if_small(pairs), "d").join(broadcast_if_small(spool(firsts, "line-firsts")), "first")
    met = spool(met.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("d", "first", (F.col("h") == F.col("g")).alias("same")), "line-met")
    other = met.where("NOT same").select("d", "first")
    heads = broadcast_if_small(spool(other.select("first").distinct(), "line-heads"))
    sketches = spool(sets.select(F.col("d").alias("first"), F.col("k").alias("z")).join(heads, "first", "left_semi"), "line-sketches")
    both = F.sort_array(F.array_union("k", "z"))
    most = F.when((F.size("k") < SKETCH) & (F.size("z") < SKETCH), F.size(both)).otherwise(F.least(F.size(both), F.lit(SKETCH)))
    common = F.size(F.array_intersect(F.slice(both, 1, most), F.array_intersect("k", "z")))
    margin = 6 * (percent * (100 - percent) / SKETCH) ** 0.5
    likely = sets.select("d", "k").join(broadcast_if_small(spool(other, "line-other")), "d").join(broadcast_if_small(sketches), "first").where(common * 100 >= most * (percent - margin))
    likely = spool(likely.select("d", "first"), "line-likely")
    often = spool(likely.groupBy("first").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")), "line-often")
    busy = broadcast_if_small(spool(often.where("parts > 1"), "line-busy-firsts"))
    parts = F.coalesce("parts", F.lit(1))
    full = sets.select("d", "s", "n")
    left = full.join(broadcast_if_small(likely), "d").join(busy, "first", "left").withColumn("part", F.pmod(F.xxhash64("d"), parts).cast("int")).drop("parts")
    right = full.select(F.col("d").alias("first"), F.col("s").alias("z"), F.col("n").alias("m")).join(broadcast_if_small(often), "first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shared = F.size(F.array_intersect("s", "z")).cast("long")
    near = left.join(right, ["first", "part"]).select("d", "first", "n", "m", shared.alias("c"))
    near = near.where(F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * percent).select("d", "first")
    return met.where("same").select("d", "first").union(near)


def find_repeats(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, max_copies: int = MAX_COPIES, copies_percent: int | None = None) -> DataFrame:
    """(d, n_links, repeated) of documents (doc_id, hash of the text) with linked or repeated lines.

    ``repeated``: the lines that go, each with its class: document and place of the first line of it.
    ``n_links``: how many different lines its lines are linked with, summed.
    """
    at = spool(line_table(docs, min_chars, max_edits), "line-table")
    links = spool(edit_links(at, docs, max_edits), "line-links")
    roots = components(links)
    degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    linked = spool(roots.join(degree, "node").select("node.h", "node.g", "root", "n_links"), "line-linked")
    often = at.groupBy("h", "g").agg(F.count("*").alias("copies")).where("copies > 1").select("h", "g")
    known = spool(often.join(linked, ["h", "g"], "full"), "line-known")
    hit = at.select("doc_id", "t", "line_no", "h", "g").join(broadcast_if_small(known), ["h", "g"])
    hit = hit.select("doc_id", "t", "line_no", F.coalesce("root", F.struct("h", "g")).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    per = hit.groupBy("doc_id", "t").agg(F.collect_set(F.struct("line_no", "root", "n_links")).alias("x"))  # rows of one document, once
    per = spool(per.select(F.struct("doc_id", "t").alias("d"), "x"), "line-hits")
    each = per.select("d", F.explode("x").alias("x")).select("d", "x.*")
    classes = each.groupBy("root").agg(F.count("*").alias("total"), F.min(F.struct("d.doc_id", "line_no", "d.t")).alias("head")).where(F.col("total") > max_copies)
    classes = spool(classes.select("root", "head"), "line-classes")
    goes = each.join(broadcast_if_small(classes), "root").where(F.struct("d.doc_id", "line_no", "d.t") != F.col("head"))
    goes = goes.select("d", F.struct("head.doc_id", "head.t").alias("first"), F.struct("line_no", F.col("head.doc_id").alias("class_doc"), F.col("head.line_no").alias("class_line")).alias("x"))
    if copies_percent is not None:
        goes = spool(goes, "line-goes")
        same = copies(docs, spool(goes.where("d <> first").select("d", "first").distinct(), "line-copied"), copies_percent)
        goes = goes.join(broadcast_if_small(spool(same, "line-copies")), ["d", "first"], "left_anti")
    gone = goes.groupBy("d").agg(F.array_sort(F.collect_list("x")).alias("repeated"))
    total = per.select("d", F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["n_links"]).alias("n_links"))
    return total.join(gone, "d", "left").where("n_links > 0 OR repeated IS NOT NULL")


def dedup(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, max_copies: int = MAX_COPIES, copies_percent: int | None = None, details: bool = True) -> DataFrame:
    """(row, text, n_removed[, n_lines, n_links, repeated]) of each row of ``docs``, which is ``row``; ``text`` is without repeated lines.

    With ``details`` texts meet a row for each document with repeated or linked lines. That table grows with the texts, so the session's threshold decides
    whether it is broadcast, and what is moved grows with the input.
    """
    repeats = find_repeats(docs, max_edits=max_edits, min_chars=min_chars, max_copies=max_copies, copies_percent=copies_percent)
    gone = F.col("repeated.line_no").alias("gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t")).alias("d"))
    if details:
        both = rows.join(spool(repeats, "line-repeats"), "d", "left").select("row", "text", "n_links", "repeated", gone)
    else:
        both = rows.join(broadcast_if_small(spool(repeats.where("repeated IS NOT NULL").select("d", gone), "line-repeats")), "d", "left")
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    kept = F.aggregate(F.array(F.split("text", "\n", -1)), F.lit(""), lambda _, p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n"))  # so that a text is split once
    changed = F.col("gone").isNotNull()
    out = ["row", F.when(changed, kept).otherwise(F.col("text")).alias("text"), F.when(changed, F.size("gone")).otherwise(0).cast("long").alias("n_removed")]
    if details:
        none = F.array().cast("array<struct<line_no: int, class_doc: bigint, class_line: int>>")
        n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        out += [F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("repeated", none).alias("repeated")]
    return both.select(*out)


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines, by the options of ``dedup``: all columns are kept, and ``text`` is what stays."""
    return dedup(docs, **options, details=False).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
