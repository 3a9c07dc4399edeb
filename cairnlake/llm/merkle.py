"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame operations only.

A text splits at newlines into paragraphs, and those at certain spaces into pieces, the
leaves. A section ends with a paragraph whose digest starts with 0 or 1, so that an insertion
moves no later section's bounds. Each node is the SHA-256 of its children's digests: equal
roots mean equal texts. ``differing`` goes down the branches that differ, from sections to paragraphs to pieces, and so locates
an edit on both sides.

The fingerprint has a bounded size: the root, a colon, and the first twelve hexadecimal digits of the ``SKETCH`` least
different leaves. The likeness of two fingerprints is twice the number of their common leaves over the
number of both, leaves counted once each; of texts with more leaves than a fingerprint holds it is estimated from the least leaves of both together.

Defined results: a null text is treated as empty, which is one empty paragraph; documents
with null ids come last in descending order; rows of one id are ordered by a hash of the text, equal ones are each other's next;
a single document is its own next; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where pieces end: after the space that follows punctuation or one of a few letters.
PIECE = r"(?<=[.,;:!?dgmpyz] )"
LEAF, NODE = 12, 32
#: Leaves in a fingerprint.
SKETCH = 64
#: Rows of a range of ids that are ordered together, and ranges at most: beyond 33 million rows ranges grow.
RANGE_ROWS, RANGES = 512, 65_536


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaves(text: Column) -> Column:
    """Array of paragraphs, each the array of its leaves."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.split(p, PIECE, -1), lambda x: F.left(_sha(x), F.lit(NODE))))


def paragraphs(tree: Column) -> Column:
    """Digest of each paragraph of ``leaves``."""
    return F.transform(tree, lambda p: F.left(_sha(F.concat(F.lit("p"), F.array_join(p, ""))), F.lit(NODE)))


def sections(nodes: Column) -> Column:
    """(first paragraph, paragraphs, digest) of each section of ``paragraphs``."""
    ends = F.filter(F.sequence(F.lit(1), F.size(nodes)), lambda i: (i == F.size(nodes)) | F.element_at(nodes, i).rlike("^[01]"))
    start = lambda j: F.when(j > 0, F.element_at(ends, j)).otherwise(F.lit(0)) + 1
    bounds = F.transform(ends, lambda e, j: F.struct(start(j).alias("first"), e.alias("last")))
    return F.transform(bounds, lambda s: F.struct(s["first"].alias("first"), (s["last"] - s["first"] + 1).alias("n"), F.left(_sha(F.concat(F.lit("s"), F.array_join(F.slice(nodes, s["first"], s["last"] - s["first"] + 1), ""))), F.lit(NODE)).alias("digest")))


def root(sections_: Column) -> Column:
    return _sha(F.concat(F.lit("r"), F.array_join(sections_["digest"], "")))


def _with(x: Column, of) -> Column:
    """``of(x)``, with ``x`` computed once."""
    return F.get(F.transform(F.array(x), of), 0)


def labels(leaves_: Column) -> Column:
    """The leaves as they stand in a fingerprint: the least SKETCH different ones, in order."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(F.flatten(leaves_), lambda x: F.left(x, F.lit(LEAF))))), 1, SKETCH)


def tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with columns paragraphs, sections, root and labels of the column ``text``. The leaves, several times as large as the text, do not leave the expression."""
    low = _with(leaves(F.coalesce(F.col(text), F.lit(""))), lambda f: F.struct(paragraphs(f).alias("paragraphs"), labels(f).alias("labels")))
    df = df.withColumn("_tree", _with(low, lambda x: F.struct(x["paragraphs"].alias("paragraphs"), sections(x["paragraphs"]).alias("sections"), x["labels"].alias("labels"))))
    out = df.select("*", *(F.col(f"_tree.{c}").alias(f"{prefix}{c}") for c in ("paragraphs", "sections", "labels"))).drop("_tree")
    return out.withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of ``labels``."""
    both = F.array_union(a, b)
    n = F.when((F.size(a) < SKETCH) & (F.size(b) < SKETCH), F.size(both)).otherwise(F.least(F.size(both), F.lit(SKETCH)))
    common = F.size(F.array_intersect(F.slice(F.sort_array(both), 1, n), F.array_intersect(a, b)))
    return 2.0 * common / (n + common)


def _prefix(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def _apart(a: Column, b: Column) -> tuple[Column, Column]:
    """How many elements two arrays share from the start, and, of the rest, from the end."""
    first = _prefix(a, b)
    rest = F.least(F.size(a), F.size(b)) - first
    return first, F.least(rest, _prefix(F.reverse(a), F.reverse(b)))


def _upto(sections_: Column, n: Column) -> Column:
    """Paragraphs in the first n sections."""
    return F.aggregate(F.slice(sections_, F.lit(1), n), F.lit(0), lambda s, x: s + x["n"].cast("int"))


def differing(df: DataFrame, text: str, other: str, a: str = "", b: str = "edited_") -> DataFrame:
    """``df``, with two texts and their trees of two prefixes, and where they differ: edit_first, edit_last, edit_other_last, edit_piece.

    Sections are compared first, then the paragraphs of those between the first and the last that differ, then the pieces of the first
    paragraph that differs. Paragraphs are counted from 0; from ``edit_first`` up to and without ``edit_last`` the first text
    differs from paragraphs ``edit_first`` to ``edit_other_last`` of the second; all are null if the texts are equal.
    """
    sa, sb = F.col(f"{a}sections"), F.col(f"{b}sections")
    df = df.withColumn("_at", F.struct(*(x.alias(n) for x, n in zip(_apart(sa["digest"], sb["digest"]), ("head", "tail"), strict=True))))
    df = df.withColumn("_skip", F.struct(_upto(sa, F.col("_at.head")).alias("head"), _upto(F.reverse(sa), F.col("_at.tail")).alias("tail")))
    inner = lambda x: F.slice(F.col(x), F.col("_skip.head") + 1, F.size(x) - F.col("_skip.head") - F.col("_skip.tail"))
    df = df.withColumn("_in", F.struct(*(x.alias(n) for x, n in zip(_apart(inner(f"{a}paragraphs"), inner(f"{b}paragraphs")), ("head", "tail"), strict=True))))
    first, tail = F.col("_skip.head") + F.col("_in.head"), F.col("_skip.tail") + F.col("_in.tail")
    none = F.array().cast("array<string>")
    pieces = lambda x: F.coalesce(F.split(F.get(F.split(F.coalesce(F.col(x), F.lit("")), "\n", -1), first), PIECE, -1), none)  # noqa: E731  equal pieces are equal leaves
    piece = _prefix(pieces(text), pieces(other))
    out = {"edit_first": first, "edit_last": F.size(f"{a}paragraphs") - tail, "edit_other_last": F.size(f"{b}paragraphs") - tail, "edit_piece": piece}
    changed = F.col(f"{a}root") != F.col(f"{b}root")
    return df.select("*", *(F.when(changed, x).cast("int").alias(n) for n, x in out.items())).drop("_at", "_skip", "_in")


def _bounds(docs: DataFrame) -> list[tuple[int | None, int]]:
    """Bounds (id, hash), rising with nulls first, that cut the documents into ranges of about equal rows; an id that many rows share, or none, is cut by the hash."""
    top = 2**63 - 1
    known = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("m")).first()
    n, nulls = known["n"], known["n"] - known["m"]
    k = max(1, min(RANGES, n // RANGE_ROWS))
    out: list[tuple[int | None, int]] = []
    if k > 1 and known["m"]:
        found = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(100_000, 4 * k))).first()[0]
        for i in sorted(set(found)):
            parts = found.count(i) if len(set(found)) < len(found) else 1
            out += [(i, -(2**63) + j * 2**64 // parts) for j in range(1, parts)] + [(i, top)]
    parts = max(1, k * nulls // n) if n else 1
    lowest = [(None, -(2**63) + j * 2**64 // parts) for j in range(1, parts)] + [(None, top)] if nulls and k > 1 else []
    return lowest + out


def _range_of(key: Column, bounds: list[tuple[int | None, int]]) -> Column:
    """How many bounds are less than the key (id, hash), by binary search."""
    if not bounds:
        return F.lit(0)
    said = F.from_json(F.lit(json.dumps([{"i": i, "h": h} for i, h in bounds])), "array<struct<i: bigint, h: bigint>>")
    steps = F.array(*(F.lit(1 << j) for j in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(said, p + s - 1) < key, p + s).otherwise(p))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document, by descending id; after the last comes the first.

    Ids are cut into ranges of about equal rows. The first row of each range is also sent to the
    range before, so that each range finds all its successors by itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("range", _range_of(F.struct(F.col("doc_id").alias("i"), F.col("h")), _bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")))))
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("x")).select("range", "x.*").collect()  # RANGES rows at most
    heads.sort(key=lambda r: -r["range"])
    to = [(r["doc_id"], r["h"], heads[j - 1]["range"]) for j, r in enumerate(heads)]
    sent = F.broadcast(spark.createDataFrame(to, "head long, hh long, to int"))
    rows = rows.join(sent, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("hh")), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("copy"))
    both = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(1).alias("copy"))))
    rows = rows.select("doc_id", "text", "h", F.explode(both).alias("x")).select("doc_id", "text", "h", "x.range", "x.copy")
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return rows.withColumn("next_text", F.lead("text").over(order)).where("copy = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and their likeness to each other and to the next document's, and where the edit stands."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    rows = rows.withColumn("edited_sha256", _sha(F.col("edited")))
    rows = differing(tree(tree(rows, "text"), "edited", "edited_"), "text", "edited").withColumn("next_labels", labels(leaves(F.col("next_text"))))
    said = lambda p: F.concat(F.col(f"{p}root"), F.lit(":"), F.array_join(f"{p}labels", ""))
    near = lambda other: likeness(F.col("labels"), F.col(other))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", said("").alias("fingerprint"), said("edited_").alias("edited_fingerprint"), near("edited_labels").alias("near_edited"), near("next_labels").alias("near_next"),
        "edit_first", "edit_last", "edit_other_last", "edit_piece",
    )
