"""Which needles occur in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.plans.spool import spool

#: Different needles searched for in one pass over the texts, and their bytes, about.
BLOCK, BLOCK_BYTES = 50_000, 32 << 20


def find_needles(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str, *, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(needle_key, key) of each needle and each text that holds it.

    Different needles of a block are found in one pass over a text by an automaton, and met with the keys of equal ones by a join after; blocks
    of needles, by a hash of their text, are passed one after the other, so that a worker's memory stays bounded. The
    empty needle occurs everywhere; null needles and texts match nothing.
    """
    n = needles.where(F.col(needle).isNotNull()).select(needle_key, F.col(needle).alias("_needle"), F.sha2(needle, 256).alias("_of"))
    once = spool(n.select("_of", "_needle").dropDuplicates(["_of"]), "needles")
    size = once.agg(F.count("*").alias("n"), F.sum(F.octet_length("_needle")).alias("b")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["b"] or 0) // block_bytes))
    kinds = f"_of string, {key} {texts.schema[key].dataType.simpleString()}"
    out = None
    for k in range(blocks):
        rows = once.where(F.pmod(F.xxhash64("_of"), F.lit(blocks)) == k).collect()  # about ``block`` rows of ``block_bytes``
        of = {r["_needle"]: r["_of"] for r in rows}
        everywhere = of.pop("", None)

        def run(batches: Iterator[pa.RecordBatch], of=of, everywhere=everywhere) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for s, h in of.items():
                machine.add_word(s, h)
            if of:
                machine.make_automaton()
            for b in batches:
                hits = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t is None:
                        continue
                    hits += [(h, i) for h in ({h for _, h in machine.iter(t)} if of else ())]
                    if everywhere:
                        hits.append((everywhere, i))
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], b.schema.types[0])], ["_of", key])

        part = texts.select(key, text).mapInArrow(run, kinds)
        out = part if out is None else out.union(part)
    return out.join(n.select("_of", needle_key), "_of").select(needle_key, key)
