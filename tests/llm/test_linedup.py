import random

import pytest
from pyspark.sql import functions as F

from cairnlake.llm import linedup as d
from cairnlake.llm.common import spool

from .conftest import EDGES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(n, seed, alphabet="abcé😀", length=14):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a = [rnd.choice(alphabet) for _ in range(rnd.randint(0, length))]
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(alphabet)]])
        out.append(("".join(a), "".join(b)))
    return out


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_automaton_against_distance(spark, edits):
    rows = variants(300, 3)
    rnd = random.Random(5)
    for a, _ in variants(150, 4, "abé", 90):  # several blocks, edits anywhere, long equal runs
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 1)] = rnd.choice([[], ["x"], ["a"]])
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", d.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert all(r["w"] == (distance(r["a"], r["b"]) <= edits) for r in got)


def links(make, lines, edits):
    docs = make([(k, x, None, None) for k, x in enumerate(lines)])
    at = spool(d.line_table(docs, edits + 1, edits), "test-lines")
    of = {(r["h"], r["g"]): r["line"] for r in docs.select("text").distinct().select(F.col("text").alias("line"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).collect()}
    got = [frozenset((of[tuple(r["a"])], of[tuple(r["b"])])) for r in d.edit_links(at, docs, edits).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute_links(lines, edits):
    return {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("busy", [256, 1])
def test_links_against_brute_force(make, monkeypatch, edits, busy):
    monkeypatch.setattr(d, "BUSY", busy)
    lines = sorted({x for r in variants(200, 7) for x in r if len(x) > edits})
    assert links(make, lines, edits) == brute_links(lines, edits)


@pytest.mark.parametrize("edits", [1, 2])
def test_segments_that_many_lines_share(make, monkeypatch, edits):
    """Lines that differ in a short part of a common frame: groups are split, and no link is lost."""
    monkeypatch.setattr(d, "BUSY", 8)
    rnd = random.Random(edits)
    frame = "same start {} same end"
    lines = sorted({frame.format("".join(rnd.choice("012") for _ in range(rnd.randint(4, 6)))) for _ in range(80)} | {f"{k:03d}{frame}" for k in range(40)} | {f"{frame}{k:03d}" for k in range(40)})
    want = brute_links(lines, edits)
    assert links(make, lines, edits) == want and len(want) > 200


def brute(rows, min_chars, max_copies):
    """Texts of documents (id, text), rows of one id and text once, after removing repeated lines within one edit."""
    occ = sorted({(i, k, t, x) for i, t in rows for k, x in enumerate(t.split("\n")) if len(x) >= min_chars})
    kinds = sorted({x for *_, x in occ})
    root = {x: x for x in kinds}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    classes = {}
    for i, k, t, x in occ:
        classes.setdefault(find(x), []).append((i, k, t))
    gone = {c for found in classes.values() if len(found) > max_copies for c in found[1:]}
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k, t) not in gone)) for i, t in rows]


def test_documents_against_brute_force(make):
    rnd = random.Random(11)
    pool = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(3, 30))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = ["".join(rnd.choice("abcdefgh ") for _ in range(25)) for _ in range(rnd.randrange(4))]
        for _ in range(rnd.randrange(4)):
            x = rnd.choice(pool)
            k = rnd.randrange(len(x))
            lines.insert(rnd.randint(0, len(lines)), rnd.choice([x, x, x[:k] + "z" + x[k + 1 :]]))
        rows.append((i, "\n".join(lines)))
    rows += rows[:5] * 4  # repeated rows are one document
    for copies in (1, 3):
        got = sorted((r["doc_id"], r["text"]) for r in d.dedup_documents(make([(i, t, None, None) for i, t in rows]), min_chars=6, max_copies=copies).collect())
        want = brute(rows, 6, copies)
        assert got == sorted(want) and sum(t != u for (_, t), (_, u) in zip(rows, want, strict=True)) > 5


def test_repeated_rows_count_once(make):
    """A line that two documents share twice stays under max_copies 2, however often a row is repeated."""
    line, own = "a line of some length that two documents share", "another line, which only one document has, of some length"
    rows = [(1, f"{line}\n{own}")] * 6 + [(2, line)]
    texts = lambda copies: sorted((r["doc_id"], r["text"]) for r in d.dedup_documents(make([(i, t, None, None) for i, t in rows]), max_copies=copies).collect())
    assert texts(2) == sorted(rows) and texts(1) == sorted([*rows[:6], (2, "")])


def test_edges(edges, nothing):
    got = d.dedup_documents(edges)
    assert set(edges.columns) <= set(got.columns)
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(t) for _, t, _, _ in EDGES)
    clash = edges.withColumn("repeated", F.lit(1)).withColumn("d", F.lit(2)).withColumn("row", F.lit(3)).withColumn("_n_links", F.lit(4))
    assert d.dedup_documents(clash).columns == clash.columns and d.dedup_documents(clash).count() == len(EDGES)
    assert d.dedup_documents(nothing).count() == 0


def test_texts_meet_details_by_the_sessions_threshold(spark, make):
    """The table of repeats grows with the texts: no hint broadcasts it at one size only. Results are the same either way."""
    rows = [(k, f"a line of some length that many documents share\nline {k} has words of its own, number {k * 7919}") for k in range(30)] + [(40, "short"), (None, "short"), (41, None)]
    docs = make([(i, t, None, None) for i, t in rows])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = []
    try:
        for most in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            got = d.dedup(docs)
            plan = got._jdf.queryExecution().executedPlan().toString()
            seen.append((sorted(map(repr, got.select("row.doc_id", "text", "n_removed", "n_lines", "n_links", "repeated").collect())), "BroadcastHashJoin" in plan))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [x for _, x in seen] == [False, True] and seen[0][0] == seen[1][0] and len(seen[0][0]) == len(rows)
    assert sum("n_removed=1" in r for r in seen[0][0]) == 29
