import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cairnlake.llm import merkle as m

from .conftest import EDGES


@pytest.mark.parametrize("rows_per_range", [512, 2])
def test_against_brute_force(make, monkeypatch, rows_per_range):
    monkeypatch.setattr(m, "RANGE_ROWS", rows_per_range)
    rows = [(k * 3, f"Line {k}, one.\nLine two of {k % 7}. And more é😀{'x' * (k % 5)}" * (k % 4), "en", "s") for k in range(60)]
    got = {r["doc_id"]: r for r in m.fingerprints(make(rows)).collect()}
    down = sorted(rows, reverse=True)
    for k, (i, text, _, _) in enumerate(down):
        following = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) == (text == following) or r["near_next"] < 1
    by_text = {}
    for i, text, _, _ in rows:
        by_text.setdefault(text, set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)


def test_many_ranges(make, monkeypatch):
    monkeypatch.setattr(m, "RANGE_ROWS", 3)
    rows = [(k, f"t{k}", None, None) for k in range(400)]
    got = {r["doc_id"]: r["next_text"] for r in m.with_next(make(rows)).collect()}
    assert got == {k: f"t{(k - 1) % 400}" for k in range(400)}


def test_edits_are_located(make):
    """Edits of every sort, against trimming equal paragraphs and pieces from both ends."""
    rnd = random.Random(4)
    line = lambda: " ".join(rnd.choice(["one,", "two.", "three", "four;", "five", "é😀"]) for _ in range(rnd.randint(0, 6)))
    rows = []
    for _ in range(150):
        a = [line() for _ in range(rnd.randint(1, 25))]
        b = list(a)
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(3)] = rnd.choice([[], [line()], b[:1], [line(), line()]])
        rows.append(("\n".join(a), "\n".join(b)))
    df = make([]).sparkSession.createDataFrame(rows, "a string, b string")
    out = m.differing(m.tree(m.tree(df, "a"), "b", "edited_"), "a", "b").select("a", "b", "edit_first", "edit_last", "edit_other_last", "edit_piece").collect()

    def head(x, y):
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return k

    for r in out:
        x, y = r["a"].split("\n"), r["b"].split("\n")
        if r["a"] == r["b"]:
            assert r["edit_first"] is r["edit_last"] is r["edit_piece"] is None
            continue
        first = head(x, y)
        tail = min(head(x[::-1], y[::-1]), min(len(x), len(y)) - first)
        assert (r["edit_first"], r["edit_last"], r["edit_other_last"]) == (first, len(x) - tail, len(y) - tail)
        cut = lambda z: re.split(m.PIECE, z[first]) if first < len(z) else []
        assert r["edit_piece"] == head(cut(x), cut(y))


def test_fingerprints_are_bounded_and_alike_as_texts_are(make):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgmpy") for _ in range(4))
    base = [word() for _ in range(3000)]
    rows = [(k, " ".join(base[: 3000 - 300 * k] + [word() for _ in range(300 * k)]), "en", "s") for k in range(10)]
    docs = m.tree(make(rows), "text").select("doc_id", "text", F.col("labels").alias("x"), F.array_distinct(F.transform(F.flatten(m.leaves(F.col("text"))), lambda x: F.left(x, F.lit(m.LEAF)))).alias("all")).orderBy("doc_id").collect()
    assert all(len(r["x"]) == m.SKETCH for r in docs)
    for r in docs[1:]:
        a, b = set(docs[0]["all"]), set(r["all"])
        near = make([(1, "", None, None)]).select(m.likeness(F.array(*map(F.lit, docs[0]["x"])), F.array(*map(F.lit, r["x"]))).alias("x")).first()["x"]
        assert abs(near - 2 * len(a & b) / (len(a) + len(b))) < 0.2


def test_ids_that_many_rows_share(make, monkeypatch):
    """Rows of one id, and of none, are cut by the hash of their text, and each finds its next."""
    monkeypatch.setattr(m, "RANGE_ROWS", 4)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}", None, None) for k in range(240)]
    docs = make(rows)
    assert len(m._bounds(docs)) > 40
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    down = sorted(found, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"]))
    got = {r["text"]: r["next_text"] for r in m.with_next(docs).collect()}
    assert got == {r["text"]: down[(k + 1) % len(down)]["text"] for k, r in enumerate(down)}


def test_edges(edges, nothing, make):
    got = m.fingerprints(edges).collect()
    assert len(got) == len(EDGES) and m.fingerprints(nothing).count() == 0
    assert all(r["fingerprint"] for r in got)
    one = m.fingerprints(make([(5, "ab", None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest() and one["near_next"] == 1
