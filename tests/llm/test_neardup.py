import random

import numpy as np
import pytest

from cairnlake.llm import neardup as n
from cairnlake.llm.components import components

from .conftest import EDGES


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 85 * (len(sets[a]) + len(sets[b]) - s):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(120)]
    out = [" ".join(base)] * 9
    for _ in range(160):  # a large group, from one edit to many
        w = list(base)
        for _ in range(rnd.randint(1, 6)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[word()], [], [w[k], "and"], ["the"]])
        out.append(" ".join(w))
    for _ in range(60):
        out.append(" ".join(base[:25] + [word() for _ in range(rnd.randint(0, 60))]))
    for n_ in range(12):
        out.append(" ".join(base[: n_ % 7]).upper())
    chain = [word() for _ in range(100)]
    for k in range(12):
        out.append(" ".join(chain[2 * k : 2 * k + 60]))
    return list(enumerate(out))


@pytest.mark.parametrize("few", [8, 2])
def test_components_against_brute_force(make, monkeypatch, few):
    monkeypatch.setattr(n, "FEW", few)
    rows = texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in n.near_duplicates(make([(i, t, None, None) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_estimates():
    rnd = np.random.default_rng(1)
    for shared, own in ((900, 50), (500, 500), (100, 900)):
        both = rnd.integers(0, 2**63, shared).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 2**63, own).astype(np.uint64)])) for _ in range(2))
        r = n.registers([a, b, np.unique(np.concatenate([a, b]))])
        j = n.estimate(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(j - shared / (shared + 2 * own)) < 0.13
        assert (np.maximum(r[0], r[1]) == r[2]).all()  # sketches merge


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)]
    root = {x: x for p in pairs for x in p}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


def test_edges(edges, nothing):
    got = n.near_duplicates(edges).collect()
    assert len(got) == len(EDGES) and n.near_duplicates(nothing).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert all(by[k]["kept"] and by[k]["n_shingles"] == 0 for k in (2, 3, 4))
    assert by[5]["n_shingles"] == 59_996


def exact(rows, percent):
    """The components of documents (id, text) at a threshold, by counting all pairs."""
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    pairs = [(a, b) for b in sets for a in sets if a < b and (s := len(sets[a] & sets[b])) and 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s)]
    root = {i: i for i in sets}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_threshold_of_80(make):
    """Sets of 4 and 5, and of 5 and 6 shingles, and longer texts of similarity 0.80 to 0.85, link at 80."""
    rows = texts()
    at = len(rows)
    for n_ in (4, 5):
        w = [f"s{n_}x{k}" for k in range(n_ + 5)]
        rows += [(at, " ".join(w[:-1])), (at + 1, " ".join(w))]
        at += 2
    for k in range(30):
        w = [f"d{k}x{j}" for j in range(64 + k)]
        rows += [(at, " ".join(w)), (at + 1, " ".join([*w[:20], "new", *w[21 : 52 - k // 10], *w[53 - k // 10 :], *(f"e{k}x{j}" for j in range(k % 3))]))]
        at += 2
    want = exact(rows, 80)
    got = {r["doc_id"]: r["component_id"] for r in n.near_duplicates(make([(i, t, None, None) for i, t in rows]), percent=80).collect()}
    assert got == want and sum(want[i] != x for i, x in exact(rows, 85).items()) > 10
    assert (n.least_set(85), n.band_rows(85), n.margin(85)) == (6, 7, 13) and (n.least_set(80), n.margin(80)) == (4, 15)
    assert all((1 - (p / 100) ** n.band_rows(p)) ** (n.REGISTERS // n.band_rows(p)) <= n.MISSED for p in (80, 85))
