import random

from pyspark.sql import functions as F

from cairnlake.llm import mixing as m

from .conftest import EDGES


def test_targets_share_the_excess():
    got = m.targets({"a": 10, "b": 1000, None: 1000}, 2010, lambda k: 1 + k % 3)
    assert got["a"] == 30 and abs(sum(got.values()) - 2010) < 1e-9
    assert abs(got[None] / got["b"] - 3 / 2) < 1e-9
    assert m.targets({}, 0, lambda k: 1) == {} and m.targets({"a": 0}, 0, lambda k: 1) == {"a": 0}


def brute_cost(patterns, quotas, taken, epochs):
    """Least cost of meeting quotas, by trying all splits of small instances."""
    import itertools

    best = None
    for give in itertools.product(*(range(epochs * size + 1) for _, size in patterns)):
        if not feasible(patterns, quotas, give):
            continue
        c = cost(patterns, give)
        best = c if best is None else min(best, c)
    return best


def cost(patterns, give):
    return sum((k // size + 1) ** 2 for (_, size), g in zip(patterns, give, strict=True) for k in range(g))


def feasible(patterns, quotas, give):
    from itertools import combinations

    for r in range(len(quotas) + 1):  # Hall's condition, both ways
        for s in combinations(quotas, r):
            need = sum(quotas[x] for x in s)
            if need > sum(g for (mem, _), g in zip(patterns, give, strict=True) if set(mem) & set(s)):
                return False
    return sum(give) == sum(quotas.values())


def test_route_is_cheapest():
    rnd = random.Random(3)
    for _ in range(40):
        patterns = [(m_, rnd.randint(1, 3)) for m_ in (("a",), ("a", "b"), ("b", "c"))]
        quotas = {"a": rnd.randint(0, 4), "b": rnd.randint(0, 4), "c": rnd.randint(0, 3)}
        got = m.route(patterns, quotas, 2)
        assert all(g <= 2 * size for g, (_, size) in zip(got, patterns, strict=True))
        want = brute_cost(patterns, quotas, got, 2)
        if want is not None:
            assert sum(got) == sum(quotas.values()) and cost(patterns, got) == want


def test_quotas_are_met_exactly(make):
    rnd = random.Random(7)
    rows = [(k, " ".join(["w"] * rnd.randrange(30)), None, rnd.choice(["a", "a", "a", "b", None])) for k in range(400)]
    got = m.mix(make(rows), lambda k: 1 + k % 3).collect()
    again = m.mix(make(rows[::-1]), lambda k: 1 + k % 3).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    source = {i: s for i, _, _, s in rows}
    words = {i: len(t.split()) for i, t, _, _ in rows}
    for s in ("a", "b", None):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["source_size"] == sum(words[r["doc_id"]] for r in own)
    assert all(r["size"] == words[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in got)
    whole = m.mix(make(rows), lambda k: 1 + k % 3, whole_only=True).collect()
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in whole)
    assert abs(sum(r["taken"] for r in whole) - sum(words.values())) <= 3 * 30


def test_overlapping_sources(make):
    rows = [(k, "w " * 10, None, "abc"[k % 3]) for k in range(90)]
    members = F.when(F.col("source") == "c", F.array(F.lit("x"), F.lit("y"))).when(F.col("source") == "a", F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    got = m.mix(make(rows), lambda k: 1.0, members=members).collect()
    assert sum(r["taken"] for r in got) == 900


def test_edges(edges, nothing):
    got = m.mix(edges, lambda k: 1 + k % 3).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert m.mix(nothing, lambda k: 1).count() == 0
