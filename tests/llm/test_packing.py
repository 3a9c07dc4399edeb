import random

from cairnlake.llm import packing as k

from .conftest import EDGES


def check(lengths, pieces, caps, permitted):
    for n, length in enumerate(lengths):
        own = sorted((s, x) for i, s, x, _, _ in pieces if i == n)
        assert sum(x for _, x in own) == length and all(s == sum(x for _, x in own[:j]) for j, (s, _) in enumerate(own))
    for b, cap in enumerate(caps):
        own = sorted((at, x) for _, _, x, c, at in pieces if c == b)
        fill = 0
        for at, x in own:
            assert at == fill
            fill += x
        assert cap in permitted and fill <= cap and not any(fill <= c < cap for c in permitted)


def test_packs_are_valid_and_tight():
    rnd = random.Random(1)
    for permitted in ((16,), (8, 16, 64), (512, 1024, 2048, 4096, 8192)):
        for _ in range(10):
            lengths = [min(20_000, int(rnd.lognormvariate(3.5, 1.4))) for _ in range(400)]
            pieces, caps = k.pack(lengths, permitted)
            check(lengths, pieces, caps, permitted)
    assert sum(lengths) / sum(caps) > 0.93
    assert k.pack([], (8,)) == ([], [])


def test_more_sizes_cost_no_more():
    rnd = random.Random(5)
    lengths = [rnd.randrange(1, 3000) for _ in range(500)]
    total = lambda permitted: sum(k.cost(c) for c in k.pack(lengths, permitted)[1])
    assert total((512, 1024, 2048, 4096)) <= total((4096,))


def best(lengths, permitted):
    """The least cost of any packing, by trying all partitions of the pieces into bins."""
    pieces = [p for n in lengths for p in [max(permitted)] * (n // max(permitted)) + ([n % max(permitted)] if n % max(permitted) else [])]
    least = [float("inf")]

    def put(i, bins):
        if i == len(pieces):
            least[0] = min(least[0], sum(k.cost(min(c for c in permitted if c >= b)) for b in bins))
            return
        for j in range(len(bins) + 1):
            if j == len(bins):
                put(i + 1, [*bins, pieces[i]])
            elif bins[j] + pieces[i] <= max(permitted) and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + pieces[i], *bins[j + 1 :]])

    put(0, [])
    return least[0]


def test_against_brute_force():
    """On tiny inputs no packing is cheaper than the best of all, and few are much dearer."""
    rnd = random.Random(8)
    ratios = []
    for permitted in ((16,), (8, 16), (512, 1024, 2048)):
        for _ in range(40):
            lengths = [rnd.randint(1, max(permitted) + max(permitted) // 4) for _ in range(rnd.randint(1, 7))]
            pieces, caps = k.pack(lengths, permitted)
            check(lengths, pieces, caps, permitted)
            ratios.append(sum(map(k.cost, caps)) / best(lengths, permitted))
    assert min(ratios) > 0.999999 and max(ratios) < 1.5 and sum(r < 1.000001 for r in ratios) > 0.8 * len(ratios)


def test_documents(make, edges, nothing):
    rnd = random.Random(3)
    rows = [(j, "w " * rnd.randrange(700), None, None) for j in range(120)]
    got = k.pack_documents(make(rows), capacities=(128, 512), shard_rows=25).collect()
    words = {j: len(t.split()) for j, t, _, _ in rows}
    for j, n in words.items():
        assert sum(r["length"] for r in got if r["doc_id"] == j) == n
    fill = {}
    for r in got:
        if r["bin_id"] is not None:
            fill[r["bin_id"], r["capacity"]] = fill.get((r["bin_id"], r["capacity"]), 0) + r["length"]
    assert all(n <= c for (_, c), n in fill.items()) and len({b for b, _ in fill}) == len(fill)
    got = k.pack_documents(edges).collect()
    assert len([r for r in got if r["doc_id"] != 5]) == len(EDGES) - 1
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 60_000
    assert k.pack_documents(nothing).count() == 0
