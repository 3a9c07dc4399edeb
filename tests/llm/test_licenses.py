import random

import pytest

from cairnlake.llm import licenses as x

from .conftest import EDGES


def test_alignment_is_valid_and_finds_equal_texts():
    rnd = random.Random(1)
    for _ in range(200):
        a = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(15))]
        b = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(15))]
        got = x.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert len(x.align(a, a)) == len(a)


def test_templates_are_found_anywhere():
    rnd = random.Random(2)
    known = {k: x.words(t) for k, t in x.TEMPLATES.items()}
    noise = lambda n: [rnd.choice(["the", "of", "license", "under", "version", "zed", "and", "to"]) for _ in range(n)]
    for name, t in known.items():
        found = x.scan(noise(150) + t + noise(150) + t + noise(20), known)
        own = [h for h in found if h[0] == name]
        assert len(own) >= 2 and own[0][1] == 1.0, name


@pytest.mark.parametrize("name", sorted(x.TEMPLATES))
def test_as_many_hits_as_copies(name):
    """Copies side by side, with few or no other words between, whole, cut short, changed or with words added."""
    rnd = random.Random(name)
    t = x.words(x.TEMPLATES[name])
    vocab = ["the", "of", "license", "under", "version", "zed", "and", "to", "software", "a"]
    for _ in range(25):
        copies, words = rnd.randint(1, 4), [rnd.choice(vocab) for _ in range(rnd.randint(0, 6))]
        starts = []
        for _ in range(copies):
            own, mode = list(t), rnd.randrange(4)
            if mode == 1 and len(t) >= 10:
                own = own[: len(own) - len(own) // 10]  # the next copy overlaps where this one would go on
            for _ in range(len(t) // 10):
                if mode == 2:
                    own[rnd.randrange(len(own))] = "changed"
                elif mode == 3:
                    own.insert(rnd.randrange(1, len(own)), "extra")
            starts.append(len(words))
            words += own + [rnd.choice(vocab) for _ in range(rnd.randint(0, 6))]
        got = sorted(h[2:] for h in x.scan(words, {name: t}))
        assert len(got) == copies
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(abs(h[0] - s) <= max(8, len(t) // 5) for h, s in zip(got, starts, strict=True))


def brute(words, t, need):
    """The most words of t that a stretch of ``words`` without large gaps can align, over all stretches."""
    best = {}
    for p, w in enumerate(words):
        for q, v in enumerate(t):
            if w == v:
                before = [best[r, s] for r in range(max(0, p - x.MAX_GAP - 1), p) for s in range(q) if (r, s) in best]
                best[p, q] = 1 + max(before, default=0)
    return max(best.values(), default=0) >= need


def test_against_brute_force():
    """What is found is there; of copies with words left out and foreign words added, none is missed.

    Where the template's own words stand again in or beside a copy, patience may align fewer words than the best alignment.
    """
    rnd = random.Random(7)
    hits = 0
    for trial in range(400):
        clean = trial % 2 == 0
        t = [f"w{k}" for k in range(rnd.randint(4, 12))]
        own = [w for w in t if rnd.random() < 0.9]
        for _ in range(rnd.randrange(4)):
            own.insert(rnd.randint(0, len(own)), "y" if clean else rnd.choice(t))
        words = [rnd.choice(["y", "z"] if clean else ["y", *t[:2]]) for _ in range(rnd.randrange(20))] + own + [rnd.choice(["y", "z"]) for _ in range(rnd.randrange(20))]
        need = -(-8 * len(t) // 10)
        got = x.scan(words, {"t": t})
        assert not got or brute(words, t, need)
        assert got or not (clean and brute(words, t, need))
        hits += bool(got)
    assert hits > 100


def test_small_changes_are_tolerated_and_prose_is_left_alone():
    known = {k: x.words(t) for k, t in x.TEMPLATES.items()}
    t = list(known["MIT"])
    for k in (5, 30, 60):
        t[k] = "changed"
    got = x.scan(["noise"] * 40 + t, known)
    assert got[0][0] == "MIT" and 0.9 < got[0][1] < 1
    assert x.scan(x.words("the license of the software is under the terms of a public version, and so on and on"), known) == []


def test_edges(edges, nothing, make):
    got = x.find(edges).collect()
    assert len(got) == len(EDGES) and all(r["license"] is None and r["n_hits"] == 0 for r in got)
    assert x.find(nothing).count() == 0
    r = x.find(make([(1, "a b c\nReleased under the MIT License.\nd", None, None)])).first()
    assert (r["license"], r["coverage"], r["hits"][0]["first"], r["hits"][0]["last"]) == ("MIT-notice", 1.0, 3, 7)
