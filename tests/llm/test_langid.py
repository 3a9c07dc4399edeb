import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import langid as g

from .conftest import EDGES

SYLLABLES = {"aa": ["ta", "ki", "mo", "ru"], "bb": ["sch", "ung", "er", "lich"], "cc": ["что", "ный", "ова"]}


def say(lang, n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(make):
    rnd = random.Random(4)
    docs = make([(k, say(x, 60, rnd), x, "s") for k, x in enumerate(["aa", "bb", "cc"] * 30)])
    return g.train(docs, F.lit(True))


def test_held_out(model):
    rnd = random.Random(9)
    for lang in SYLLABLES:
        for _ in range(20):
            assert g.label([g.words(say(lang, 12, rnd))], model)[0][0] == lang


def test_mixed_texts_are_cut_into_spans(model):
    rnd = random.Random(2)
    found = g.words(say("aa", 30, rnd) + " " + say("bb", 20, rnd) + " " + say("cc", 10, rnd))
    lang, score, spans = g.label([found], model)[0]
    assert [s["lang"] for s in spans] == ["aa", "bb", "cc"] and abs(spans[0]["last"] - 29) <= 1
    assert lang in SYLLABLES and 0 < score < 1


def test_words_are_letters_with_their_marks():
    assert g.words("हिन्दी भाषा x² ½ ¼ a1b2 _c_ l'été e\u0301a") == ["हिन्दी", "भाषा", "x", "a", "b", "c", "l", "été", "e\u0301a"]
    assert g.words("² ½ ¼ 123 _ \u0301 !") == []
    assert all(g.words(c) == ([c.lower()] if c.isalpha() else []) for c in map(chr, range(0x3000)) if len(c.lower()) == 1)


def test_rare_languages_are_learned(make):
    rnd = random.Random(8)
    rows = [(k, say("aa", 8, rnd), "aa", "s") for k in range(300)] + [(1000 + k, say("bb", 8, rnd), "bb", "s") for k in range(6)]
    small = g.train(make(rows), F.lit(True), rows=40)
    assert small.langs == ["aa", "bb"]
    assert all(g.label([g.words(say(x, 20, rnd))], small)[0][0] == x for x in ("aa", "bb") for _ in range(10))


def test_words_that_are_kept_score_the_same(model):
    rnd = random.Random(6)
    texts = [g.words(say(rnd.choice("abc") * 2, rnd.randint(0, 40), rnd)) for _ in range(40)]
    scorer = g.Scorer(model, most=10)
    assert [g.label([t], model, scorer)[0] for t in texts] == g.label(texts, model)


def test_viterbi_against_brute_force():
    rnd = np.random.default_rng(0)
    counts = np.array([3, 5, 1, 4])
    scores = rnd.normal(size=(counts.sum(), 3)) * 3
    first = np.cumsum(counts) - counts
    got = g.viterbi(scores, first, counts, 1.5)
    import itertools

    for a, n in zip(first, counts, strict=True):
        value = lambda p, a=a: sum(scores[a + k, x] for k, x in enumerate(p)) - 1.5 * sum(x != y for x, y in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert abs(value(tuple(got[a : a + n])) - value(best)) < 1e-9


def test_one_label_is_what_viterbi_gives():
    rnd = np.random.default_rng(1)
    proven = 0
    for _ in range(400):
        n, k = int(rnd.integers(1, 12)), int(rnd.integers(1, 5))
        scores = rnd.normal(size=(n, k)) + rnd.normal(size=k) * 2
        top = g.one_label(scores, 2.0)
        if top is not None:
            proven += 1
            assert (g.viterbi(scores, np.array([0]), np.array([n]), 2.0) == top).all()
    assert 100 < proven < 400


def test_edges(edges, nothing, make, model):
    got = {r["doc_id"]: r for r in g.identify(edges, model).collect()}
    assert len(g.identify(edges, model).collect()) == len(EDGES)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4))
    assert got[8]["lang_pred"] in SYLLABLES
    marks = g.identify(make([(1, "½ ² ¼", None, None), (2, "\u0301 1", None, None)]), model).collect()
    assert [r["lang_pred"] for r in marks] == ["und", "und"]
    assert g.identify(nothing, model).count() == 0
    empty = g.train(nothing, F.lit(True))
    assert {r["lang_pred"] for r in g.identify(edges, empty).collect()} == {"und"}


def test_mixed_texts_of_several_blocks_are_walked_together(model, monkeypatch):
    """Walks cost by the step of their longest text: blocks share one, also where the scorer forgets its words, and results stay in order."""
    rnd = random.Random(12)
    texts = [g.words(" ".join(say(x, rnd.randint(5, 30), rnd) for x in rnd.choice([["aa"], ["aa", "bb"], ["bb", "cc", "aa"], ["cc", "bb"]]))) for _ in range(60)] + [[]]
    want = [g.label([t], model)[0] for t in texts]
    assert sum(len(x[2]) > 1 for x in want) > 20
    walk, calls = g.viterbi, []
    monkeypatch.setattr(g, "viterbi", lambda *x, **y: calls.append(1) or walk(*x, **y))
    labels = g.Labels(model)
    for k in range(0, len(texts), 4):
        labels.add(texts[k : k + 4])
    assert labels.take() == want and len(calls) == 1 and labels.take() == []
    few = g.Labels(model, g.Scorer(model, most=10))
    for k in range(0, len(texts), 4):
        few.add(texts[k : k + 4])
    assert few.take() == want


def test_words_with_and_without_wide_letters():
    """Letters over 16 bits are words too; a text without them is read by a pattern without their ranges."""
    assert g.words("ab \U00010400\U00010428x 中\U00020000 9") == ["ab", "\U00010428\U00010428x", "中\U00020000"]
    assert g.words("ab \ud800 é") == ["ab", "é"]
    wide, narrow = g._word(0x10FFFF), g._word(0xFFFF)
    text = "".join(map(chr, range(0x10000)))
    assert wide.findall(text) == narrow.findall(text)


def test_identify_labels_each_row(model, make):
    rnd = random.Random(3)
    docs = make([(k, say("aa", 5, rnd) + " " + say("bb", k % 9, rnd), None, "s") for k in range(50)])
    want = {r["doc_id"]: g.label([g.words(r["text"])], model)[0] for r in docs.collect()}
    got = g.identify(docs, model).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"], [x.asDict() for x in r["spans"]]) for r in got} == want and len(got) == 50
