import random
import re

import numpy as np

from cairnlake.llm import quality as q

from .conftest import EDGES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_counts_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", "#", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "😀"]) for _ in range(rnd.randrange(120)))
        got = q.statistics(text)[0]
        want = brute(text)
        assert got == (want if want[0] else [0] * 5), repr(text)


def test_symbols_of_texts_without_words_are_none():
    assert q.statistics(" \n")[0] == [0] * 5


def test_many_distinct_words_use_the_wide_path():
    ids = np.array([1, 2, 3, 9, 1, 2, 3])
    assert q._repeated(ids, 3_000_000) == q._repeated(ids, 10) == 6


def test_trees_learn_and_keep_signs():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rnd.normal(size=3000)) > 0).astype(float)
    trees = q.fit(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.93
    for k, sign in ((0, 1), (1, -1)):
        grid = np.tile(rnd.normal(size=(50, 3))[:, None, :], (1, 40, 1))
        grid[:, :, k] = np.linspace(-3, 3, 40)
        s = trees.score(grid.reshape(-1, 3)).reshape(50, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-9).all()


def test_no_labels_accept():
    t = q.fit(np.empty((0, 3)), np.empty(0), [0, 0, 0])
    assert (t.score(np.zeros((2, 3))) > 0.5).all()


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (3, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    trees = q.train(edges, labels)
    got = q.judge(edges, trees).collect()
    assert len(got) == len(EDGES)
    assert {r["doc_id"]: r["n_words"] for r in got}[5] == 60_000
    assert all(not r["kept"] for r in got if r["doc_id"] in (2, 3, 4, 6))
    assert q.judge(nothing, q.train(nothing, labels.limit(0))).count() == 0
    kept = q.keep_good(edges, q.fit(np.empty((0, 13)), np.empty(0), [0] * 13))
    assert kept.columns == edges.columns and [r["doc_id"] for r in kept.collect()] == [5]
