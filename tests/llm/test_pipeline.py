import os

import pytest

import corpus_pipeline as c
from cairnlake.llm.common import spool

DATA = os.environ.get("CAIRNLAKE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    """Each stage keeps the columns, works on what came before, and what it keeps follows from its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(c.STAGES):
        before = docs
        docs = spool(stage(spark, docs, DATA), f"test-{name}")
        seen[name] = docs.count()
        assert seen[name] > 0
        if k + 1 < len(c.STAGES):
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if name == "near_dedup":
            from .test_neardup import exact

            want = {i for i, r in exact([(r["doc_id"], r["text"]) for r in before.collect()], c.NEAR_PERCENT).items() if i == r}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "packing":
            words = sum(len((r["text"] or "").encode().split()) for r in before.collect())
            assert sum(r["length"] for r in docs.collect()) == words
    assert [n for n, _ in c.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_handles_nothing(spark, nothing, tmp_path):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_registered_queries(spark):
    from cairnlake.llm import queries as q

    assert {k.split("_")[0] for k in q.queries() if k.startswith("op")} == {f"op{n}" for n in range(1, 11)}


def test_near_dedup_counts_at_80(spark, make):
    """A copy of similarity 0.80 to 0.85 goes, and what is under 0.80 stays."""
    from .test_neardup import exact

    w = [f"w{k}" for k in range(64)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:30], "x", *w[31:-2]])), (3, " ".join([*w[:20], "y", *w[21:40], "z", *w[41:]])), (4, "one two three four five six seven eight"), (5, "one two three four five six seven eight nine")]
    docs = make([(i, t, "en", "a") for i, t in rows])
    want = {i for i, r in exact(rows, 80).items() if i == r}
    assert want != {i for i, r in exact(rows, 85).items() if i == r}
    assert {r["doc_id"] for r in c.one_of_each_group(spark, docs, "").collect()} == want


def test_mixing_keeps_rows_without_id(spark, make):
    """What the stage returns is what the mix takes, also of rows whose id is null or repeated."""
    rows = [(None if k % 3 == 0 else k // 2, " ".join(f"w{k}x{j}" for j in range(1 + k % 7)), "en", f"s{k % 4}") for k in range(120)]
    docs = make(rows)
    taken = c.mixing.mix(docs, lambda k: 1 + k % 3, whole_only=True).collect()
    got = c.mixed(spark, docs, "").collect()
    words = lambda found: sum(len(r["text"].split()) for r in found)
    for null in (True, False):
        assert words(r for r in got if (r["doc_id"] is None) == null) == sum(r["taken"] for r in taken if (r["doc_id"] is None) == null) > 0
    assert {r["text"] for r in got} <= {t for _, t, _, _ in rows} and len(got[0]) == len(docs.columns)
    counts = [[r["text"] for r in got].count(t) for _, t, _, _ in rows]
    assert all(0 <= n <= c.mixing.MAX_EPOCHS for n in counts)


def test_line_dedup_whatever_the_share(spark, make):
    """Pages that mostly consist of repeated lines lose them; copies, equal or near, stay whole for near-dedup."""
    line = lambda x, n=60: " ".join(f"{x}{k}" for k in range(n))  # noqa: E731  over 200 characters
    own = "a short line of its own words"
    whole = [line("p"), line("q"), line("r")]
    near = [line("p").replace("p20 p21", "new word"), *whole[1:]]
    rows = [
        (1, f"{line('boiler')}\n{line('plate')}\n{line('first')}\n{line('more')}"),
        (2, f"{line('boiler')}\n{own}\n{line('plate')}"),
        (3, "\n".join([*whole, line("boiler")])),
        (4, "\n".join([*whole, line("boiler")])),
        (5, "\n".join([*near, line("boiler")])),
        (6, f"{line('q')}\n{line('other', 60)}\n{line('other', 60)}"),
        (7, line("first")),
        (None, line("first")),
    ]
    got = {r["doc_id"]: r["text"] for r in c.without_repeated_lines(spark, make([(i, t, "en", "a") for i, t in rows]), "").collect()}
    want = dict(rows) | {2: own, 3: "\n".join(whole), 4: "\n".join(whole), 5: "\n".join(near), 6: line("other", 60)}
    del want[7]
    assert got == want
