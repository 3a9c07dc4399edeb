import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, key string, size long, pattern string, `range` long, members string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with those that operators use."""

    def of(rows):
        full = [(i, t, g, s, len(t) if t is not None else None, 1, 2, "k", 3, None, 4, "m") for i, t, g, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


LONG = " ".join(f"w{k % 997}x{k}" for k in range(60_000))
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here at once.\nA second line that is long enough to count.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t\n ", None, "b"),
    (5, LONG, "en", None),
    (6, "one two", "fr", "b"),
    (6, "one two", "fr", "b"),
    (7, "one two", "fr", "c"),
    (None, "the id of this text is null\nand it has two lines of some length", "en", "a"),
    (8, "日本語のテキスト 😀 é", None, "c"),
]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
