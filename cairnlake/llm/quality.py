"""Quality rules: gradient-boosted trees over document statistics.

The statistics are exact counts over whole texts. The trees are grown by histogram
with a logistic loss and monotonic constraints, flattened into numpy node arrays, and
scored for a whole Arrow batch at a time.

Defined results: null and empty texts have zero counts and fail the base rule; repeated
rows and repeated ids are judged row by row; of rows of one labelled id the least text is learned from; very long texts are counted
whole; a score exactly at the threshold is kept, and equal hashes of ids are ordered by id; an empty table gives an empty result; with
no usable labels the trees are a constant that accepts; other columns, whatever their
names, are passed through by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import slices

#: Statistics the trees see, with the sign of the effect each may have on quality (0: free).
FEATURES: dict[str, int] = {
    "log_words": 0, "mean_word": 0, "max_word": -1, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "top_word_share": -1, "upper_share": -1, "digit_share": -1, "punct_share": 0, "line_words": 0,
    "non_ascii_share": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Labelled rows a model is fitted on, at most: those of lowest hash of their id.
TRAIN_ROWS = 20_000
#: Documents scored under this are rejected.
MIN_SCORE = 0.5
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def _repeated(ids: np.ndarray, n_distinct: int) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    v = np.int64(max(n_distinct, 1))
    pair = ids[:-1] * v + ids[1:]
    if n_distinct > 2_000_000:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * v + ids[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, window)
    hit = twice[np.minimum(at, len(twice) - 1)] == window
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES for one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(of_byte[128:192].sum())
    word_chars = chars - int(of_byte[_SPACES].sum())
    symbols = int(of_byte[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in found), np.int64, n)
    repeat = _repeated(ids, len(code))
    upper, digits = int(of_byte[65:91].sum()), int(of_byte[48:58].sum())
    letters = upper + int(of_byte[97:123].sum())
    punct = int(of_byte[33:127].sum()) - letters - digits
    return [n, word_chars, symbols, dup_lines, repeat], [
        float(np.log1p(n)), word_chars / n, float(max(map(len, code))), symbols / n, dup_lines / max(1, len(lines)), repeat / n,
        len(code) / n, float(np.bincount(ids).max()) / n, upper / max(1, letters), digits / word_chars, punct / word_chars, n / max(1, len(lines)),
        int(of_byte[192:].sum()) / max(1, word_chars),
    ]


@dataclass
class Trees:
    """Trees as flat node arrays; a leaf is its own child, so that every row takes the same number of steps."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], *, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``rounds`` trees. ``signs``: +1 or -1 where the score may only rise or fall with the feature."""
    positive = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    base = float(np.log(positive / (1 - positive)))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
        total = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            total += rate * _grow(nodes, binned, edges, g, h, signs, depth, rate, ridge, least)
    flat = np.array(nodes or [[0, 0, 0, 0, 0]], float)
    return Trees(base, flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], np.array(roots, np.int64), depth)


def _grow(nodes, binned, edges, g, h, signs, depth, rate, ridge, least) -> np.ndarray:
    out = np.zeros(len(g))

    def weight(gs, hs, low, high):
        return np.clip(-gs / (hs + ridge), low, high)

    def gain(gs, hs, w):
        return -(gs * w + 0.5 * (hs + ridge) * w * w)

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        w = float(weight(gs, hs, low, high))
        nodes.append([0, np.inf, me, me, rate * w])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            own = gain(gs, hs, w)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, k]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                wl, wr = weight(gl, hl, low, high), weight(gs - gl, hs - hl, low, high)
                won = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - own
                won[(nl < least) | (len(rows) - nl < least) | (signs[k] * (wr - wl) < 0)] = -np.inf
                at = int(np.argmax(won))
                if won[at] > best[0]:
                    best = (float(won[at]), k, at, float(wl[at]), float(wr[at]))
        _, k, at, wl, wr = best
        if k < 0:
            out[rows] = w
            return me
        under = binned[rows, k] <= at
        middle = (wl + wr) / 2
        rising, falling = signs[k] > 0, signs[k] < 0
        a = build(rows[under], level + 1, middle if falling else low, middle if rising else high)
        b = build(rows[~under], level + 1, middle if rising else low, middle if falling else high)
        nodes[me] = [k, float(edges[k][at]), a, b, rate * w]
        return me

    build(np.arange(len(g)), 0, -np.inf, np.inf)
    return out


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents, taken by the hash of their id."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.mapInArrow(measure, "doc_id long, y int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float), list(FEATURES.values()))


def _judged(texts: list[str | None], trees: Trees, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, 5)
    score = trees.score(np.array([x for _, x in both], float).reshape(-1, len(FEATURES)))
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    return counts, score, failed, ~failed & (score >= min_score)


def judge(docs: DataFrame, trees: Trees, *, min_score: float = MIN_SCORE) -> DataFrame:
    """A row for each document: counts, the base rule, the trees' score and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, score, failed, kept = _judged(b.column("text").to_pylist(), trees, min_score)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees, *, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept = _judged(b.column(b.schema.names.index("text")).to_pylist(), trees, min_score)[3]
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
