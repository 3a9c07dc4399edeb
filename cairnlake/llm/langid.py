"""Language identification of mixed text.

Words are runs of letters with the marks that follow them. The script of a word narrows its candidates to the languages learned
in that script. Character n-grams and the word itself score it for each language; Viterbi
with a switching penalty then labels the words of the whole text, so that spans of several
languages come out. The language of most letters is the prediction, its share the score.

The scores are learned from a bounded sample of labelled documents, dealt evenly to the languages so that rare ones are
learned too, and kept in a table of hashed features for each language, of ``TABLE_CELLS`` numbers at most in all. The table is
broadcast. A worker scores each distinct word once while its ``CACHED_WORDS`` hold it.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated
rows are labelled row by row; very long texts are labelled whole, in memory that grows with their words by some bits for each
language; of languages with equally many letters the first by name is the prediction; with nothing to learn from, all are ``und``; rows with a null id are
labelled but not learned from by the registered query; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import slices

#: Labelled documents that are learned from, at most.
TRAIN_DOCS = 20_000
#: Hashed features of a language, and numbers of the whole table at most: with very many languages each has fewer features.
BUCKETS, TABLE_CELLS = 1 << 17, 1 << 27
#: Distinct words of which a worker keeps the scores.
CACHED_WORDS = 200_000
#: Log-odds that a change of language between two words costs.
SWITCH = 8.0
#: What a word's score can speak for or against a language, at most.
CLIP = 12.0
#: A language is a candidate in a script that so much of its letters are in.
SCRIPT_SHARE = 0.01
#: Letters scored at a time.
BLOCK_CHARS = 2_000_000
#: Texts whose labels a worker holds until it walks those that need it and returns them all: until they have so many words, or are so many.
HELD_WORDS, HELD_ROWS = 4_000_000, 16_384

# First and last code point of ranges of letters, and their script.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
)
_FIRST = np.array([a for a, _, _ in SCRIPTS])
_LAST = np.array([b for _, b, _ in SCRIPTS])
_NAMES = sorted({s for _, _, s in SCRIPTS})
_CODE = np.array([_NAMES.index(s) for _, _, s in SCRIPTS])
OTHER = len(_NAMES)


@cache
def _word(last: int) -> re.Pattern:
    """A letter, and all letters and marks that follow it, of code points up to ``last``."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(last + 1)]

    def ranges(of: str) -> str:
        out, c = [], 0
        while c < len(kinds):
            if kinds[c] in of:
                end = c
                while end + 1 < len(kinds) and kinds[end + 1] in of:
                    end += 1
                out.append(f"\\U{c:08x}-\\U{end:08x}")
                c = end
            c += 1
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


_P1, _P2, _P3, _P4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def words(text: str | None) -> list[str]:
    """The words of a text. Ranges over 16 bits are tried one by one at each end of a word, so texts without such code points do without."""
    if not text:
        return []
    lower = text.lower()
    wide = not lower.isascii() and len(lower.encode("utf-16-le", "surrogatepass")) > 2 * len(lower)
    return _word(sys.maxunicode if wide else 0xFFFF).findall(lower)


def _script(code_points: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_FIRST, code_points, side="right") - 1
    inside = (at >= 0) & (code_points <= _LAST[np.maximum(at, 0)])
    return np.where(inside, _CODE[np.maximum(at, 0)], OTHER)


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of a list of words and the word of each; the script and the length of each word.

    Features are pairs and triples of characters with the word's bounds, and the word.
    """
    joined = " " + " ".join(found) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = c == 32
    word = np.cumsum(space) - 1
    inner = np.flatnonzero(~space)
    two = c[inner - 1] * _P1 + c[inner] * _P2 + np.uint64(2)
    three = two * _P3 + c[inner + 1] * _P1 + np.uint64(3)
    starts = np.flatnonzero(space[:-1]) + 1
    lengths = np.diff(np.append(starts, len(c))) - 1
    mixed = (c[inner] + np.uint64(7)) * _P4 * (inner - starts[word[inner]] + 1).astype(np.uint64)
    whole = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * _P3, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    h = np.concatenate([two, three, whole])
    h = (h ^ (h >> np.uint64(31))) * _P2
    h = ((h ^ (h >> np.uint64(33))) >> np.uint64(20)) % np.uint64(BUCKETS)
    return h.astype(np.int64), np.concatenate([word[inner], word[inner], np.arange(len(found))]), _script(c[starts].astype(np.int64)), lengths


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  #: (languages, features): log-probability of a feature over its mean for all languages
    allowed: np.ndarray  #: (scripts + 1, languages)

    def score(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, and the words' lengths."""
        h, word, script, lengths = features(found)
        h &= self.logs.shape[1] - 1
        out = np.stack([np.bincount(word, row[h], len(found)) for row in self.logs], 1)
        out = np.clip(out - out.max(1, keepdims=True), -CLIP, 0)
        return np.where(self.allowed[script], out, -2 * CLIP), lengths


class Scorer:
    """Scores of words, each computed once while it is kept."""

    def __init__(self, model: Model, most: int = CACHED_WORDS) -> None:
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__  # a new word is the next row
        self.rows = np.empty((0, len(self.model.langs)), np.float32)
        self.lengths = np.empty(0, np.int64)

    def ids(self, found: list[list[str]]) -> np.ndarray:
        """Rows of ``self.rows`` for the words of all texts, one after the other; valid until the next call."""
        if len(self.code) > self.most:
            self._clear()
        code = self.code
        old = len(code)
        out = np.fromiter(map(code.__getitem__, chain.from_iterable(found)), np.int32)
        fresh = islice(code, old, None)
        rows, lengths = [self.rows], [self.lengths]
        while part := list(islice(fresh, 100_000)):
            scores, n = self.model.score(part)
            rows.append(scores.astype(np.float32))
            lengths.append(n)
        if len(rows) > 1:
            self.rows, self.lengths = np.concatenate(rows), np.concatenate(lengths)
        return out


def train(docs: DataFrame, usable: Column, *, rows: int = TRAIN_DOCS) -> Model:
    """Learn from ``rows`` documents at most of those that are ``usable`` and have a text and a language: equally many of each language, as far as it has them, by hash."""
    known = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.xxhash64("lang"), "lang").limit(rows)
    sizes = counted.toArrow().sort_by("lang")  # a row for each language, at most ``rows``
    quota = max(1, rows // max(1, sizes.num_rows))
    rates = [(x, min(1.0, (quota + 4 * quota**0.5 + 8) / n)) for x, n in zip(*(sizes[c].to_pylist() for c in ("lang", "n")), strict=True)]
    if not rates:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.ones((OTHER + 1, 0), bool))
    drawn = known.join(F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double")), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # over the quota and a few of each language
    sample = drawn.withColumn("place", place).where(F.col("place") <= quota).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                of.setdefault(lang, []).extend(words(text))
            for lang, found in of.items():
                for k in range(0, len(found), 200_000):
                    h, _, script, lengths = features(found[k : k + 200_000])
                    n = np.concatenate([np.bincount(h, minlength=BUCKETS), np.bincount(script, lengths, OTHER + 1).astype(np.int64)])
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "at", "n"])

    got = sample.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    lang, at, n = (got[c].to_numpy() for c in ("lang", "at", "n"))
    langs = sorted(set(lang.tolist()))
    buckets = min(BUCKETS, 1 << max(8, (TABLE_CELLS // max(1, len(langs))).bit_length() - 1))
    counts, scripts = np.zeros((len(langs), buckets), np.float32), np.zeros((len(langs), OTHER + 1))
    row = np.searchsorted(np.array(langs, object), lang) if langs else np.empty(0, int)
    word = at < BUCKETS
    np.add.at(counts, (row[word], at[word] & (buckets - 1)), n[word])
    np.add.at(scripts, (row[~word], at[~word] - BUCKETS), n[~word])
    logs = np.log(counts + 0.5)
    logs -= np.log(counts.sum(1, keepdims=True, dtype=float) + 0.5 * buckets).astype(np.float32)
    logs -= logs.mean(0, keepdims=True) if langs else 0
    script = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    allowed = (script >= SCRIPT_SHARE).T
    return Model(langs, logs.astype(np.float32), np.where(allowed.any(1, keepdims=True), allowed, True))


def one_label(scores: np.ndarray, switch: float = SWITCH) -> int | None:
    """The label of all words, if the best path has only one, which this proves without walking it; else None.

    A path that leaves the label for a stretch of words gains there what other labels score more, and pays one switch at
    least. If no stretch gains as much as a switch costs, no such path is better.
    """
    top = int(scores.sum(0).argmax())
    if scores.shape[1] == 1:
        return top
    other = np.delete(scores, top, 1).max(1)
    gain = np.cumsum(other - scores[:, top], dtype=np.float64)
    most = (gain - np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))).max()
    return top if most < switch - 1e-6 else None


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, switch: float = SWITCH, ids: np.ndarray | None = None) -> np.ndarray:
    """The best label of each word of several texts at once.

    The words of text k are rows first[k] to first[k] + counts[k] of ``scores``, or the rows of it that ``ids`` names there. All texts take
    their t-th step together, longest first, so that those still running are a prefix. A bit for each word and label is kept.
    """
    ids = np.arange(len(scores)) if ids is None else ids
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    running = np.searchsorted(-counts, -np.arange(1, steps + 1), side="right")
    best = scores[ids[first]].astype(np.float64)
    stay = np.zeros((len(ids), -(-scores.shape[1] // 8)), np.uint8)
    other = np.zeros(len(ids), np.int32)
    for t in range(1, steps):
        rows = first[: running[t]] + t
        now = best[: running[t]]
        top = now.max(1)
        other[rows] = now.argmax(1)
        stay[rows] = np.packbits(now >= (top - switch)[:, None], axis=1)
        best[: running[t]] = np.maximum(now, (top - switch)[:, None]) + scores[ids[rows]]
    label = np.zeros(len(ids), np.int32)
    at = best.argmax(1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        rows = first[: running[t]] + t
        now = at[: running[t]]
        label[rows] = now
        if t:
            same = (stay[rows, now >> 3] >> (7 - (now & 7)).astype(np.uint8)) & 1
            at[: running[t]] = np.where(same, now, other[rows])
    return label


def _blocks(texts: list[str | None]) -> Iterator[list[list[str]]]:
    block, size = [], 0
    for t in texts:
        block.append(words(t))
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


class Labels:
    """(language, score, spans) of texts in the order in which they are added; those without one proved label are walked together.

    A walk takes as many steps as its longest text has words, and costs by the step where few texts are long.
    """

    def __init__(self, model: Model, scorer: Scorer | None = None) -> None:
        self.model, self.scorer = model, scorer or Scorer(model)
        self._clear()

    def _clear(self) -> None:
        self.done: list[tuple[str, float, list[dict]]] = []
        self.mixed: list[tuple[int, np.ndarray]] = []  # place in ``done`` and rows of the scorer
        self.words = 0

    def add(self, found: list[list[str]]) -> None:
        """Texts, given as their words."""
        langs, scorer, begin = self.model.langs, self.scorer, len(self.done)
        self.done += [("und", 0.0, [])] * len(found)
        full = [k for k, w in enumerate(found) if w]
        if not full or not langs:
            return
        if len(scorer.code) > scorer.most:
            self._walk()  # the scorer is about to forget its rows
        ids = scorer.ids([found[k] for k in full])
        self.words += len(ids)
        a = 0
        for k in full:
            n = len(found[k])
            own = ids[a : a + n]
            a += n
            if (top := one_label(scorer.rows[own])) is None:
                self.mixed.append((begin + k, own.copy()))
            else:
                self.done[begin + k] = langs[top], 1.0, [{"lang": langs[top], "first": 0, "last": n - 1}]

    def _walk(self) -> None:
        if not self.mixed:
            return
        langs, counts = self.model.langs, np.array([len(x) for _, x in self.mixed])
        ids, first = np.concatenate([x for _, x in self.mixed]), np.cumsum(counts) - counts
        labels = viterbi(self.scorer.rows, first, counts, ids=ids)
        chars = self.scorer.lengths[ids]
        for (k, _), a, n in zip(self.mixed, first.tolist(), counts.tolist(), strict=True):
            own = labels[a : a + n]
            share = np.bincount(own, chars[a : a + n], len(langs))
            top = int(share.argmax())
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            starts = [0, *cut.tolist()]
            spans = [{"lang": langs[own[s]], "first": s, "last": e - 1} for s, e in zip(starts, [*starts[1:], n], strict=True)]
            self.done[k] = langs[top], float(share[top] / share.sum()), spans
        self.mixed = []

    def take(self) -> list[tuple[str, float, list[dict]]]:
        """Those of all texts added since the last call."""
        self._walk()
        done = self.done
        self._clear()
        return done


def label(found: list[list[str]], model: Model, scorer: Scorer | None = None) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text, given as its words; spans hold the language, first and last word."""
    labels = Labels(model, scorer)
    labels.add(found)
    return labels.take()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        labels, ids = Labels(held.value), []

        def taken() -> pa.RecordBatch:
            got, doc_id = labels.take(), pa.concat_arrays(ids)
            ids.clear()
            return pa.RecordBatch.from_arrays([doc_id, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], span)], ["doc_id", "lang_pred", "score", "spans"])

        for b in slices(batches):
            for block in _blocks(b.column("text").to_pylist()):
                labels.add(block)
            ids.append(b.column("doc_id").cast(pa.int64()))
            if labels.words >= HELD_WORDS or len(labels.done) >= HELD_ROWS:
                yield taken()
        if ids:
            yield taken()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first: int, last: int>>")
