"""Language of every text: script ranges, word scores and a Viterbi pass over the words."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDECIDED = "und"
_WORD, _LETTER = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_BUCKETS = 1 << 16  # letter n-grams are counted in so many hashed cells
_GRAMS = (1, 2, 3)
_KEPT = 1 << 18  # words whose scores a worker remembers
_CELLS = 1 << 21  # words times languages labelled at once, unless one text has more
#: First code points of script ranges and their scripts (fixed values of the Unicode blocks).
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x31350, "other"),
)
_STARTS = [start for start, _ in _RANGES]
_SCRIPTS = sorted({script for _, script in _RANGES})


def script_of(word: str) -> int:
    """Number of the script of the word's first letter."""
    return _SCRIPTS.index(_RANGES[bisect_right(_STARTS, ord(word[0])) - 1][1])


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and their marks of the whole text, each with at least one letter."""
    found = _WORD.findall(text.lower()) if text else []
    return [w for w in found if w[0].isalpha() or _LETTER.search(w)]


def gram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of the letter n-grams of all words, edges marked, and each word's first place."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    place = np.repeat(np.arange(len(words)), sizes)
    code, cells, owners = joined.astype(np.uint64), [], []
    for n in _GRAMS:
        h = np.full(max(0, len(code) - n + 1), np.uint64(n))
        for k in range(n):
            salt = np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (code[k : k + len(h)] + salt)
        inside = place[: len(h)] == place[n - 1 : n - 1 + len(h)]
        if n == 1:
            inside &= code > 3
        cells.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)[inside])
        owners.append(place[: len(h)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(cells)[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass(frozen=True)
class Model:
    """Log-probabilities of cells by language, and the languages each script is written in."""

    languages: list[str]
    cells: np.ndarray  # float32 [cells, languages]
    scripts: np.ndarray  # bool [scripts, languages]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Mean log-probability per letter n-gram, relative to the best language, times 4; at least -12.

        Languages that the word's script rules out score -12; if it rules out all, none is.
        """
        cells, starts = gram_cells(words)
        sums = np.add.reduceat(self.cells[cells], starts, axis=0)
        counts = np.diff(np.append(starts, len(cells)))[:, None]
        scores = 4 * sums / counts
        fits = self.scripts[[script_of(w) for w in words]]
        fits[~fits.any(axis=1)] = True
        scores = np.where(fits, scores, -np.inf)
        return np.maximum(scores - scores.max(axis=1, keepdims=True), -12).astype(np.float32)


def _counted(languages: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _BUCKETS + len(_SCRIPTS)
        counts = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    own = counts[languages.index(lang.as_py())]
                    own[:_BUCKETS] += np.bincount(gram_cells(words)[0], minlength=_BUCKETS)
                    own[_BUCKETS:] += np.bincount([script_of(w) for w in words], minlength=len(_SCRIPTS))
        for i in range(len(languages)):
            at = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[i, at])],
                ["language", "cell", "n"])

    return run


def train(labelled: DataFrame, *, most_languages: int = 256) -> Model:
    """Fit cell counts of ``(text, lang)``; null langs and texts teach nothing.

    Counts are summed on the cluster. What reaches the driver is bounded by cells
    times languages, whatever the rows; more than ``most_languages`` is an error.
    """
    known = labelled.filter("lang is not null and text is not null").select("text", "lang")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    table = np.zeros((_BUCKETS + len(_SCRIPTS), max(1, len(languages))))
    if languages:
        counted = known.mapInArrow(_counted(languages), "language int, cell int, n long")
        for r in counted.groupBy("language", "cell").agg(F.sum("n").alias("n")).collect():
            table[r.cell, r.language] = r.n
    grams, scripts = table[:_BUCKETS], table[_BUCKETS:]
    logs = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * _BUCKETS)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logs.astype(np.float32), share >= 0.001)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word of many texts at once; a change of language costs ``penalty``.

    ``scores`` has the words of all texts one after another, ``sizes`` the words per
    text. Step t handles word t of every text that has one, longest texts first.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
    best = np.zeros((len(lengths), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int16)
    for t in range(steps):
        a = alive[t]
        rows, kept = starts[:a] + t, best[:a]
        if t:
            top = kept.argmax(axis=1)
            jump = kept[np.arange(a), top] - penalty
            moved = kept < jump[:, None]
            came[rows] = np.where(moved, top[:, None], np.arange(scores.shape[1]))
            kept = np.where(moved, jump[:, None], kept)
            kept = kept - kept.max(axis=1, keepdims=True)
        best[:a] = kept + scores[rows]
    out = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        rows = starts[:a] + t
        out[rows] = state[:a]
        if t:
            state[:a] = came[rows, state[:a]]
    return out


class _Labeller:
    """Language numbers of all words of texts; remembers words, and works on a bounded number of them at once."""

    def __init__(self, model: Model, penalty: float) -> None:
        self._model, self._penalty = model, penalty
        self._most = _CELLS // max(1, len(model.languages))
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._known = np.empty((0, len(self._model.languages)), np.float32)

    def _labelled(self, lists: list[np.ndarray]) -> list[np.ndarray]:
        if not self._model.languages:
            return lists
        new = list(self._place)[len(self._known):]
        if new:
            parts = (self._model.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000))
            self._known = np.concatenate([self._known, *parts])
        sizes = np.array([len(own) for own in lists], np.int64)
        flat = viterbi(self._known[np.concatenate(lists)], sizes, self._penalty)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def __call__(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Labels of each text, in runs of texts."""
        lists, held = [], 0
        for text in texts:
            words = words_of(text.as_py()) if self._model.languages else []
            if lists and held + len(words) > self._most:
                yield self._labelled(lists)
                lists, held = [], 0
                if len(self._place) > _KEPT:
                    self._forget()
            place = self._place
            for w in set(words).difference(place):
                place[w] = len(place)
            lists.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
            held += len(words)
        if lists:
            yield self._labelled(lists)
        if len(self._place) > _KEPT:
            self._forget()


def _main_language(own: np.ndarray, languages: list[str]) -> tuple[str, float]:
    if not len(own):
        return UNDECIDED, 0.0
    counts = np.bincount(own, minlength=len(languages))
    return languages[counts.argmax()], counts.max() / len(own)


def _labelled(model: Model, penalty: float, spans: bool) -> Callable:
    """Arrow function: language, share and spans of each text of a batch."""

    def spans_of(own: np.ndarray) -> list[dict]:
        if not spans or not len(own):
            return []
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
        return [{"lang": model.languages[own[a]], "first": int(a), "words": int(b - a)}
                for a, b in zip(edges, edges[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labeller(model, penalty)
        for batch in batches:
            at = 0
            for found in labels(batch.column(1)):
                best = [_main_language(own, model.languages) for own in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(found)), pa.array([lang for lang, _ in best], pa.string()),
                     pa.array([share for _, share in best], pa.float64()), pa.array(map(spans_of, found), _SPANS)],
                    ["doc_id", "lang_pred", "score", "spans"])
                at += len(found)

    return run


def _in_a_language(model: Model, penalty: float, least_share: float, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labeller(model, penalty)
        for batch in batches:
            at = 0
            for found in labels(batch.column(text_at)):
                best = [_main_language(own, model.languages) for own in found]
                keep = [lang != UNDECIDED and share >= least_share for lang, share in best]
                yield batch.slice(at, len(found)).filter(pa.array(keep))
                at += len(found)

    return run


_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))


def label_languages(
    docs: DataFrame, model: Model, *, penalty: float = 8.0, spans: bool = True, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, lang_pred, score and language spans (by letter word) of every whole text.

    Each word (a run of letters and marks with at least one letter) scores every
    language by its letter n-grams; scripts narrow the candidates; Viterbi with
    ``penalty`` per change labels the words. The language of most words is predicted
    (ties: first by name), ``score`` is its share of words.

    Null and empty texts and texts without letters are ``und`` with score 0 and no
    spans, as is everything under a model without languages. Row by row: repeated
    rows and ids are no matter, other columns are ignored, an empty table gives no rows.
    Texts are labelled some hundred thousand words at a time, whatever a batch holds.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()),
            T.StructField("words", T.IntegerType())])))])
    return rows.mapInArrow(_labelled(model, penalty, spans), schema)


def keep_known(
    docs: DataFrame, model: Model, least_share: float, *, penalty: float = 8.0, text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language for ``least_share`` of its words.

    Rows that ``label_languages`` calls ``und`` go, so null, empty and letterless texts
    do, and every row under a model without languages. Repeated rows are judged one by
    one, an empty table gives no rows, column names do not matter.
    """
    return docs.mapInArrow(_in_a_language(model, penalty, least_share, docs.columns.index(text_col)), docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """Rows to learn from: outside fold 0 of 5, about ``most_rows`` of them, chosen by hash of id.

    The bound is on expected rows: the share is ``most_rows`` in all rows of the table.
    """
    rows = docs.count()
    cells = 1 << 30
    kept = F.pmod(F.xxhash64(F.lit("lang"), id_col), F.lit(cells)) < min(cells, most_rows * cells // max(rows, 1))
    return docs.filter((fold(id_col, 5) != 0) & kept).select("text", "lang")
