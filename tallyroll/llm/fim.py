"""Fill-in-the-middle transformation: cuts are scanned, bytes scattered by cumulated displacements and gathered back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE = 1 << 22  # text bytes worked on at once; a longer text is a slice of its own
_BLOCK = 1 << 20  # bytes displaced at once, so a very long text needs no more than a few times its size
_GRID = 1 << 12
#: Marks of prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("char", "line")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def _texts(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``_SLICE`` bytes, one row at least."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, "right")) - 1)
        yield at, to
        at = to


def _displaced(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of byte places and where each is displaced to.

    From each start (ascending, several may be equal) on, bytes move by its shift. The
    changes of shift go into a difference array; its cumulated sum is the shift of every byte.
    """
    jumps = np.diff(shifts, prepend=0)
    shift = 0
    for at in range(0, size, _BLOCK):
        to = min(size, at + _BLOCK)
        first, last = np.searchsorted(starts, [at, to])
        moved = np.zeros(to - at, np.int64)
        np.add.at(moved, starts[first:last] - at, jumps[first:last])
        moved[0] += shift
        np.cumsum(moved, out=moved)
        shift = moved[-1]
        yield slice(at, to), moved + np.arange(at, to)


class _Cuts:
    """Units of texts that lie one after another: how many begin before a byte, and where the k-th begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str) -> None:
        if unit == "char":
            self._begins = (data & 0xC0) != 0x80
        else:
            self._begins = np.concatenate([[False], data[:-1] == 10]) if len(data) else np.empty(0, bool)
            self._begins[offsets[:-1][np.diff(offsets) > 0]] = True
        grid = np.arange(0, len(data), _GRID)
        sums = np.add.reduceat(self._begins, grid, dtype=np.int64) if len(data) else []
        self._before = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)
        self._size = len(data)

    def before(self, places: np.ndarray) -> np.ndarray:
        cells = places // _GRID
        inside = [np.count_nonzero(self._begins[c * _GRID : p]) for c, p in zip(cells.tolist(), places.tolist(), strict=True)]
        return self._before[cells] + inside

    def place(self, numbers: np.ndarray) -> np.ndarray:
        out = np.full(len(numbers), self._size)
        cells = np.searchsorted(self._before, numbers, "right") - 1
        for i in np.flatnonzero(numbers < self._before[-1]):
            c = cells[i]
            out[i] = c * _GRID + np.flatnonzero(self._begins[c * _GRID : (c + 1) * _GRID])[numbers[i] - self._before[c]]
        return out


def _found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a mark inside texts, and the text of each."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for i, byte in enumerate(mark[1:], 1):
        at = at[data[at + i] == byte]
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + len(mark) <= offsets[owner + 1]
    return at[inside], owner[inside]


def _forms(data: np.ndarray, offsets: np.ndarray, marks: list[bytes], h3: np.ndarray, h4: np.ndarray,
           plain_percent: int, spm_percent: int) -> np.ndarray:
    """0 plain, 1 psm, 2 spm."""
    plain = (np.diff(offsets) == 0) | (h3 % 100 >= 100 - plain_percent)
    for mark in marks:
        plain[_found(data, offsets, mark)[1]] = True
    return np.where(plain, 0, np.where(h4 % 100 < spm_percent, 2, 1))


_NAMES = np.array(["plain", "psm", "spm"])


def _transformed(marks: list[bytes], plain_percent: int, spm_percent: int, unit: str) -> Callable:
    lp, ls, lm = map(len, marks)

    def one(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray]):
        cuts = _Cuts(data, offsets, unit)
        before = cuts.before(offsets)
        n = np.diff(before)
        low, high = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
        form = _forms(data, offsets, marks, h[2], h[3], plain_percent, spm_percent)
        begin, end = offsets[:-1], offsets[1:]
        # the unit after a text's last one is the next text's first: a cut behind the last unit is the text's end
        b1 = np.minimum(cuts.place(before[:-1] + low), end)
        b2 = np.minimum(cuts.place(before[:-1] + high), end)
        p, m, s = b1 - begin, b2 - b1, end - b2
        moved = form > 0
        out_ends = np.concatenate([[0], np.cumsum(end - begin + (lp + ls + lm) * moved)])
        out = out_ends[:-1]
        places = {  # of prefix, middle, suffix inside the output, by form
            0: (0 * p, p, p + m), 1: (lp + 0 * p, lp + p + ls + s + lm, lp + p + ls),
            2: (ls + s + lp, ls + s + lp + p + lm, ls + 0 * p)}
        to = [np.choose(form, [places[f][i] for f in (0, 1, 2)]) + out for i in range(3)]
        target = np.empty(out_ends[-1], np.uint8)
        starts = np.stack([begin, b1, b2], axis=1).ravel()
        shifts = np.stack([to[0] - begin, to[1] - b1, to[2] - b2], axis=1).ravel()
        for here, there in _displaced(len(data), starts, shifts):
            target[there] = data[here]
        for mark, piece in zip(marks, (to[0], to[2], to[1]), strict=True):  # each stands right before its piece
            for i, byte in enumerate(mark):
                target[piece[moved] - len(mark) + i] = byte
        hidden = ~moved
        return [pa.array(n), pa.array(_NAMES[form], pa.string()), pa.array(low, mask=hidden),
                pa.array(high - low, mask=hidden), _texts(out_ends, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _flat(batch.column(1))
            hashes = [batch.column(i).to_numpy() for i in range(2, 6)]
            for at, to in _slices(ends):
                found = one(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], [h[at:to] for h in hashes])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *found], [
                    "doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return run


def _restored(marks: list[bytes], text_at: int, form_at: int) -> Callable:
    lp, ls, lm = map(len, marks)

    def one(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray):
        moved = np.flatnonzero(forms != "plain")
        spm = forms[moved] == "spm"
        at = []
        for mark in marks:
            places, owner = _found(data, offsets, mark)
            mine = np.isin(owner, moved)
            if not np.array_equal(owner[mine], moved):
                raise ValueError("an output without exactly one mark of each kind")
            at.append(places[mine])
        begin, end = offsets[:-1], offsets[1:]
        p_at, s_at, m_at = at
        first, suffix, middle = begin.copy(), end.copy(), end.copy()  # where the pieces begin in the output
        p, s = end - begin, 0 * begin
        first[moved], suffix[moved], middle[moved] = p_at + lp, s_at + ls, m_at + lm
        p[moved] = np.where(spm, m_at, s_at) - first[moved]
        s[moved] = np.where(spm, p_at, m_at) - suffix[moved]
        m = end - middle
        ends = np.concatenate([[0], np.cumsum(p + m + s)])
        out = ends[:-1]
        starts = np.stack([out, out + p, out + p + m], axis=1).ravel()
        shifts = np.stack([first - out, middle - out - p, suffix - out - p - m], axis=1).ravel()
        target = np.empty(ends[-1], np.uint8)
        for here, there in _displaced(len(target), starts, shifts):
            target[here] = data[there]
        return _texts(ends, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _flat(batch.column(text_at))
            forms = np.array(batch.column(form_at).fill_null("plain").to_pylist(), "U5")
            for at, to in _slices(ends):
                back = one(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], forms[at:to])
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*rows.columns, back], [*batch.schema.names, "restored"])

    return run


def _marks(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The marks as bytes; they must be told apart wherever they stand next to each other or to a cut text."""
    marks = [s.encode() for s in sentinels]
    for i, j in product(range(3), repeat=2):
        a, b = marks[i], marks[j]
        overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
        if not a or overlap or (i != j and a in b):
            raise ValueError("sentinels must not be empty, contain each other or overlap")
    return marks


def _hash(id_col: str, seed: str, i: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")


def transform(
    docs: DataFrame, *, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, unit: str = "char",
    sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` of every row, whole texts.

    A text of ``n`` units (code points, or lines with their ends) is cut at two
    places drawn by hash of seed and id. Form ``psm`` is prefix, suffix, middle, each
    after its mark; ``spm`` has the suffix first; ``plain`` is the text itself and has
    no lengths. Empty texts and texts that hold a mark are plain, besides
    ``plain_percent`` of all; of the others ``spm_percent`` are spm.

    A null text counts as empty, a null id as empty text in the hash. Row by row:
    repeated rows and ids are no matter, other columns are ignored, an empty table
    gives no rows. Work goes by slices of 4 MB or one text, and displaces 1 MB at a time.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[_hash(id_col, seed, i) for i in range(4)])
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_transformed(_marks(sentinels), plain_percent, spm_percent, unit), (
        f"doc_id {id_type}, n long, form string, prefix_units long, middle_units long, output string"))


def restore(
    rows: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS, output_col: str = "output", form_col: str = "form",
) -> DataFrame:
    """All columns and ``restored``, the text that ``output`` was made of, from output and form alone.

    A null output restores to empty, a null form counts as plain. An output in another
    form that lacks a mark, or holds one twice, is an error. A column named restored is replaced.
    """
    rows = rows.drop("restored")
    names = [*rows.columns]
    schema = T.StructType([*rows.schema, T.StructField("restored", T.StringType())])
    return rows.mapInArrow(_restored(_marks(sentinels), names.index(output_col), names.index(form_col)), schema)


def _sql_hash(i: int) -> str:
    return f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    {_sql_hash(0)} AS h1, {_sql_hash(1)} AS h2, {_sql_hash(2)} AS h3, {_sql_hash(3)} AS h4 FROM documents
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS c FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
