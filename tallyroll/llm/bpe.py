"""Byte-level BPE encoding and decoding: the merges of many short pieces at once; longest matches with backtracking in long ones."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import itemgetter
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MOST_PAIRS = 1 << 20  # adjacent tokens whose verdict a worker remembers
_MOST_CHUNKS = 1 << 19  # chunks whose tokens a worker remembers
_LONGEST_CHUNK = 64  # longer ones are not remembered
_SHORT = 64  # bytes of a piece that is merged together with others
_BLOCK = 1 << 20  # characters cut into chunks at once
_NONE = np.iinfo(np.int64).max
_SPACE, _BEFORE_SPACE, _LONE_SPACE = re.compile(r" \S"), re.compile(r"(?= \S)"), re.compile(r" (?!\S)")
_UNASSIGNED = "\u0378"
_MOST_IDS = 1 << 20  # ids of one Arrow batch, unless one text has more


class Pairs:
    """The token that two adjacent tokens make, for arrays of them: a hash table with linear probing."""

    def __init__(self, made: dict[int, int]) -> None:
        self._shift = np.uint64(63 - max(len(made), 1).bit_length())  # filled to a half at most
        self._keys = np.full(1 << int(np.uint64(64) - self._shift), -1, np.int64)
        self._made = np.full(len(self._keys), _NONE, np.int64)
        keys = np.fromiter(made, np.int64, len(made))
        values = np.fromiter(made.values(), np.int64, len(made))
        at = self._first(keys)
        while len(keys):
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[free]
            done = self._keys[at] == keys  # of several for one place the last is in it
            self._made[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (len(self._keys) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        found = np.full(len(keys), _NONE, np.int64)
        open_, at = np.arange(len(keys)), self._first(keys)
        while len(open_):
            there = self._keys[at]
            same = there == keys
            found[open_[same]] = self._made[at[same]]
            on = ~same & (there != -1)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & (len(self._keys) - 1)
        return found


class Vocabulary:
    """Merge ranks of byte strings, which are mapped to Latin-1 text byte by byte.

    A token can end up next to another if no merge of lower rank would have crossed the
    border between them; that depends on the two tokens alone. Tokens that their own
    merges do not lead to stand for a whole piece only. Ranks must be in merge order (a
    token's last merge has a higher rank than those it joins), as byte-pair training gives them.
    """

    def __init__(self, ranks: bytes) -> None:
        self.ids: dict[str, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ids[base64.b64decode(token).decode("latin-1")] = int(rank)
        if not all(chr(b) in self.ids for b in range(256)):
            raise ValueError("the ranks lack a single byte")
        self.texts = {rank: token for token, rank in self.ids.items()}
        self._sizes = {rank: len(token) for token, rank in self.ids.items()}
        self._halves: dict[int, tuple[int, int]] = {}  # what the token's last merge joined; single bytes have none
        self._shorter: dict[int, int | None] = {}  # longest token that begins it
        self._verdicts: dict[int, bool] = {}
        self._matches = ahocorasick.Automaton()
        for rank in sorted(self.texts, key=lambda r: (len(self.texts[r]) > 1, r)):
            token = self.texts[rank]
            if len(token) == 1:
                self._shorter[rank] = None
            else:
                halves = self._joined(token, rank)
                if halves is None:
                    if self._merges_to_itself(token):
                        raise ValueError(f"ranks are not in merge order: token {rank} is made of a later one")
                    continue
                self._halves[rank] = halves
            self._matches.add_word(token, rank)
        for rank in self._halves:
            token = self.texts[rank]
            beginnings = (self.ids.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self._shorter[rank] = next(r for r in beginnings if r is not None and (r in self._halves or len(self.texts[r]) == 1))
        self._matches.make_automaton()
        splits = ((r, self.ids.get(t[:n]), self.ids.get(t[n:])) for t, r in self.ids.items() for n in range(1, len(t)))
        self._pairs = Pairs({left << 32 | right: r for r, left, right in splits if left is not None and right is not None})
        self._bytes = np.array([self.ids[chr(b)] for b in range(256)], np.int64)

    def _joined(self, token: str, rank: int) -> tuple[int, int] | None:
        for n in range(len(token) - 1, 0, -1):
            left, right = self.ids.get(token[:n]), self.ids.get(token[n:])
            if self._made_before(left, rank) and self._made_before(right, rank) and self._apart(left, right, rank):
                return left, right
        return None

    def _made_before(self, token: int | None, rank: int) -> bool:
        return token is not None and (self._sizes[token] == 1 or (token < rank and token in self._halves))

    def _merges_to_itself(self, token: str) -> bool:
        parts = list(token)
        while len(parts) > 1:
            pairs = [self.ids.get(a + b, float("inf")) for a, b in zip(parts, parts[1:], strict=False)]
            if min(pairs) == float("inf"):
                return False
            i = pairs.index(min(pairs))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge below ``limit`` crosses the border: merges are undone, the latest first, on both sides."""
        while True:
            across = self.ids.get(self.texts[left] + self.texts[right])
            if across is not None and across < limit:
                return False
            made_left = left if left in self._halves else -1
            made_right = right if right in self._halves else -1
            if made_left > made_right:  # of equal merges the left one comes first
                limit, left = left, self._halves[left][1]
            elif made_right >= 0:
                limit, right = right + 1, self._halves[right][0]
            else:
                return True

    def _judged(self, left: int, right: int) -> bool:
        if len(self._verdicts) >= _MOST_PAIRS:
            self._verdicts.clear()
        verdict = self._verdicts[left << 32 | right] = self._apart(left, right)
        return verdict

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece (bytes as Latin-1). Each end that turned out dead is tried once, so time is linear."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        sizes, shorter, verdicts, size = self._sizes, self._shorter, self._verdicts, len(piece)
        longest = [0] * size  # token that reaches farthest from each place
        for end, token in self._matches.iter(piece):
            longest[end - sizes[token] + 1] = token  # ends ascend, so the longest comes last
        dead = bytearray(size + 1)
        token = last = longest[0]
        found, at = [], 0
        while at < size:
            end = at + sizes[token]
            if not dead[end]:
                fits = True
                if at:
                    fits = verdicts.get(last << 32 | token)
                    if fits is None:
                        fits = self._judged(last, token)
                if fits:
                    found.append(token)
                    last, at = token, end
                    if at < size:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token is None:  # nothing leads on from here: take the token before back
                dead[at] = 1
                token = found.pop()
                at -= sizes[token]
                last = found[-1] if found else token
                token = shorter[token]
        return found


    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Tokens of each piece as 32-bit integers; short pieces that are no token are merged together."""
        found, short = [], []
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                found.append(whole.to_bytes(4, sys.byteorder))
            elif len(piece) > _SHORT:
                found.append(array("i", self.encode_piece(piece)).tobytes())
            else:
                found.append(b"")
                if piece:
                    short.append(i)
        if short:
            ids, sizes = self._merged([pieces[i] for i in short])
            raw, ends = ids.astype(np.int32).tobytes(), np.cumsum(4 * sizes).tolist()
            for i, at, end in zip(short, [0, *ends], ends, strict=False):
                found[i] = raw[at:end]
        return found

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces (none empty) and their number in each: in a round every piece merges its
        first pair of lowest rank, as the definition says, until none has a pair left.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = self._bytes[np.frombuffer("".join(pieces).encode("latin-1"), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        at = np.arange(len(tokens))  # place of a token's first byte
        done = np.full(len(tokens), -1, np.int64)
        ranks = np.full(len(tokens), _NONE, np.int64)  # of each token and the next of its piece
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inner] = self._pairs(tokens[inner], tokens[inner + 1])
        while len(tokens):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(starts, append=len(owner))
            least = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            over = least == _NONE
            if over.any():
                done[at[over]] = tokens[over]
                on = ~over
                tokens, owner, at, ranks, least = tokens[on], owner[on], at[on], ranks[on], least[on]
                if not len(tokens):
                    break
            hits = np.flatnonzero(ranks == least)
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]
            tokens[hits] = ranks[hits]
            on = np.ones(len(tokens), bool)
            on[hits + 1] = False
            hits -= np.arange(len(hits))  # one token went before each
            tokens, owner, at, ranks = tokens[on], owner[on], at[on], ranks[on]
            ranks[hits] = _NONE
            for left in (hits[hits > 0] - 1, hits[hits + 1 < len(tokens)]):
                left = left[owner[left] == owner[left + 1]]
                ranks[left] = self._pairs(tokens[left], tokens[left + 1])
        kept = done >= 0
        return done[kept], np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64)


class Splitter:
    """Tokens of texts: split by ``pattern``, remembered chunk by chunk.

    With ``space_starts``, every space before a visible character begins a match, whatever
    stands before it. Texts are then cut there first, and a chunk met again costs one look-up.
    A chunk is known by its text without that space; one that does not begin so, by its text after a space.
    """

    def __init__(self, ranks: bytes, pattern: str, newer: str, space_starts: bool) -> None:
        self.vocabulary = Vocabulary(ranks)
        self._split, self._newer = regex.compile(pattern), regex.compile(newer or "(?!)")
        self._space_starts, self._known = space_starts, {}

    def _blocks(self, text: str) -> Iterator[str]:
        at = 0
        while self._space_starts and len(text) - at > _BLOCK:
            cut = _SPACE.search(text, at + _BLOCK)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _chunks(self, text: str) -> list[str]:
        if not self._space_starts:
            return [" " + text]
        if _LONE_SPACE.search(text):
            first, *others = _BEFORE_SPACE.split(text)
            return [" " + first, *(chunk[1:] for chunk in others)]
        chunks = text.split(" ")
        chunks[0] = " " + chunks[0]
        return chunks

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or not self._newer.search("".join(set(text))):
            return list(map(itemgetter(0), self._split.finditer(text)))
        return [text[m.start() : m.end()] for m in self._split.finditer(self._newer.sub(_UNASSIGNED, text))]

    def _learn(self, chunks: list[str]) -> None:
        """Tokens of chunks not met before: all split, then each different piece encoded once."""
        plain, others = [c for c in chunks if " " not in c], [c for c in chunks if " " in c]
        pieces = self._pieces("".join(" " + c for c in plain))
        starts = [i for i, piece in enumerate(pieces) if piece[:1] == " "]
        if len(starts) != len(plain):  # the pattern leaves the spaces out
            others, pieces, starts, plain = chunks, [], [], []
        ends = [*starts[1:], len(pieces)]
        for chunk in others:
            starts.append(len(pieces))
            pieces += self._pieces(chunk[1:] if chunk[0] == " " else " " + chunk)
            ends.append(len(pieces))
        different = list(set(pieces))
        encoded = self.vocabulary.encode_pieces([p if p.isascii() else p.encode().decode("latin-1") for p in different])
        codes = list(map(dict(zip(different, encoded, strict=True)).__getitem__, pieces))
        for chunk, at, end in zip([*plain, *others], starts, ends[-len(starts):], strict=True):
            self._known[chunk] = codes[at] if end - at == 1 else b"".join(codes[at:end])

    def _block(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) >= _MOST_CHUNKS:
            known.clear()
        cut = list(map(self._chunks, texts))
        missed: set[str] = set()
        for chunks in cut:
            missed.update(filterfalse(known.__contains__, chunks))
        if missed:
            self._learn(list(missed))
        found = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for chunk in missed:
            if len(chunk) > _LONGEST_CHUNK:
                del known[chunk]
        return found

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        if sum(map(len, texts)) <= _BLOCK:
            return self._block(texts)
        return [b"".join(self._block([block])[0] for block in self._blocks(text)) for text in texts]

    def __call__(self, text: str) -> array:
        return array("i", self.many([text])[0])


def newer_characters() -> str:
    """Class of the letters and numbers that the pattern library knows and the tokenizer library does not know yet.

    The two carry tables of different Unicode versions; in splits such a character
    counts as unassigned. Empty where the tables agree.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ours = set(regex.findall(r"[\p{L}\p{N}]", every))
    probe = tiktoken.Encoding("probe", pat_str=r"[\p{L}\p{N}]", special_tokens={}, mergeable_ranks={bytes([b]): b for b in range(256)})
    points = sorted(map(ord, ours.difference(bytes(probe.encode_ordinary(every)).decode())))
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]" if points else ""


@lru_cache(maxsize=2)
def _worker_splitter(*how: object) -> Splitter:
    """One vocabulary and memory a Python worker, whatever its number of tasks."""
    return Splitter(*how)


@lru_cache(maxsize=2)
def _worker_tokens(ranks: bytes) -> dict[int, bytes]:
    tokens = (line.split() for line in ranks.splitlines() if line.strip())
    return {int(rank): base64.b64decode(token) for token, rank in tokens}


def _encoded(*how: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _worker_splitter(*how)
        for batch in batches:
            first, texts, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= _BLOCK or i + 1 == batch.num_rows:
                    found = split.many(texts[:-1]) + split.many(texts[-1:])  # the last may be a long one
                    ends = np.cumsum([0, *map(len, found)]) // 4
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), lists], ["doc_id", "ids"])
                    first, texts, held = i + 1, [], 0

    return run


def _decoded(ranks: bytes, ids_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_tokens(ranks)
        for batch in batches:
            first, texts, held = 0, [], 0
            for i, ids in enumerate(batch.column(ids_at)):
                values = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                try:
                    texts.append(b"".join(map(known.__getitem__, values)))
                except KeyError as unknown:
                    raise ValueError(f"no token has the id {unknown}") from None
                held += len(texts[-1])
                if held >= 4 * _MOST_IDS or i + 1 == batch.num_rows:
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])
                    first, texts, held = i + 1, [], 0

    return run


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, space_starts: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, ids`` of every whole text, as merges by rank within each match of ``pattern`` give them.

    ``ranks_path`` is a rank file (base64 bytes and rank a line) the driver can read;
    it goes to the tasks with the code and is bounded by the vocabulary. There are no
    special tokens: their texts are ordinary text. Parts of a text between matches
    have no tokens. ``space_starts`` makes it faster and holds for patterns whose
    matches never run on into a space before a visible character.

    A null text counts as empty and has no ids. Row by row: repeated rows and ids are no
    matter, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    run = _encoded(Path(ranks_path).read_bytes(), pattern, newer_characters(), space_starts)
    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(rows: DataFrame, ranks_path: str, *, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the bytes that the ids stand for; null ids give none, an unknown id is an error.

    A column named decoded is replaced.
    """
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoded(Path(ranks_path).read_bytes(), rows.columns.index(ids_col)),
                           T.StructType([*rows.schema, T.StructField("decoded", T.BinaryType())]))
