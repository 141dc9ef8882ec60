import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken

from tallyroll.llm import bpe

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "\n \n", "it's we'll 'S don't", "  two  spaces\t\t tabs \r\n end  ", "x" * 20_000, "ab" * 20_000, " " * 5_000 + "y",
    "über naïve 你好，世界 हिन्दी עברית ١٢٣ ½ ② Ⅷ 🎉🎉", "<|endoftext|> <P>", "\x00\x1c\x1d \x1e\x1f\x85  　x  y", "՘࢏ ౜1 \U00010940",
    "a \x1cb 　c  \x85 d", "return  x+=1;// ----====", "﻿café é ​z",
]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
@pytest.mark.parametrize("space_starts", [True, False])
def test_as_the_library(spark, name, space_starts):
    path = public_tokenizers.path(name)
    own, ranks = library(path)
    rnd, tokens = random.Random(5), list(ranks)
    texts = TEXTS + ["".join(rnd.choice(tokens).decode("utf8", "ignore") for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    texts += ["".join(rnd.choice("aeiounrst ") for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    rows = [(i % 500, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, space_starts=space_starts)
    assert encoded.columns == ["doc_id", "ids"]
    want = sorted((i, own.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.ids) for r in encoded.collect()) == want
    decoded = bpe.decode(encoded, path)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in decoded.collect()) == sorted((i, (t or "").encode()) for i, t in rows)


def test_no_rows_null_ids_and_unknown_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), MULTI, ".").collect() == []
    rows = spark.createDataFrame([(1, None, "old"), (2, [], "old"), (3, [0, 0], "old")], "k int, ids array<int>, decoded string")
    got = bpe.decode(rows, MULTI)
    first = next(t for t, r in library(MULTI)[1].items() if r == 0)
    assert {r.k: bytes(r.decoded) for r in got.collect()} == {1: b"", 2: b"", 3: first * 2}
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), MULTI).collect()


def test_tokens_that_merges_do_not_reach():
    """``abc`` is no merge of two others, so it stands for the whole piece only, as in the library."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257, b"bc": 258}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    own = tiktoken.Encoding("small", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    split = bpe.Splitter(raw, r"\w+", "", False)
    for text in ("abcd", "abcdabcd", "abcabc bcd abcd xabcd", "aabbccdd", "bcbcab"):
        assert list(split(text)) == own.encode_ordinary(text)
    with pytest.raises(ValueError, match="single byte"):
        bpe.Vocabulary(b"YQ== 0")


def test_random_vocabularies():
    """Any joined pairs, so that ties, runs, dead ends and tokens out of reach are frequent."""
    rnd, right, wrong = random.Random(11), 0, 0
    for _ in range(300):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        while len(made) < rnd.randint(5, 20):
            token = rnd.choice(made) + rnd.choice(made)
            if token not in ranks and len(token) < 12:
                ranks[token] = len(ranks)
                made.append(token)
        raw = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
        own = tiktoken.Encoding("random", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        try:
            split = bpe.Splitter(raw, r"\w+", "", False)
        except ValueError as error:
            assert "merge order" in str(error)
            wrong += 1
            continue
        right += 1
        for _ in range(60):
            text = "".join(rnd.choice("aaabbc") for _ in range(rnd.randint(1, 40)))
            assert list(split(text)) == own.encode_ordinary(text), (text, ranks)
    assert right > 30 and wrong > 0


def test_linear_time():
    split = bpe.Splitter(open(MULTI, "rb").read(), public_tokenizers.PATTERN, "", True)

    def took(text):
        began = time.perf_counter()
        split(text)
        return time.perf_counter() - began

    for unit in ("a", "ab", "=-", "etaoin"):
        took(unit * 1000)
        assert took(unit * 80_000) < 60 * max(took(unit * 8_000), 0.01)


def test_many_texts_share_the_work(monkeypatch):
    """Short pieces of all texts are merged together, a chunk that recurs in none again; results as the library's."""
    own, _ = library(MULTI)
    rnd, calls, merged = random.Random(8), [], bpe.Vocabulary._merged
    monkeypatch.setattr(bpe.Vocabulary, "_merged", lambda self, pieces: calls.append(len(pieces)) or merged(self, pieces))
    syllables = ["on", "er", "ß", "ción", "th", "ñ", "&&&", ".\n", "  ", "\t", " ", "é", "\u8a9e", " \n", "'s", "7", "\u0378", "\ua7cb"]
    texts = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(0, 60))) for _ in range(500)] + ["x" * 500, " ", "", "a b", " b"]
    for space_starts in (True, False):
        split = bpe.Splitter(open(MULTI, "rb").read(), public_tokenizers.PATTERN, bpe.newer_characters(), space_starts)
        for _ in range(2):
            got = [list(memoryview(ids).cast("i")) if ids else [] for ids in split.many(texts)]
            assert got == [own.encode_ordinary(t) for t in texts]
        assert [list(split(t)) for t in texts] == got
    assert calls[0] > 1000


def test_long_texts_and_patterns_without_spaces(monkeypatch):
    own, _ = library(MULTI)
    rnd = random.Random(9)
    raw = open(MULTI, "rb").read()
    monkeypatch.setattr(bpe, "_BLOCK", 50)
    monkeypatch.setattr(bpe, "_MOST_CHUNKS", 20)
    texts = ["".join(rnd.choice(["on", "er ", " th", "\n", "  ", "é"]) for _ in range(300)) for _ in range(20)]
    split = bpe.Splitter(raw, public_tokenizers.PATTERN, "", True)
    assert [list(memoryview(ids).cast("i")) for ids in split.many(texts)] == [own.encode_ordinary(t) for t in texts]
    words = bpe.Splitter(raw, r"\w+", "", True)  # no match holds a space
    assert list(words("the cat, the mat")) == [i for w in ("the", "cat", "the", "mat") for i in own.encode_ordinary(w)]
