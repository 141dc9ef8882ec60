"""Benchmark passages in training texts, found through a positional inverted index."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written

#: A-Z to a-z; 0-9, a-z and every byte above ASCII stay; other ASCII separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CHUNK = 1 << 20  # words that are inverted at a time


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _inverted(id_type: pa.DataType) -> Callable:
    """Arrow function (doc_id, key, text) -> postings of a run of texts, one row a term.

    The row of the empty term lists the texts themselves: ids, keys and word counts.
    """
    schema = pa.schema([("term", pa.string()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())),
                        ("pos", pa.list_(pa.int32())), ("ids", pa.list_(id_type))])

    def flush(places: dict, words: list, docs: list, ids: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(w) for w in words], np.int32)
        term = np.concatenate([*words, np.empty(0, np.int32)])
        order = np.argsort(term, kind="stable")
        pos = np.concatenate([*(np.arange(s, dtype=np.int32) for s in sizes), np.empty(0, np.int32)])[order]
        doc = np.repeat(np.array(docs, np.int64), sizes)[order]
        counts = np.bincount(term, minlength=len(places))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        names = list(places)
        yield pa.RecordBatch.from_arrays([
            pa.array([""]), pa.array([len(docs)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, pa.int64())),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(sizes)),
            pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(ids, id_type)),
        ], schema=schema)
        step = 10_000
        for at in range(0, len(names), step):
            to = min(at + step, len(names))
            lists = pa.array(ends[at : to + 1] - ends[at])
            rows = slice(ends[at], ends[to])
            yield pa.RecordBatch.from_arrays([
                pa.array(names[at:to], pa.binary()).cast(pa.string()), pa.array(counts[at:to]),
                pa.ListArray.from_arrays(lists, pa.array(doc[rows])), pa.ListArray.from_arrays(lists, pa.array(pos[rows])),
                pa.nulls(to - at, pa.list_(id_type)),
            ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, words, docs, ids, size = defaultdict(count().__next__), [], [], [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = words_of(text.as_py())
                words.append(np.fromiter(map(places.__getitem__, own), np.int32, len(own)))
                docs.append(key.as_py())
                ids.append(doc_id.as_py())
                size += len(own) + 1
                if size >= _CHUNK:
                    yield from flush(places, words, docs, ids)
                    places, words, docs, ids, size = defaultdict(count().__next__), [], [], [], 0
        if docs:
            yield from flush(places, words, docs, ids)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: (term, n, docs, pos, ids) with parallel lists of text keys and positions.

    Every text is in one segment, the run of texts one task inverts at a time, so
    postings are never shuffled; a term has one row for each segment it occurs in.
    """
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["doc_id"].dataType
    ddl = f"term string, n long, docs array<long>, pos array<int>, ids array<{kind.simpleString()}>"
    return written(keyed.select("doc_id", "key", F.col("text").cast("binary")).mapInArrow(
        _inverted(to_arrow_type(kind)), ddl), "postings")


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Hash of id and text: with the id it names a row, whatever other rows have that id."""
    return F.xxhash64(id_col, text_col)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def _anchors(items: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """For each window its two rarest terms and their offsets: (ikey, term, o, n, term2, o2), distinct.

    A window with a term that no training text has cannot occur and is left out.
    """
    terms = items.select("ikey", "words", F.posexplode("words").alias("o", "term"))
    vocabulary = written(terms.select("term").distinct(), "test-terms")
    counts = written(index.select("term", "n").join(vocabulary, "term", "left_semi")
                     .groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("s")
    windows = items.select("ikey", "words", start).select(
        "ikey", "s", F.least(F.size("words"), F.lit(window)).alias("m"),
        F.posexplode(F.slice("words", F.col("s") + 1, window)).alias("j", "term"))
    rated = windows.join(counts, "term").withColumn("o", F.col("s") + F.col("j"))
    ranked = rated.groupBy("ikey", "s", "m").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "o"))).alias("r")).filter(F.size("r") == F.col("m"))
    first, second = F.get("r", F.lit(0)), F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    return ranked.select("ikey", first["term"].alias("term"), first["o"].alias("o"), first["n"].alias("n"),
                         second["term"].alias("term2"), second["o"].alias("o2")).distinct()


def _near_cells(items: DataFrame, index: DataFrame, window: int, slop: int, near: int) -> DataFrame:
    """(ikey, key, shift, width): runs of shifts that hold every proximity match, and so every exact window.

    A window of m words that needs t of them misses m - t at most, so of its m - t + 2 rarest
    places at least two are met (one, where t is 1); terms that no text has count as misses.
    Two places met are at most twice ``slop`` apart in shift and share a cell of one of two
    staggered grids.
    """
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "test-terms")
    counts = written(index.select("term", "n").join(terms, "term", "left_semi")
                     .groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("s")
    windows = items.select("ikey", "words", start).select(
        "ikey", "s", F.least(F.size("words"), F.lit(window)).alias("m"),
        F.posexplode(F.slice("words", F.col("s") + 1, window)).alias("j", "term"))
    rated = windows.join(counts, "term", "left").select(
        "ikey", "s", "m", F.coalesce("n", F.lit(0)).alias("n"), "term", (F.col("s") + F.col("j")).alias("o"))
    needed = F.ceil(near * F.col("m") / F.lit(window)).cast("int")
    ranked = rated.groupBy("ikey", "s", "m").agg(F.sort_array(F.collect_list(F.struct("n", "term", "o"))).alias("r")).select(
        "ikey", F.least(needed, F.lit(2)).alias("least"),
        F.explode(F.slice("r", F.lit(1), F.col("m") - needed + F.least(needed, F.lit(2)))).alias("a"))
    anchors = written(ranked.filter("a.n > 0").select("ikey", "least", "a.term", "a.o").distinct(), "anchors")
    lists = _postings(index, anchors.select("term").distinct()).join(anchors, "term").select(
        "ikey", "least", "key", "o", (F.col("at") - F.col("o")).alias("shift"))
    half = 2 * slop
    cell = F.explode(F.array(*[
        F.floor((F.col("shift") + g) / (2 * half + 2)) * (2 * half + 2) - g for g in (0, half + 1)])).alias("cell")
    met = lists.select("ikey", "least", "key", "o", cell).groupBy("ikey", "least", "key", "cell").agg(
        F.min("o").alias("lo"), F.max("o").alias("hi")).filter("least < 2 or lo < hi")
    return written(met.select("ikey", "key", (F.col("cell") - slop).cast("int").alias("shift"),
                              F.lit(2 * half + 1 + 2 * slop).alias("width")), "cells")


def _postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, at) for every occurrence of ``terms``; a small written table is broadcast by its size."""
    return index.join(terms, "term", "left_semi").select(
        "term", F.explode(F.arrays_zip("docs", "pos")).alias("p")).select(
        "term", F.col("p.docs").alias("key"), F.col("p.pos").alias("at"))


def _checked(window: int, slop: int, near: int) -> Callable:
    """Arrow function: exact and near windows of each text among its candidate alignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, exact, close = [], [], []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                hit, exact_ids, close_ids = np.zeros(len(words), bool), set(), set()
                items: dict[bytes, list[bytes]] = {}
                for c in found.as_py():
                    item = items.get(c["item"])
                    if item is None:
                        item = items[c["item"]] = words_of(c["item"])
                    least = min(window, len(item))
                    for at in range(c["shift"], c["shift"] + c["width"] + 1):
                        same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(item)]
                        run_length = 0
                        for j, equal in enumerate(same):
                            run_length = run_length + 1 if equal else 0
                            if run_length >= least:
                                hit[at + j + 1 - run_length : at + j + 1] = True
                                exact_ids.add(c["item_id"])
                        if slop and c["item_id"] not in exact_ids | close_ids:
                            there = [w in words[max(0, at + j - slop) : max(0, at + j + slop + 1)] for j, w in enumerate(item)]
                            if any(sum(there[s : s + least]) * window >= near * least for s in range(len(item) - least + 1)):
                                close_ids.add(c["item_id"])
                hits.append(int(hit.sum()))
                exact.append(sorted(i for i in exact_ids if i is not None))
                close.append(sorted(i for i in close_ids - exact_ids if i is not None))
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(exact, texts), pa.array(close, texts)],
                ["doc_id", "key", "n_hit", "items", "near_items"])

    return run


def _exact_shifts(tests: DataFrame, index: DataFrame, window: int, common: float) -> DataFrame:
    """(ikey, key, shift, width 0) where an exact window may lie."""
    anchors = written(_anchors(tests, index, window), "anchors")
    words = index.filter("term <> ''").agg(F.sum("n")).first()[0] or 0
    long = anchors.filter((F.col("n") > common * words) & (F.col("o") != F.col("o2")))
    short = anchors.filter((F.col("n") <= common * words) | (F.col("o") == F.col("o2")))

    def shifts(some: DataFrame, term: str, o: str, *more: str) -> DataFrame:
        lists = _postings(index, written(some.select(F.col(term).alias("term")).distinct(), "anchor-terms"))
        return lists.join(some.withColumn("term", F.col(term)), "term").select(
            "ikey", "key", (F.col("at") - F.col(o)).alias("shift"), *more)

    second = shifts(long.select("ikey", "term2", "o", "o2").distinct(), "term2", "o2", "o", "o2")
    both = shifts(long.select("ikey", "term", "o", "o2").distinct(), "term", "o", "o", "o2").join(
        second, ["ikey", "key", "shift", "o", "o2"]).select("ikey", "key", "shift")
    found = written(
        shifts(short.select("ikey", "term", "o").distinct(), "term", "o").union(both).distinct(), "shifts")
    return found.withColumn("width", F.lit(0))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, slop: int = 3, near: int = 8,
    common: float = 1e-5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Words of every text that stand in an occurrence of a test window, and the items found.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_items
    and key, the `text_key` of the row.

    Postings of all training words are stored (`build_index`). Each test window looks
    up the list of its rarest term; position less offset is the shift at which the
    item would lie in the text. If that list holds more than a share ``common`` of all words,
    it is first intersected with the shifted list of the next rarest term. Each shift is one
    check of the whole item against the text, which gives exact windows. With ``slop``, shifts come
    from several of a window's rarest terms (`_near_cells`), none of which must occur, and the check also gives
    proximity matches: items without an exact window, of which some window has at
    least ``near`` in ``window`` words within ``slop`` places of where they should be.

    Null and empty texts have no words and no hits; null or empty items have no
    windows; items without an id hit words but are not listed, repeated ids are listed
    once. Rows that repeat id and text get equal results; rows that share an id only
    are judged apart. Without rows or items nothing is found. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    lower = F.translate(item_text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tests = items.select(
        F.col(item_col).cast("string").alias("item_id"), F.xxhash64(item_col, item_text_col).alias("ikey"),
        F.col(item_text_col).alias("item"), F.regexp_extract_all(lower, F.lit(_WORDS), F.lit(0)).alias("words"),
    ).filter(F.size("words") > 0)
    tests = written(tests.dropDuplicates(["item_id", "ikey"]), "tests")
    found = _near_cells(tests, index, window, slop, near) if slop else _exact_shifts(tests, index, window, common)

    named = found.join(tests.select("ikey", "item_id", F.col("item").cast("binary").alias("item")), "ikey")
    per_text = named.groupBy("key").agg(F.collect_list(F.struct("item_id", "item", "shift", "width")).alias("found"))
    keyed = _keyed(docs, id_col, text_col)
    checked = keyed.select("doc_id", "key", F.col("text").cast("binary")).join(per_text, "key").select(
        "doc_id", "key", "text", "found").mapInArrow(
        _checked(window, slop, near),
        f"doc_id {id_type}, key long, n_hit long, items array<string>, near_items array<string>")
    checked = checked.dropDuplicates(["doc_id", "key"]).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    every = index.filter("term = ''").select(F.explode(F.arrays_zip("ids", "docs", "pos")).alias("p")).select(
        F.col("p.ids").alias("doc_id"), F.col("p.docs").alias("key"), F.col("p.pos").cast("long").alias("n_words"))
    no_items = F.array().cast("array<string>")
    ids = F.coalesce("items", no_items)
    return every.join(
        checked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near_items", no_items).alias("near_items"), "key")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), h AS (SELECT DISTINCT doc_id, item_id, s, iw.m AS m FROM dw JOIN iw ON dw.k = iw.k AND dw.m = iw.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
