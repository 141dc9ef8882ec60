"""Exact Jaccard join of word-shingle sets: subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .shingles import WordHasher, shingle_set
from .tables import unused

_WORDS = 8  # longs in a set's parity bitmap
_WIDE = 256  # sets with more entries also have a bitmap of at least four bits an entry
_BITS = [f"b{i}" for i in range(_WORDS)]
_STAR_KEYS = 6  # lists of each node in the second round of stars
_LIST_BOUND = 64  # lists longer than this are moved to the end of the order
_MOST_HEAVY = 1 << 17  # at most so many keys are moved
_BEFORE = 4  # shared keys before an entry that it remembers
_SCAN_SHARE = 50  # list entries that can be scanned for the cost of one shuffled row


def overlap_needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that links to it."""
    return -(-percent * n // 100)


def _parities(s: np.ndarray, longs: int) -> np.ndarray:
    """One bit for each cell of ``64 * longs``: whether an odd number of entries falls into it."""
    return np.packbits(np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1)


def _sketch(size: int, percent: int, heavy: np.ndarray) -> Callable:
    """Arrow function: set id, set size, first keys in the order and parity bitmap of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            nodes, sizes, keys, bits, wide = [], [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size, hasher)
                n = len(s)
                sizes.append(n)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()) if n else None)
                bits.append(_parities(s, _WORDS))
                wide.append(_parities(s, 1 << (n // 16 - 1).bit_length()).view(np.int64) if n > _WIDE else None)
                if n and len(heavy):
                    late = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                    if late.any():
                        s = np.concatenate([s[~late], s[late]])
                keys.append(s[: min(n, n - overlap_needed(n, percent) + 2)])
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
            ids = np.array([v or 0 for v in nodes], np.uint64).view(np.int64)
            rows = np.concatenate([*bits, np.empty(0, np.uint8)]).view(np.int64).reshape(-1, _WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, mask=np.array([v is None for v in nodes], bool)),
                 pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(_WORDS)], pa.array(wide, pa.list_(pa.int64()))],
                ["doc_id", "th", "node", "n", "keys", *_BITS, "wide"])

    return run


def _first_keys(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = (shingle_set(text.as_py(), size, hasher) for text in batch.column(0))
            found = [s[: len(s) - overlap_needed(len(s), percent) + 1] for s in sets if len(s)]
            flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            for at in range(0, len(flat), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 19)])], ["key"])

    return run


class _Sets:
    """Shingle sets by node, so that a node met again is not hashed again; forgets all beyond two million entries."""

    def __init__(self, size: int) -> None:
        self._size, self._hasher, self._sets, self._held = size, WordHasher(), {}, 0

    def of(self, node: int, text: pa.Scalar) -> np.ndarray:
        found = self._sets.get(node)
        if found is None:
            if self._held > 2_000_000:
                self._sets, self._held = {}, 0
            found = self._sets[node] = shingle_set(text.as_py(), self._size, self._hasher)
            self._held += len(found) + 100
        return found


def _verified(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(i) for i in range(4)), strict=True):
                left, right = sets.of(a.as_py(), ta), sets.of(b.as_py(), tb)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["u", "v"])

    return run


def _wide_may_link(percent: int) -> Column:
    """As ``_may_link``, by the wide bitmaps; the longer one is folded, as linked sizes differ by less than a half."""
    a, b = F.col("wa"), F.col("wb")

    def folded(x: Column, to: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), to), F.slice(x, to + 1, to), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > to, half).otherwise(x)

    short = F.least(F.size(a), F.size(b))
    odd = F.zip_with(folded(a, short), folded(b, short), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    total = F.aggregate(odd, F.lit(0), lambda x, y: x + y)
    return a.isNull() | b.isNull() | (total <= _most_apart(percent, F.col("na"), F.col("nb")))


def _apart(a: str, b: str) -> Column:
    """Least number of elements in one set only: every bit that differs is one."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS])


def _may_link(percent: int, a: str, b: str) -> Column:
    """Neither sizes nor parity bitmaps rule out a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (_apart(a, b) <= _most_apart(percent, na, nb))


def _most_apart(percent: int, na: Column, nb: Column) -> Column:
    """Most elements in one set only that a linked pair can have."""
    total = (na + nb).cast("long")
    needed = F.ceil(total * percent / F.lit(100 + percent)).cast("long")
    return total - 2 * needed


def link_documents(
    docs: DataFrame, *, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: components of all pairs at the threshold.

    Also ``th``, the hash of the text, and ``keep``, true for one row of each component
    and for rows without shingles.

    1. *Order.* Keys are 64-bit shingle hashes in hash order, but keys that stand
       among the first of many sets come last, so lists of passages that many texts
       share are not scanned. These are the keys that are first in more than 64 texts, or of
       them the most frequent, at most 131,072. The order changes cost, never results.
    2. *Copies.* Rows of equal sets are one node (64-bit hash of the set) from here on.
    3. *Stars.* In each list of first and second keys every node is checked against
       the one of lowest id. This joins most of a group of near copies with one
       check per node; what is joined is one label from here on, and pairs inside a
       label are not looked at again. A second round checks what is left against members
       of the largest label of each of its first lists.
    4. *Large sets* scan inverted lists: a set needs its first n - t + 1 keys listed
       (t: least overlap) to meet each partner. A pair is a candidate where its first
       common key can be (none among the four shared keys before it on either side), positions, sizes
       and parity bitmaps allow.
       *Small sets* among each other meet in the two-key subsets of their first
       n - t + 2 keys instead. The boundary is the largest size whose subsets cost less
       than its lists, by the measured mean list length.
    5. Candidates that a wider bitmap allows, too, are checked on whole texts: first the likeliest of each
       pair of labels, then all that still lie between two labels. Each step's labels are contracted
       by the components of the links found, so those joins have a row per label, not per link.

    Null and empty texts and texts without words have 0 shingles and are linked
    with nothing. Repeated rows link with each other; a component's id is its least
    non-null id (null if there is none). Very long texts are whole. An empty table
    gives no rows. Other columns are ignored.
    """
    if not 51 <= percent <= 100:  # at 50 and less sets of two may share one key only, which the lists do not find
        raise ValueError("percent must be 51 to 100")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    firsts = base.select(F.col("text").cast("binary")).mapInArrow(_first_keys(shingle, percent), "key long")
    counts = written(firsts.groupBy("key").count().filter(F.col("count") > _LIST_BOUND), "key-counts")
    heavy = np.sort(np.array([r.key for r in _heaviest(counts, _MOST_HEAVY).select("key").collect()], np.int64).view(np.uint64))

    ddl = (f"doc_id {id_type}, th long, node long, n int, keys array<long>, " + ", ".join(f"{c} long" for c in _BITS)
           + ", wide array<long>")
    sketch = written(
        base.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary"))
        .mapInArrow(_sketch(shingle, percent, heavy), ddl)
        .withColumn("row", F.monotonically_increasing_id()),
        "sketch")
    nodes = written(_first_rows(sketch.filter("node is not null")), "nodes")
    texts = base.withColumn("th", F.xxhash64("text"))
    wides = nodes.select("node", F.col("n").alias("size"), "wide")

    def tight(pairs: DataFrame) -> DataFrame:
        """Written pairs that the wide bitmaps allow, too; pairs with a small set have none."""
        a, b = (wides.select(F.col("node").alias(e), F.col("size").alias(f"n{e}"), F.col("wide").alias(f"w{e}")) for e in "ab")
        large = pairs.filter(F.col("least_n") > _WIDE).join(a, "a").join(b, "b").filter(_wide_may_link(percent))
        return pairs.filter(F.col("least_n") <= _WIDE).union(large.select(*pairs.columns))

    def fetched(pairs: DataFrame) -> DataFrame:
        """``node, text`` of both ends of the pairs: one text a node, however often its row is repeated."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        named = nodes.select("node", "doc_id", "th").join(ends, "node", "left_semi").select(
            "node", F.col("doc_id").alias("_id"), "th")
        found = texts.join(named, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (texts.th == named.th)).select(
            "node", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
        return _first_rows(written(found, "ends")).select("node", "text")

    def verify(pairs: DataFrame, ends: DataFrame) -> DataFrame:
        sides = pairs.select("a", "b").join(ends.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
            ends.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        return written(sides.mapInArrow(_verified(shingle, percent), "u long, v long"), "links")

    narrow = nodes.select("node", "doc_id", "n", *_BITS, F.element_at("keys", 1).alias("k1"),
                          F.try_element_at("keys", F.lit(2)).alias("k2"))
    stars = [_star_pairs(narrow, k, percent) for k in ("k1", "k2")]
    pairs = written(tight(written(stars[0].union(stars[1]).distinct(), "stars")), "pairs")
    links = verify(pairs, fetched(pairs))
    first = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))  # u is the centre
    starred = nodes.select("node").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels, _ = _contracted(written(starred, "labels"), links)
    pairs = written(tight(written(_second_stars(nodes, labels, percent), "stars")), "pairs")
    labels, _ = _contracted(labels, verify(pairs, fetched(pairs)))

    about = nodes.select("row", "node", "n", *_BITS).join(labels, "node")
    listed = nodes.select(
        "row", F.posexplode(F.slice("keys", 1, F.size("keys") - (F.col("n") > 1).cast("int"))).alias("i", "key"))
    before = Window.partitionBy("row").orderBy("i").rowsBetween(-_BEFORE, -1)
    lists = _of_shared_keys(listed, about, before=F.collect_list("key").over(before))
    scans = lists.groupBy("key").count().agg(F.sum(F.col("count") ** 2)).first()[0] or 0
    entries = nodes.agg(F.sum(F.size("keys") - (F.col("n") > 1).cast("int"))).first()[0] or 1
    boundary = _boundary(scans / entries, percent)
    scanned = _scanned(lists, boundary, percent)
    light = nodes.filter((F.col("n") > 1) & (F.col("n") <= boundary))
    pairs_of_keys = F.flatten(F.transform("keys", lambda x, i: F.transform(
        F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    subsets = _of_shared_keys(light.select("row", F.explode(pairs_of_keys).alias("key")), about)
    a, b = subsets.alias("a"), subsets.alias("b")
    met = a.join(
        b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.label") != F.col("b.label")) & _may_link(percent, "a", "b")).select(*_chosen())
    met = written(scanned.union(met).distinct(), "met")
    candidates = written(tight(met).withColumn("pair", F.monotonically_increasing_id()), "candidates")
    ends = fetched(candidates)
    # of all pairs between two labels the likeliest first; what it joins needs no other check
    likeliest = written(candidates.groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(
        F.min_by("pair", "apart").alias("pair")).select("pair"), "likeliest")
    labels, moved = _contracted(labels, verify(candidates.join(likeliest, "pair", "left_semi"), ends))
    rest = candidates.join(likeliest, "pair", "left_anti")
    for end in ("la", "lb"):
        rest = rest.join(moved.select(F.col("label").alias(end), F.col("to").alias(f"to_{end}")), end, "left")
    labels, _ = _contracted(labels, verify(rest.filter("coalesce(to_la, la) <> coalesce(to_lb, lb)"), ends))

    lowest = sketch.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.min("row").alias("any_row"), F.min_by("row", "doc_id").alias("low_row"))
    labelled = lowest.join(labels, "node")
    of_label = labelled.groupBy("label").agg(
        F.min("low").alias("component_id"), F.coalesce(F.min_by("low_row", "low"), F.min("any_row")).alias("keeper"))
    of_node = labelled.join(of_label, "label").select("node", "component_id", "keeper")
    return sketch.select("doc_id", "th", "row", "node", F.col("n").cast("long").alias("n_shingles")).join(
        of_node, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "th", F.coalesce(F.col("row") == F.col("keeper"), F.lit(True)).alias("keep"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of least id, and all that have no shingles.

    A row is found again by id and hash of its text. Of repeated rows one stays, also
    of those without shingles.
    """
    found = link_documents(docs, id_col=id_col, text_col=text_col, **how)
    key, th, copies = (unused(docs.columns, c) for c in ("id", "th", "copies"))
    rows = found.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(
        F.max("keep").alias("keep"), F.count("*").alias(copies))
    stay = written(rows.filter("keep").drop("keep"), "kept")
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(th)))
    once = kept.filter(F.col(copies) == 1)
    return once.union(kept.filter(F.col(copies) > 1).dropDuplicates([id_col, th])).select(*docs.columns)


def _first_rows(table: DataFrame) -> DataFrame:
    """One row of each node, of a written table with a ``row`` number: chosen by narrow columns only."""
    return table.join(table.groupBy("node").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")


def _contracted(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, label`` after the links, and ``label, to`` of labels that changed: linked ones become the least of them."""
    ends = links
    for end in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
    between = written(ends.filter("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(), "label-pairs")
    moved = written(components(between).filter("node <> label").select(
        F.col("node").alias("label"), F.col("label").alias("to")), "moved")
    return written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"), moved


def _star_pairs(narrow: DataFrame, key: str, percent: int) -> DataFrame:
    """Every node with the lowest-id node of its list, where sizes and bitmaps allow a link."""
    centres = narrow.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by("node", "doc_id").alias("centre"),
        F.count("*").alias("c")).filter("c > 1 and centre is not null").select(F.col(key), "centre")
    members = narrow.join(centres, key).filter("node <> centre").alias("m")
    return members.join(narrow.alias("c"), F.col("m.centre") == F.col("c.node")).filter(
        _may_link(percent, "m", "c")).select(
        F.col("m.centre").alias("a"), F.col("m.node").alias("b"), F.least("m.n", "c.n").alias("least_n"))


def _second_stars(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Nodes with a member of the largest label of each list of their first keys, if theirs is another.

    Each list draws its own member, so a node far from one of a large group meets others of it.
    """
    members = labels.groupBy("label").agg(F.count("*").alias("members"))
    listed = nodes.select("node", F.explode(F.slice("keys", 1, _STAR_KEYS)).alias("key")).join(labels, "node").join(
        members, "label")
    drawn = F.col("members") * 1024 + F.pmod(F.xxhash64("node", "key"), F.lit(1024))
    centres = listed.groupBy("key").agg(
        F.max_by("node", drawn).alias("centre"), F.max_by("label", drawn).alias("other"),
        F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key", "centre", "other")
    met = listed.join(centres, "key").filter("label <> other").select("centre", "node").distinct()
    narrow = nodes.select("node", "n", *_BITS)
    m = met.join(narrow, "node").alias("m")
    return m.join(narrow.alias("c"), F.col("m.centre") == F.col("c.node")).filter(_may_link(percent, "m", "c")).select(
        F.col("m.centre").alias("a"), F.col("m.node").alias("b"), F.least("m.n", "c.n").alias("least_n"))


def _chosen() -> list[Column]:
    """Columns of a pair of list entries ``a`` and ``b`` that a candidate keeps."""
    return [F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("la"),
            F.col("b.label").alias("lb"), F.least("a.n", "b.n").alias("least_n"), _apart("a", "b").alias("apart")]


def _scanned(lists: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Pairs of two labels in the same list, one of them a large set; few are met in more than one list.

    A pair whose entries both remember one key was met in the list of that key or of an
    earlier one: places only grow from there. Its first common key stands in neither memory.
    """
    a, b = lists.alias("a"), lists.alias("b")
    return a.join(
        b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.label") != F.col("b.label")) & (F.greatest("a.n", "b.n") > boundary)
        & (F.col("a.i") + F.col("b.i") <= _most_apart(percent, F.col("a.n"), F.col("b.n")))
        & _may_link(percent, "a", "b") & ~F.arrays_overlap("a.before", "b.before")).select(*_chosen())


def _heaviest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``key, count`` with the highest counts: all if they are no more than ``most``, else at most ``most``.

    Counts are told apart by quarters of a power of two, so the number kept is found from a few hundred rows.
    """
    graded = counts.withColumn("grade", F.floor(4 * F.log2("count")))
    least, kept = 0, 0
    for grade, keys in sorted(map(tuple, graded.groupBy("grade").count().collect()), reverse=True):
        kept += keys
        if kept > most:
            least = grade + 1
            break
    return graded.filter(F.col("grade") >= least).select(*counts.columns)


def _of_shared_keys(listed: DataFrame, about: DataFrame, **more: Column) -> DataFrame:
    """List entries whose key stands in two nodes or more, with ``more`` columns over them and what is known of the nodes.

    Entries are shuffled bare, since most keys are rare; the few that stay are
    completed and written, as they are joined with themselves.
    """
    dealt = listed.repartition("key")
    shared = dealt.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("lo <> hi").select("key")
    return written(dealt.join(shared, "key", "left_semi").withColumns(more).join(about, "row"), "lists")


def _boundary(list_length: float, percent: int) -> int:
    """Largest set size whose two-key subsets cost no more than listing and scanning its first keys."""
    n = 1
    while n < 100_000:
        first = n + 1 - overlap_needed(n + 1, percent) + 1
        subsets = min(n + 1, first + 1) * min(n, first) / 2
        if subsets > first * (1 + list_length / _SCAN_SHARE):
            return n
        n += 1
    return n


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS u, doc_id AS m FROM s UNION SELECT r.u, e.v FROM r JOIN e ON r.m = e.u)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(m) AS component_id FROM s JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, sh
"""
