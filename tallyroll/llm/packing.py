"""Best-fit packing of texts into fixed-size sequences, with conflicts between texts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

_GROUP = 4096  # expected pieces that one group packs


class Bins:
    """Open bins in order of what is left in them, each with bitmaps of its sources and clusters.

    Bins of equal residual, source bitmap and cluster bitmap are interchangeable, so
    they share one entry of the ordered list and a successor search passes them at once.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self._order: list[tuple[int, int, int]] = []  # (residual, sources, clusters), sorted
        self._open: dict[tuple[int, int, int], list[int]] = {}
        self.count = 0

    def put(self, size: int, source: int, cluster: int) -> int:
        """The tightest bin that fits and has neither the source nor the cluster bit; a new one if there is none."""
        at = bisect_left(self._order, (size, -1, -1))
        while at < len(self._order):
            left, sources, clusters = self._order[at]
            if not sources & source and not clusters & cluster:
                break
            at += 1
        else:
            self.count += 1
            self._keep((self.capacity - size, source, cluster), self.count - 1)
            return self.count - 1
        entry = self._order[at]
        chosen = self._open[entry].pop(0)
        if not self._open[entry]:
            del self._open[entry], self._order[at]
        self._keep((left - size, sources | source, clusters | cluster), chosen)
        return chosen

    def _keep(self, entry: tuple[int, int, int], number: int) -> None:
        if entry[0] <= 0:
            return
        if entry not in self._open:
            self._open[entry] = []
            insort(self._order, entry)
        self._open[entry].append(number)


def pack(pieces: Sequence[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin of every (size, source, cluster), largest first, ties in the given order.

    No two pieces of one source share a bin, nor two of one cluster; None conflicts
    with nothing. Only values that occur twice need a bit.
    """
    bits: list[dict] = []
    for k in (1, 2):
        often = [v for v, c in Counter(p[k] for p in pieces).items() if v is not None and c > 1]
        bits.append({v: 1 << i for i, v in enumerate(often)})
    bins, out = Bins(capacity), [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, source, cluster = pieces[i]
        out[i] = bins.put(size, bits[0].get(source, 0), bits[1].get(cluster, 0))
    return out


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("key", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        columns = [group.column(c).to_pylist() for c in ("size", "source", "cluster")]
        numbers, used = pack(list(zip(*columns, strict=True)), capacity), Counter()
        for number, size in zip(numbers, columns[0], strict=True):
            used[number] += size
        group = group.append_column("number", pa.array(numbers, pa.int64()))
        group = group.append_column("fill", pa.array([used[n] for n in numbers], pa.int64()))
        return group.select(["doc_id", "piece", "size", "group", "number", "fill"])

    return run


def pack_documents(
    docs: DataFrame, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str | None = "source", cluster_col: str | None = None, sources_per_bin: int = 1,
) -> DataFrame:
    """Every text's pieces and their bins: doc_id, piece, first_word, n_words, bin, fill.

    Sizes are words (runs of non-space). A text longer than ``capacity`` is cut into
    full pieces and a rest; a full piece is a bin of its own. Rests and shorter texts
    are packed best-fit: the tightest open bin, found by successor search over bins in
    order of what is left, whose source and cluster bitmaps allow the piece. Two
    texts of one cluster (default: equal texts) never share a bin, and at most
    ``sources_per_bin`` texts of one source do: a source then counts as that many,
    dealt by hash.

    Pieces are dealt by hash into groups of about 4,096, whose number grows with the
    input, and each group is packed by itself: memory and time of a task are bounded,
    no source, cluster or key decides the group, and what a group loses is its last
    few bins. Only sizes and ids are shuffled, never texts. Bins are named
    ``group-number``; equal inputs give equal bins.

    Null, empty and blank texts have no words and no row in any bin: they return with
    piece 0, 0 words and a null bin. Null sources conflict with nothing. Repeated rows
    are one cluster, so they go to different bins. An empty table gives no rows.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(text_col) if cluster_col is None else F.xxhash64(cluster_col)
    key = F.xxhash64(id_col, text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"),
        (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source"),
        (cluster if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), cluster)).alias("cluster"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n"))
    if source_col and sources_per_bin > 1:
        sized = sized.withColumn("source", F.concat_ws(
            "\x1f", "source", F.pmod(F.hash("key"), F.lit(sources_per_bin)).cast("string")))
    # repeated rows are counted, and dealt by their number: a row that makes up a third of the table spreads out
    counted = sized.groupBy("doc_id", "key", "source", "cluster", "n").agg(F.count("*").alias("c"))
    pieces = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")))
    ).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity))
    pieces = written(pieces, "pieces")
    alone = pieces.filter((F.col("size") == capacity) | (F.col("size") == 0))
    rest = pieces.filter((F.col("size") < capacity) & (F.col("size") > 0))
    groups = max(1, -(-rest.count() // _GROUP))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("key", "piece", "copy"), F.lit(groups)).cast("int"))
    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.select("doc_id", "key", "copy", "source", "cluster", "piece", "size", "group").groupBy("group").applyInArrow(
        _packed(capacity), f"doc_id {kind}, piece int, size long, group int, number long, fill long")
    first = (F.col("piece") * F.lit(capacity)).cast("long").alias("first_word")
    return packed.select(
        "doc_id", "piece", first, F.col("size").alias("n_words"),
        F.concat_ws("-", F.col("group").cast("string"), F.col("number").cast("string")).alias("bin"), "fill").union(alone.select(
            "doc_id", "piece", first, F.col("size").alias("n_words"),
            F.when(F.col("size") > 0, F.concat_ws("-", F.lit("full"), F.hex("key"), F.col("copy").cast("string"), F.col("piece").cast("string"))).alias("bin"),
            F.col("size").alias("fill")))
