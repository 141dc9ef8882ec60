"""Reproducible shuffle into shards: a keyed permutation of global row numbers."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import dense_ordinal

_PRIME = (1 << 31) - 1
_ROUNDS = 6


def _round_keys(seed: int) -> list[int]:
    digest = hashlib.sha256(str(seed).encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") % _PRIME for i in range(_ROUNDS)]


def permuted(index: Column, rows: int, seed: int) -> Column:
    """Place of row number ``index`` (0 to ``rows`` - 1) in a keyed shuffle of ``rows`` rows.

    A Feistel network over pairs (left, right) with left below ``a`` and right
    below ``b``, where ``a * b`` is the least such rectangle of at least ``rows``
    cells near the square. A result outside the rows is permuted again (cycle
    walking). Fewer than ``a`` cells lie outside, so a walk of more than one step
    has odds of one in the root of the rows for each step; ``raise_error`` tells
    if 32 steps were ever not enough, which needs odds of root(rows) ** -32.
    """
    if rows >= 1 << 52:
        raise ValueError("division by doubles is exact below 2 ** 52 rows only")
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    b = max(1, -(-rows // a))
    steps = min(a * b - rows + 1, 32)
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(i % 2 == 0).alias("left"))
                     for i, k in enumerate(_round_keys(seed))])

    def mixed(value: Column, key: Column) -> Column:
        t = (value + key) % _PRIME
        return (t * t % _PRIME) * ((t + 12345) % _PRIME) % _PRIME

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        end = F.aggregate(keys, start, lambda s, k: F.struct(
            F.when(k.left, (s.l + mixed(s.r, k.k)) % a).otherwise(s.l).alias("l"),
            F.when(k.left, s.r).otherwise((s.r + mixed(s.l, k.k)) % b).alias("r")))
        return end["l"] + end["r"] * a

    place = once(index.cast("long"))
    if steps > 1:
        place = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), place,
                            lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    return F.when(place < rows, place).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shuffle_into_shards(
    docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's shard and slot after a shuffle that anyone can compute from its row number.

    Rows are numbered by ``id_col`` (nulls first), the permuted number ``p`` gives
    shard ``p mod shards`` and slot ``p div shards``: row counts of shards differ by
    one at most, slots are gapless from 0. Only id, size and checksum travel; texts
    are read once and never shuffled. Rows of equal id, size and checksum are
    interchangeable; each gets a place of its own. A null text has size 8 and
    checksum 0. An empty table gives no rows. Other columns are ignored.

    The law is ``rows``, so ``grown_shard`` (law ``key``) is null.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = docs.count()
    numbered = dense_ordinal(
        narrow, F.col("doc_id").asc_nulls_first(), "size", "text_crc32", name="row_number"
    )
    place = permuted(F.col("row_number"), rows, seed)
    return numbered.withColumn("_p", place).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
