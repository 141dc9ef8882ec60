"""Dense ordinals and exact-size selection without a single-partition window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_ordinal(
    df: DataFrame, *order: Column | str, name: str = "ordinal", unique: bool = False
) -> DataFrame:
    """0-based position of every row in ``order``.

    Rows are range-partitioned and sorted once; the sorted rows are written to
    the shared folder with their place, so the per-partition counts and the rows
    they number can never come from two different runs of a lost task, and the
    input is computed once. Only the counts, one row per partition, are broadcast.
    Callers number narrow rows and join wide ones by key.

    Unless the order is ``unique``, a tie-breaking row number is written first: a
    run of equal rows then splits over several partitions, and a repeated task
    still routes each of them the same way.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    if not unique:
        df = written(df.withColumn("_tie", F.monotonically_increasing_id()), "ties")
        keys.append(F.col("_tie"))
    ranged = written(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordinal",
    )
    part = F.shiftright("_at", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    numbered = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    return numbered.withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")


def seeded_hash(key: Column | str, *salts: object) -> Column:
    """Reproducible shuffle key: md5 of the salts and the row key as text."""
    parts = [F.lit(str(s)) for s in salts] + [F.col(key) if isinstance(key, str) else key]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def mark_first_n(
    df: DataFrame, order: Column, tie: str, size: Callable[[int], int], name: str
) -> DataFrame:
    """Flag exactly the first ``size(rows)`` rows by ``(order, tie)``; ``order`` is hex text.

    The last flagged key is found digit group by digit group: rows per 4-digit
    group are counted (65,536 counts at most), the group holding that row is
    entered, and only what is left of it is ordered. No global sort.
    """
    keyed = df.withColumn("_h", order)
    rest, room = keyed.select("_h", tie), None
    for at in (1, 5):
        group = F.substring("_h", at, 4)
        counts = rest.groupBy(group.alias("_p")).agg(F.count("*").alias("_c"))
        sizes = sorted((r["_p"], r["_c"]) for r in counts.collect())
        if room is None:
            room = size(sum(c for _, c in sizes))
        for prefix, count in sizes:
            if room <= count:
                break
            room -= count
        else:  # fewer rows than asked for
            return keyed.withColumn(name, F.lit(True)).drop("_h")
        rest = rest.filter(group == prefix)
    last = rest.orderBy("_h", tie).offset(room - 1).limit(1).first()
    inside = (F.col("_h") < last["_h"]) | (
        (F.col("_h") == last["_h"]) & (F.col(tie) <= last[tie])
    )
    return keyed.withColumn(name, inside).drop("_h")
