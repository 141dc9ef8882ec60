"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, label)`` for every node of the ``(u, v)`` edges; the label is the least node reached.

    Large-star and small-star steps alternate until nothing changes, in rounds
    that grow with the logarithm of the longest path; with ``rounds``, so many
    only, after which nodes of one label are connected but not yet the reverse.
    Each round is written, so lineage stays short. Joins have one row per node on
    one side, so a node with very many edges is a skewed side that adaptive
    execution splits. Loops and repeated edges are harmless; null ends are
    dropped; no edges give no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, done = None, 0
    while rounds is None or done < rounds:
        seen = Observation()
        summed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        e = written(_small_star(_large_star(e)).observe(seen, F.count(F.lit(1)).alias("n"), summed.alias("s")), "edges")
        now, done = (seen.get.get("n"), seen.get.get("s")), done + 1
        if now == before:
            break
        before = now
    labels = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct().join(labels, "node", "left_anti")
    return labels.unionByName(heads)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
