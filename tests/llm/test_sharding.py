from collections import Counter
import zlib

import pytest
from pyspark.sql import functions as F

from tallyroll.llm import sharding


def places(spark, rows, seed=3):
    df = spark.range(rows).select(sharding.permuted(F.col("id"), rows, seed).alias("p"))
    return [r.p for r in df.collect()]


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 10, 31, 101, 1000])
def test_permutation_is_a_bijection(spark, rows):
    got = places(spark, rows)
    assert sorted(got) == list(range(rows)) and got == places(spark, rows)
    if rows >= 100:
        assert got != places(spark, rows, seed=4) and sum(a == i for i, a in enumerate(got)) < 10


def test_shards(spark):
    rows = [(i, "x" * i) for i in range(40)] + [(None, None), (None, ""), (7, "same"), (7, "same"), (8, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_p", F.lit(1))
    got = sharding.shuffle_into_shards(docs, 6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shuffle_into_shards(docs.limit(0), 6).collect() == []


def test_place_follows_from_row_number(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(50)], "doc_id long, text string")
    want = places(spark, 50, seed=17)
    assert all((r.slot * 24 + r.shard) == want[r.row_number] for r in sharding.shuffle_into_shards(docs, 24).collect())
