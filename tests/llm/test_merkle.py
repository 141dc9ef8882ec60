import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyroll.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow(rows, fan_out):
    """{(group, id, leaf): [(subroot, root, siblings), ...]} by plain lists."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([H(*at[i : i + fan_out]) for i in range(0, len(at), fan_out)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // fan_out * fan_out
            out += [h for j, h in enumerate(level[run : run + fan_out]) if run + j != i]
            i //= fan_out
        return out

    low = lambda v: (v is not None, v)
    groups = {}
    for g, i, leaf in rows:
        groups.setdefault(g, []).append((low(i), leaf))
    trees = {g: tree([leaf for _, leaf in sorted(own)]) for g, own in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for n, (i, leaf) in enumerate(sorted(groups[g])):
            found.append((g, i[1], leaf, trees[g][-1][0], top[-1][0], "".join(path(trees[g], n) + path(top, at))))
    return found


def corpus():
    rows = [("hot", i * 7 % 5003, H(str(i))) for i in range(600)] + [(None, i, H("n", str(i))) for i in range(9)]
    rows += [("one", 5, H("x")), ("Z", 1, H("z")), ("é", 1, H("e")), ("", 2, H("")), ("", None, H("null")), ("eight", None, H("y"))]
    rows += [("eight", i, H("same")) for i in range(7)] + [("ties", 3, H("same"))] * 20 + [(f"g{i}", 1, H(f"g{i}")) for i in range(20)]
    return rows


@pytest.mark.parametrize("fan_out, levels", [(8, 4), (2, 3), (3, 2)])
def test_against_brute_force(spark, monkeypatch, fan_out, levels):
    monkeypatch.setattr(merkle, "_LEVELS", levels)  # small blocks: several tables of upper nodes
    rows = corpus()
    leaves = spark.createDataFrame([(*r, "extra", "old") for r in rows], "lang string, doc_id long, leaf string, g string, root string")
    got = merkle.prove(leaves.repartition(7), fan_out=fan_out)
    assert got.columns == ["lang", "doc_id", "leaf", "g", "subroot", "root", "proof"]
    got = got.withColumn("others", merkle.siblings(F.col("proof"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))
    found = got.select("lang", "doc_id", "leaf", "subroot", "root", "others", "folded").collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, slow(rows, fan_out)))
    assert all(r.folded == r.root for r in found)


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(None, None, "ab")], "lang string, doc_id long, leaf string")
    row = merkle.prove(one).first()
    assert (row.subroot, row.root, row.proof) == ("ab", "ab", [])
    assert merkle.prove(one.limit(0)).collect() == []


def test_leaf_and_tampering(spark):
    rows = spark.createDataFrame([(1, "é", None), (2, "", "x" * 100_000), (None, None, "A")], "a long, b string, c string")
    got = [r[0] for r in rows.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [H("1:1", "2:é", "-"), H("1:2", "0:", "100000:" + "x" * 100_000), H("-", "-", "1:A")]
    leaves = spark.createDataFrame([("l", i, H(str(i))) for i in range(70)], "lang string, doc_id long, leaf string")
    proofs = merkle.prove(leaves)
    wrong = proofs.filter(merkle.fold(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root"))
    assert wrong.count() == 0


def test_no_join_where_proofs_are_emitted(spark):
    leaves = spark.createDataFrame([("l", i, H(str(i))) for i in range(70)], "lang string, doc_id long, leaf string")
    plan = merkle._emitted(
        leaves.select(F.col("lang").alias("g"), F.col("doc_id").alias("r"), F.lit(70).cast("long").alias("n"), F.col("leaf").alias("hash"), F.struct("doc_id").alias("item")),
        spark.createDataFrame([], "g string, r long, above struct<proof:array<struct<position:int,siblings:array<string>>>,subroot:string,root:string>"), 8,
    )._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_query_shows_a_third_in_lower_case(spark):
    from tallyroll.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_merkle_manifest"](spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[i] or "")
        assert r.verified == (not changed)
