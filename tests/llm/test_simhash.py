import hashlib
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tallyroll.llm import simhash


def slow_print(text):
    votes = [0] * 128
    for term in re.split(r"[^\w]|_", text.lower()):
        if term:
            w = min(8, max(1, len(term) - 2))
            h0 = xxhash.xxh64_intdigest(term.encode(), seed=42)
            h1 = xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=h0)
            for i in range(64):
                votes[i] += w if h0 >> i & 1 else -w
                votes[64 + i] += w if h1 >> i & 1 else -w
    hi, lo = (sum((v > 0) << i for i, v in enumerate(votes[a : a + 64])) for a in (0, 64))
    return f"{hi:016x}{lo:016x}"


def test_against_brute_force(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdéö") for _ in range(rnd.randint(1, 9)))
    rows = [(i * 3, " ".join(word() for _ in range(rnd.randint(1, 60)))) for i in range(40)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (152, None), (153, ""), (154, "?!"), (155, "a"), (156, "🙂b " * 400), (None, "no id")]
    rows += [(200, "twice"), (200, "twice"), (200, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("clash"), "hi": F.lit(1), "place": F.lit(2)})
    got = simhash.fingerprint_documents(docs, query_every=50).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    # ascending ids, nulls first, ties by hash of id and text; rows that repeat count once
    key = lambda r: (r[0] is not None, r[0] or 0)
    order = sorted({(i, t or "") for i, t in rows}, key=key)
    by_sha = {(r.doc_id, r.edited_sha256): r for r in got}
    of_text = {t: slow_print(t) for _, t in order}
    checked = 0
    for at, (i, t) in enumerate(order):
        nexts = [order[(at + 1) % len(order)]]
        if i == 200 or order[(at + 1) % len(order)][0] == 200:  # ties: any order of the two texts
            nexts = [o for o in order if o[0] in (200, None)]
        found = None
        for _, n in nexts:
            half = len(t) // 2
            edited = t[: len(t) - half] + n[:half]
            found = found or by_sha.get((i, hashlib.sha256(edited.encode()).hexdigest()))
            if found:
                assert found.fingerprint == of_text[t] and found.n_chars == len(t)
                assert found.edited_fingerprint == slow_print(edited)
                checked += 1
                break
        assert found, (i, t)
    assert checked == len(order)
    same = [r for r in got if r.doc_id in (9, 150, 151)]
    assert len({r.fingerprint for r in same}) == 1 and {r.class_id for r in same} == {9}
    value = {i: int(of_text[t], 16) for i, t in order if i != 200}
    for r in got:
        if r.doc_id in (0, 150):
            near = sum((int(x.fingerprint, 16) ^ value[r.doc_id]).bit_count() <= 6 for x in got) - 1
            assert r.n_within == near
        elif r.doc_id is None or r.doc_id % 50:
            assert r.n_within is None
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert simhash.fingerprint_documents(docs.limit(0)).collect() == []
    one = simhash.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_all_prints_within_radius(spark):
    rnd = random.Random(4)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = [rnd.getrandbits(128) for _ in range(120)]
    for p in prints[:40]:
        for d in (1, 3, 6, 7, 9):
            prints.append(p ^ sum(1 << b for b in rnd.sample(range(128), d)))
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    df = spark.createDataFrame(rows, "hi long, lo long")
    asked = df.limit(60)
    some = {tuple(r) for r in asked.collect()}
    whole = lambda hi, lo: (hi % (1 << 64) << 64) | lo % (1 << 64)
    for radius in (6, 3):
        got = simhash.within_radius(df, asked, radius).collect()
        want = {(q, p) for q in some for p in rows if (whole(*q) ^ whole(*p)).bit_count() <= radius}
        assert {((r.qhi, r.qlo), (r.hi, r.lo)) for r in got} == want and len(got) == len(want)


def test_near_classes_name_the_near_copies(spark):
    rnd = random.Random(7)
    text = [f"word{rnd.randint(0, 9999)}" for _ in range(1500)]
    changed = lambda n: " ".join(["x"] * n + text[n:])
    rows = [(50, changed(0)), (51, changed(1)), (52, changed(1)), (53, changed(2)), (54, changed(40)), (None, changed(3)), (100, "other"), (101, "other"), (150, None)]
    found = simhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    got = found.collect()
    value = lambda r: int(r.fingerprint, 16)
    near = lambda r: {((value(r) ^ value(x)).bit_count(), x.class_id, x.fingerprint) for x in got if (value(r) ^ value(x)).bit_count() <= 6}
    for r in got:
        if r.doc_id is None or r.doc_id % 50:
            assert r.near_classes is None
        else:
            assert set(map(tuple, r.near_classes)) == near(r) and len(r.near_classes) == len(near(r))
    asked = [r for r in got if r.doc_id in (50, 100, 150)]
    assert any(0 < m.distance <= 6 for m in asked[0].near_classes + asked[1].near_classes + asked[2].near_classes)
    pairs = Counter((r.doc_id, r.distance, r.class_id, r.fingerprint) for r in simhash.near_pairs(found).collect())
    assert pairs == Counter((r.doc_id, *m) for r in asked for m in r.near_classes)


def test_block_tables_are_not_broadcast(spark):
    """Each print is 28 rows of the tables, which Spark sizes as one: a broadcast would fill the driver."""
    half = lambda salt: F.xxhash64("id", F.lit(salt))
    prints = spark.range(500).select(half(1).alias("hi"), half(2).alias("lo"))
    queries = prints.filter("pmod(hi, 5) = 0")
    found = simhash.within_radius(prints, queries)
    assert found.filter("distance = 0").count() == queries.count()
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
