import hashlib
import random
import re

from pyspark.sql import functions as F

from tallyroll.llm import contamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(text, items, window=10):
    d, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            for at in range(len(d) - m + 1):
                if d[at : at + m] == w[s : s + m]:
                    hit |= set(range(at, at + m))
                    found.add(str(item_id))
    return len(d), len(hit), sorted(found)


def check(spark, docs, items, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "term": F.lit(1), "items": F.lit(2)})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumns({"n": F.lit(1), "words": F.lit("clash")})
    got = contamination.find_contamination(df, tests, **how).collect()
    assert len(got) == len(docs)
    want = {(i, t): slow(t, items) for i, t in docs}
    for (i, t), (n, hit, found) in want.items():
        own = [r for r in got if r.doc_id == i and (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
               and r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0)]
        assert own, (i, t, n, hit, found)
    return got


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "of", "a", "b", "É", "x9", "Long"]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", " -"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 80))
        if i % 2:
            t += " " + rnd.choice(items)[1] + " " + text(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "z " * 20_000 + items[0][1]), (104, docs[5][1]), (None, items[3][1]), (7, "other text"),
             (105, docs[5][1]), (105, docs[5][1])]
    items += [(50, None), (51, ""), (52, "..."), (53, "words that no text has at all in any place of it")]
    assert any(r.contaminated for r in check(spark, docs, items))
    check(spark, docs, items, common=1.0)  # no list is intersected first
    check(spark, docs, items, common=0.0)  # every list is


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + item + " y"), (2, "one two really three four five six seven eight neuf ten"), (3, "nine nine nine"),
            (4, "unus duo three four eight")]
    got = {r.doc_id: r for r in check(spark, docs, [(9, item)])}
    assert (got[1].near_items, got[2].near_items, got[4].near_items) == ([], ["9"], [])


def test_proximity_with_rare_and_absent_words(spark):
    """Against brute force: the replaced word is the rarest of the item, or a word that no text has."""
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "one two three four five six seven eight neuf ten"), (2, "one two really three four five six seven eight neuf ten"),
            (3, "one two four five six seven eight ten"), (4, "two three four five six seven eight"), (5, "ten nine eight seven six five four three two one")]
    docs += [(10 + i, "one two three four five six seven eight ten " * 3) for i in range(3)]
    items = [(9, item), (8, "one two three absent1 five six seven eight absent2 ten"), (7, "one two absent3 absent1 five six seven eight absent2 ten"), (6, "ten one")]

    def near(text):
        d, found = words(text), []
        for i, t in items:
            w = words(t)
            m = min(10, len(w))
            ok = any(10 * sum(x in d[max(0, at + j - 3) : max(0, at + j + 4)] for j, x in enumerate(w[s : s + m], s)) >= 8 * m
                     for at in range(-len(w) - 3, len(d) + 4) for s in range(len(w) - m + 1))
            if ok and str(i) not in slow(text, items)[2]:
                found.append(str(i))
        return sorted(found)

    for r in check(spark, docs, items):
        assert r.near_items == near(dict(docs)[r.doc_id]), r
    assert near(docs[0][1]) and "9" in near(docs[0][1]) and "8" in near(docs[0][1])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert contamination.find_contamination(none, no_items).collect() == []
    r = contamination.find_contamination(some, no_items).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
