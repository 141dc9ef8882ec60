import random

import pytest
from pyspark.sql import functions as F

from tallyroll.llm import jaccard
from tallyroll.llm.components import components


def shingles(text, k):
    w = (text or "").lower().split() if not text or text.isascii() else "".join(c.lower() if c.isascii() else c for c in text).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def slow(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_twin(v):
    """Rows without id, each many times."""
    return " ".join(f"t{i}" for i in range(40)) + " end" * v


def long_texts(rnd):
    """Large sets that share a passage: some linked, some close to the threshold on either side."""
    common = [f"p{i}" for i in range(300)]
    for g in range(4):
        base = common + [f"g{g}x{rnd.randrange(10**6)}" for _ in range(900 + 200 * g)]
        for k in range(4):
            t = list(base)
            for i in rnd.sample(range(len(t)), [0, 5, 18 + 5 * g, 40][k]):
                t[i] = f"n{rnd.randrange(10**6)}"
            yield 6000 + 10 * g + k, " ".join(t)


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, common = [], " ".join(f"c{i}" for i in range(30))
    for g in range(14):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 4, 9, 10, 13, 30, 80, 200]))]
        for _ in range(rnd.choice([1, 2, 8])):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.3:
                t = t[: rnd.randint(max(1, len(t) - 5), len(t))]
            rows.append((len(rows) * 7 % 1000, " ".join(t)))
    rows += [(2000 + i, common + " " + " ".join(rnd.choice(words) for _ in range(20))) for i in range(90)]  # a passage many share
    near = [rnd.choice(words) for _ in range(120)]
    for i in range(70):  # one large group of near copies
        t = list(near)
        for _ in range(i % 6):
            t[rnd.randrange(120)] = rnd.choice(words)
        rows.append((3000 + i, " ".join(t)))
    rows += [(4000 + i, "Same\ttext  in\nmany rows") for i in range(40)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5005, "é x"), (5005, "é x"), (None, "one"), (None, None),
             *[(None, near_twin(v)) for v in range(2) for _ in range(60)], *long_texts(rnd), (5006, "w1 w2 w3 " * 4000), (5006, "another text of the same id here")]
    return rows


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("clash"), "keys": F.lit(1), "n": F.lit(2), "row": F.lit(3), "_id": F.lit(4), "_TH": F.lit(5), "th": F.lit(6), "id": F.lit(7), "copies": F.lit(8)})
    got = jaccard.link_documents(docs, shingle=k, percent=percent)
    want = slow(rows, k, percent)
    as_rows = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())))
    assert as_rows == sorted(map(repr, want))
    kept = jaccard.one_of_each(docs, shingle=k, percent=percent)
    assert kept.columns == docs.columns
    sets = [shingles(t, k) for _, t in rows]
    components_with_sets = {c for (_, n, c), s in zip(want, sets) if s}
    with_sets = [r for r in kept.collect() if shingles(r.text, k)]
    without = [(r.doc_id, r.text) for r in kept.collect() if not shingles(r.text, k)]
    assert len(with_sets) == len(components_with_sets) + (5006 in components_with_sets)  # two unlike texts have this id
    assert sorted(map(repr, without)) == sorted(map(repr, {(d, t) for (d, t), s in zip(rows, sets) if not s}))


def test_boundary_between_small_and_large():
    assert jaccard._boundary(0, 85) <= jaccard._boundary(100, 85) <= jaccard._boundary(10_000, 85)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_documents(none).collect() == [] and jaccard.one_of_each(none).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}


def test_thresholds_that_would_lose_links_are_errors():
    for percent in (0, 50, 101):
        with pytest.raises(ValueError, match="percent"):
            jaccard.link_documents(None, percent=percent)


def test_a_pair_is_met_in_few_lists(spark, monkeypatch):
    """Unlinked texts with most shingles in common share hundreds of first keys; a pair is not met once for each."""
    rnd, met, scanned = random.Random(3), [], jaccard._scanned
    monkeypatch.setattr(jaccard, "_scanned", lambda *a: met.append(scanned(*a)) or met[0])
    base = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(12):
        at = rnd.sample(range(3000), 90)
        rows.append((i, " ".join(f"n{rnd.randrange(10**9)}" if k in at else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.link_documents(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == slow(rows, 4, 85)
    assert 0 < met[0].count() <= 2 * met[0].distinct().count()


def test_frequent_keys_move_however_large_the_corpus(spark):
    rows = [(i, 100) for i in range(10)] + [(10, 10**9)]
    counts = spark.createDataFrame(rows, "key long, count long")
    assert sorted(r.key for r in jaccard._heaviest(counts, 1 << 17).collect()) == list(range(11))
    assert [r.key for r in jaccard._heaviest(counts, 10).collect()] == [10]  # equal counts move together or not at all
    assert jaccard._heaviest(counts.limit(0), 10).collect() == []
