import json
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyroll.functions import responses, similarity
from tallyroll.functions.similarity import best_candidates, greedy_pairs, token_sort_ratio
from tallyroll.operators import compare as C
from tallyroll.operators import jobs as J
from tallyroll.operators import scoring as S

def line(name, **values):
    return {"name": name, **values}


def score(spark, cases):
    rows = [(i, json.dumps(p), json.dumps(g)) for i, (p, g) in enumerate(cases)]
    df = spark.createDataFrame(rows, "receipt_id int, p string, g string").select(
        "receipt_id", S.scorable_json(F.col("p")).alias("pred"), S.scorable_json(F.col("g")).alias("gt")
    )
    return S.score_receipts(df).orderBy("receipt_id").collect()


def test_store_threshold(spark):
    """A name counts from a token-sort similarity of 80 on; the nested name wins over the flat one."""
    # 8 of 10 letters in common on both sides is exactly 80, 7 of 10 is below
    truth = {"store": {"name": "abcdefghij"}}
    named = {"at": "abcdefghxy", "under": "abcdefgxyz", "turned": "ABCDEFGHIJ"}
    got = score(spark, [({"store": {"name": v}}, truth) for v in named.values()])
    assert [r.store_name.f1 for r in got] == [1, 0, 1]
    flat, hidden, absent, invented, neither = score(
        spark,
        [
            ({"store_name": "kiosk nine"}, {"store": {"name": "nine kiosk"}}),
            ({"store": {"name": None}, "store_name": "nine kiosk"}, {"store_name": "nine kiosk"}),
            ({"note": 1}, {"store_name": "nine kiosk"}),
            ({"store_name": "nine kiosk"}, {"note": 1}),
            ({"note": 1}, {"note": 1}),
        ],
    )
    assert flat.store_name.f1 == hidden.store_name.f1 == 1
    assert (absent.store_name.n_pred, absent.store_name.n_gt, absent.store_name.recall) == (0, 1, 0)
    assert (invented.store_name.n_pred, invented.store_name.n_gt, invented.store_name.precision) == (1, 0, 0)
    assert (neither.store_name.n_pred, neither.store_name.n_gt, neither.store_name.f1) == (0, 0, 0)


@pytest.mark.parametrize("truth", [1, 73.4, 2048])
def test_total_tolerance(spark, truth):
    """Two percent of the true total, on either side; text is read as a number; a zero only equals a zero."""
    inside, outside = [truth * f for f in (0.985, 1.015)], [truth * f for f in (0.975, 1.025)]
    cases = [({"total": v}, {"total": truth}) for v in inside + outside]
    cases += [({"total": f"${truth}"}, {"total": truth}), ({"total": 0}, {"total": truth}),
              ({"total": truth}, {"total": 0}), ({"total": 0}, {"total": 0}), ({}, {"total": truth})]
    got = score(spark, cases)
    assert [r.total.f1 for r in got] == [1, 1, 0, 0, 1, 0, 0, 1, 0]
    assert [r.total.n_pred for r in got[-2:]] == [1, 0]


def test_item_counts_and_names(spark):
    """Precision and recall follow from how many of p predicted and g true lines pair up."""
    pool = [line(n) for n in ("quince", "walnut", "sorrel", "endive")]
    sizes = [(p, g) for p in range(5) for g in range(5)]
    got = score(spark, [({"items": pool[:p]}, {"line_items": pool[:g]}) for p, g in sizes])
    for (p, g), r in zip(sizes, got):
        both = min(p, g)
        assert r.item_count.f1 == (p == g)
        assert (r.item_name.n_pred, r.item_name.n_gt) == (p, g)
        assert r.item_name.precision == pytest.approx(both / p if p else 0)
        assert r.item_name.recall == pytest.approx(both / g if g else 0)


def test_item_values(spark):
    """Quantities and line totals compare by number only where names pair up."""
    def f1(field, pred, truth):
        return field, ({"items": [line("sorrel", **pred)]}, {"items": [line("sorrel", **truth)]})

    cases = [
        (1, f1("item_total", {"total": "8.07"}, {"total": 8})),
        (0, f1("item_total", {"total": 8.2}, {"total": 8})),
        (1, f1("item_total", {"total": 0, "unit_price": 3.5}, {"total": 3.5})),  # a zero falls through
        (0, f1("item_total", {"total": "0", "unit_price": 3.5}, {"total": 3.5})),  # the text 0 does not
        (1, f1("item_qty", {"quantity": "3"}, {"quantity": "3"})),
        (0, f1("item_qty", {"quantity": "4"}, {"quantity": "3"})),
        (0, f1("item_qty", {"quantity": 3}, {"quantity": 3.0})),  # quantities compare as text
        (0, f1("item_qty", {"quantity": 0}, {"quantity": 0})),
    ]
    got = score(spark, [case for _, (_, case) in cases])
    assert [r[field].f1 for r, (_, (field, _)) in zip(got, cases)] == [want for want, _ in cases]


def test_overall_is_the_mean_of_its_fields(spark):
    whole = {"store_name": "nine kiosk", "total": 12.5, "items": [line("quince", quantity="5", total=12.5)]}
    keys = list(whole)
    subsets = [keys[:i] for i in range(len(keys) + 1)]
    got = score(spark, [({k: whole[k] for k in s}, whole) for s in subsets])
    for r in got:
        fields = [r[f].f1 for f in ("store_name", "total", "item_name", "item_total", "item_qty")]
        assert r.overall_f1 == pytest.approx(sum(fields) / 5)
    assert [r.overall_f1 for r in got] == pytest.approx([0, 0.2, 0.4, 1])


def test_means(spark):
    one = {"total": 5}
    rows = [(i, json.dumps(p), json.dumps(g)) for i, (p, g) in enumerate([(one, one), ({"total": 9}, one)])]
    df = spark.createDataFrame(rows, "receipt_id int, p string, g string").select(
        "receipt_id", S.scorable_json(F.col("p")).alias("pred"), S.scorable_json(F.col("g")).alias("gt")
    )
    scored = S.score_receipts(df)
    mean = S.mean_scores(scored).first()
    assert (mean.total.f1, mean.total.precision, mean.total.n_gt) == (0.5, 0.5, 2)
    nothing = S.mean_scores(scored.filter("false")).first()
    assert nothing.total.f1 == 0.0 and nothing.total.n_gt == 0
    assert S.summary_rows(S.mean_scores(scored)).count() == 7


def test_matching_equals_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ab c") for _ in range(rnd.randrange(7)))
    rows = [
        (i, [word() for _ in range(rnd.randrange(7))], [word() for _ in range(rnd.randrange(7))])
        for i in range(400)
    ]
    rows += [
        (400, ["same"] * 5, ["same"] * 3),
        (401, ["abcdefghij", "abcdefg"], ["abcdefgxyz", "abcdefg"]),  # 70 exactly, then its twin
        (402, ["w" * 150, "v" * 64 + " x"], ["x " + "v" * 64, "w" * 149]),
    ]
    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>").repartition(3)
    for r in df.select("*", greedy_pairs("p", "g").alias("m"), best_candidates("p", "g").alias("b")).collect():
        assert r.m == brute.greedy(r.p, r.g), (r.p, r.g)
        for cell, (negative, j) in zip(r.b, brute.best(r.p, r.g)):
            assert cell.position == j and cell.ratio == pytest.approx(-negative)


def test_names_are_coded_once_a_batch(monkeypatch):
    """Receipts of many shapes share one set of masks; so many names that masks are not kept give the same pairs."""
    draw = random.Random(3)
    words = [" ".join(draw.choice(("red", "blå", "cup", "pan", "x" * 40)) for _ in range(n)) for n in (0, 1, 2, 3, 3, 5)]
    sides = [[[draw.choice(words) for _ in range(draw.randrange(5))] for _ in range(60)] for _ in range(2)]
    columns = [pa.array(side, pa.list_(pa.string())) for side in sides]
    made, plain = [], similarity._Coded

    def counted(*args):
        made.append(1)
        return plain(*args)

    monkeypatch.setattr(similarity, "_Coded", counted)
    want = [brute.greedy(p, g) for p, g in zip(*sides, strict=True)]
    assert similarity._greedy(*columns, similarity.ITEM_THRESHOLD).to_pylist() == want
    assert len(made) == 1
    monkeypatch.setattr(similarity, "_MASK_CELLS", 64)
    assert similarity._greedy(*columns, similarity.ITEM_THRESHOLD).to_pylist() == want
    assert len(made) > 2


def test_lcs_around_word_borders():
    """Names of 63 to 130 letters, whose masks take one to three words."""
    draw = random.Random(5)
    keys = list(dict.fromkeys("".join(draw.choice("abcé") for _ in range(n)) for n in (1, 63, 64, 65, 127, 128, 129, 130)))
    ia, ib = (np.array(side) for side in zip(*[(i, j) for i in range(len(keys)) for j in range(len(keys))], strict=True))
    assert similarity.lcs_lengths(keys, ia, ib).tolist() == [brute.lcs(keys[i], keys[j]) for i, j in zip(ia, ib, strict=True)]


def test_ratio(spark):
    rows = [("a b", "b a"), (None, ""), ("Abc", "abd"), ("é", "e"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(token_sort_ratio("a", "b")).collect()]
    assert got == pytest.approx([brute.ratio(a, b) for a, b in rows]) and got[1] == 100


def test_models(spark):
    assert C.requested_models([" a", "b"], ["a", "b", "k"], "k", True) == ["a", "b", "k"]
    with pytest.raises(ValueError, match="unknown"):
        C.requested_models(["z"], ["a"])

    def broken():
        raise RuntimeError("boom")

    ready, skipped = C.load_runners(["a", "b"], {"a": object, "b": broken})
    assert list(ready) == ["a"] and skipped == {"b": "load error: boom"}
    full = json.dumps({"total": 1})
    scored = S.score_receipts(
        spark.createDataFrame([(m, full) for m in "ac"], "model_id string, j string").select(
            "model_id", S.scorable_json(F.col("j")).alias("pred"), S.scorable_json(F.col("j")).alias("gt")
        ),
        ("model_id",),
    )
    errors = spark.createDataFrame([("c", "oom")], "model_id string, error string")
    table = C.compare(scored, C.model_table(spark, ["c", "b", "a"], skipped), errors).collect()
    assert [r.model_id for r in table] == ["c", "b", "a"]
    assert [r.reason for r in table] == ["runtime error: oom", "load error: boom", None]
    assert table[0].total_f1 is None and table[2].total_f1 == 1.0


def test_collect_and_restore(spark):
    tasks = spark.createDataFrame([(i,) for i in range(4)], "task_id int")
    results = spark.createDataFrame([(0, "SUCCESS"), (1, "FAILURE"), (2, "RETRY")], "task_id int, state string")
    assert {r.status: r.n for r in J.tally(J.collect(tasks, results)).collect()} == {"ok": 1, "failed": 1, "pending": 2}
    df = spark.createDataFrame([('{"total":{"f1":0.5,"n_gt":2}}',), ("{}",)], "s string")
    got = df.select(J.restore_scores(F.col("s")).alias("r")).collect()
    assert got[0].r.total.f1 == 0.5 and got[0].r.total.precision == 0 and got[1].r.item_qty.n_gt == 0


def test_latest_prediction_and_pairs(spark):
    pred = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new"), (2, "a", 1, "x")], "receipt_id int, model_id string, attempt int, pred string")
    last = S.latest_prediction(pred, ["receipt_id", "model_id"], "attempt").drop("attempt")
    gt = spark.createDataFrame([(1,), (2,), (3,)], "receipt_id int")
    got = {(r.receipt_id, r.model_id): r.pred for r in S.pair_models(gt, last, ["a", "b"]).collect()}
    assert got == {(1, "a"): "new", (1, "b"): None, (2, "a"): "x", (2, "b"): None, (3, "a"): None, (3, "b"): None}


def test_published_overall(spark):
    """The published field F1s of one model average to its published overall F1."""
    f1 = {"store_name": 0.0, "total": 1.0, "item_name": 0.975, "item_total": 0.925, "item_qty": 0.9}
    mean = spark.range(1).select(S.overall_f1(lambda f: F.lit(f1[f]))).first()[0]
    assert mean == pytest.approx(0.76)


def test_json_is_parsed_and_its_leaves_read_once(spark):
    """Lambdas share nothing, so whatever an expression names twice is worked out twice."""
    answer = F.col("answer")
    plan = lambda c: spark.createDataFrame([("{}",)], "answer string").select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    parsed = plan(responses.parse_response(answer))
    assert parsed.count("parse_json") + parsed.count("parseJson") == 1 and "json_array_length" not in parsed.lower()
    assert plan(S.scorable_json(answer)).count("variant_get") < 60


def test_answers_that_are_one_object(spark):
    cases = {
        '{"a":1}': ("ok", '{"a":1}'), "  {}\n": ("ok", "{}"), '```json\n \t{"a":1}\n```': ("ok", ' \t{"a":1}'), '```\n{"a":1}': ("ok", '{"a":1}'),
        "[1]": ("not_object", "{}"), '"{"': ("not_object", "{}"), " 7 ": ("not_object", "{}"), "null": ("invalid", "{}"), "": ("invalid", "{}"),
        '{"a":1},': ("invalid", "{}"), '{"a":1} x': ("invalid", "{}"), '{"a":1}{}': ("invalid", "{}"), "{},{}": ("invalid", "{}"),
        '{"a":1,"a":2}': ("invalid", "{}"), '{"a":NaN}': ("invalid", "{}"), "{": ("invalid", "{}"), None: ("invalid", "{}"),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", responses.parse_response(F.col("t")).alias("r")).collect()
    for row in rows:
        status, payload = cases[row.t]
        assert row.r.status == status and row.r.payload == payload, row
