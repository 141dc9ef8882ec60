import json

from pyspark.sql import functions as F

from tallyroll.operators import normalize as N
from tallyroll.operators import validate as V


def rows(spark, texts, column):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"ordinal int, {column} string")


def test_cord(spark):
    line = {"nm": "Tea", "cnt": "2", "unitprice": "1,000", "price": "2,000"}
    docs = [
        {"gt_parse": {"menu": line, "sub_total": {"storenm": "S"}, "total": {"total_price": "2,000"}}},
        {"menu": [line, "note", {"nm": None, "price": "x"}], "total": None},
        {"menu": [], "sub_total": {"subtotal_price": "0"}},
        {"menu": [{"cnt": ""}], "sub_total": None},
        {"gt_parse": {"menu": ["only text"]}},
    ]
    texts = [json.dumps(d) for d in docs] + ["{broken"]
    got = N.normalize_cord(rows(spark, texts, "ground_truth")).orderBy("ordinal").collect()
    one, gap, empty, null_sub, text, broken = got
    assert one.receipt.store.name == "S" and one.receipt.total == 2000 and len(one.receipt["items"]) == 1
    assert one.receipt["items"][0].unit_price == 1000 and one.receipt.metadata.image_path == "images/cord_00000.jpg"
    assert [i.line_number for i in gap.receipt["items"]] == [1, 3]
    assert gap.receipt["items"][1].name == "None" and gap.receipt["items"][1].total == 0 and gap.receipt.total == 0
    assert gap.receipt.store.name == "UNKNOWN"
    assert empty.receipt["items"][0].name == "UNKNOWN" and empty.receipt.subtotal is None
    assert null_sub.receipt is None and null_sub.error == "sub_total is null"
    assert text.receipt["items"][0].name == "UNKNOWN"
    assert broken.receipt is None and broken.error == "not JSON"


def test_sroie(spark):
    texts = [
        '{"company":" ACME ","date":"2020-01-02T10","total":"9.50"}',
        '{"company":null,"total":"x"}',
        '{"company":null,"date":null}',
        None,
        "{bad",
    ]
    got = N.normalize_sroie(rows(spark, texts, "parsed_data")).orderBy("ordinal").collect()
    assert (got[0].receipt.store.name, got[0].receipt.date, got[0].receipt.total) == ("ACME", "2020-01-02", 9.5)
    assert got[1].error == "total is not a number"
    assert (got[2].receipt.store.name, got[2].receipt.date, got[2].receipt.total) == ("None", "None", 0.0)
    assert (got[3].receipt.store.name, got[3].receipt.date) == ("UNKNOWN", "1970-01-01")
    assert got[4].error == "not a JSON object"


def test_remaps_differ(spark):
    body = {
        "menu": {"cnt": "x", "unitprice": "1,346", "price": "-5"},
        "sub_total": {"storenm": ""},
        "total": {"total_price": "abc"},
    }
    df = rows(spark, [json.dumps({"cord-v2": body}), "{}"], "payload")
    ev = N.remap_eval(df).orderBy("ordinal").collect()
    sv = N.remap_serving(df).orderBy("ordinal").collect()
    e, s = ev[0].receipt["items"][0], sv[0].receipt["items"][0]
    assert (e.name, e.quantity, e.unit_price, e.total) == ("", 1.0, 1346.0, -5.0)
    assert (s.name, s.quantity, s.unit_price, s.total) == ("UNKNOWN", 1.0, 1.346, 5.0)
    assert ev[0].receipt.total is None and sv[0].receipt.total == 0.0
    assert ev[1].receipt["items"] == [] and sv[1].receipt["items"][0].name == "UNKNOWN"
    assert (ev[0].receipt.store.name, sv[0].receipt.store.name) == ("", "Unknown")


GOOD = {
    "store": {"name": "A", "branch": None},
    "date": "2024-01-01",
    "items": [{"line_number": 1.0, "name": "x", "total": 1, "quantity": 2, "unit": "kg", "sku": None}],
    "total": 3.5,
    "subtotal": None,
    "currency": "EUR",
    "payment": {"method": "cash", "card_last4": None},
    "taxes": [{"rate": 0.2, "amount": 1}],
    "discounts": [{"description": "d", "amount": 1, "applies_to_line": None}],
    "loyalty": None,
    "metadata": {"source": "cord", "notes": None},
    "extra": [1],
}


def test_validation(spark):
    item = GOOD["items"][0]
    bad = [
        ({"store": None}, "store must be an object"),
        ({"store": {"name": 3}}, "store.name must be text"),
        ({"store": {"name": "A", "phone": 3}}, "store fields must be text or null"),
        ({"time": 5}, "header fields must be text or null"),
        ({"items": ["x"]}, "items must hold objects"),
        ({"items": [{"name": "x"}]}, "item needs line_number, name and total"),
        ({"items": [{**item, "line_number": 1.5}]}, "line_number must be an integer from 1"),
        ({"items": [{**item, "line_number": True}]}, "line_number must be an integer from 1"),
        ({"items": [{**item, "sku": 5}]}, "item text fields must be text"),
        ({"items": [{**item, "quantity": None}]}, "quantity must be a number"),
        ({"items": [{**item, "unit": None}]}, "unit is not known"),
        ({"items": [{**item, "total": True}]}, "item amounts must be numbers"),
        ({"discounts": [{"amount": 1}]}, "discounts are malformed"),
        ({"discounts": [{"description": "d", "amount": 1, "applies_to_line": 1.5}]}, "discounts are malformed"),
        ({"taxes": {}}, "taxes are malformed"),
        ({"taxes": [{"rate": "x", "amount": 1}]}, "taxes are malformed"),
        ({"subtotal": "1"}, "subtotal must be a number or null"),
        ({"currency": "EURO"}, "currency must be three capitals"),
        ({"payment": []}, "payment must be an object"),
        ({"payment": {"card_last4": "12345"}}, "payment.card_last4 must be four digits or null"),
        ({"payment": {"change_given": "1"}}, "payment amounts must be numbers or null"),
        ({"loyalty": {"program": 1}}, "loyalty is malformed"),
        ({"metadata": {"source": None}}, "metadata is malformed"),
    ]
    texts = [json.dumps(GOOD)] + [json.dumps({**GOOD, **change}) for change, _ in bad] + ["[1]", None]
    got = V.validate(rows(spark, texts, "json")).orderBy("ordinal").collect()
    assert got[0].valid and got[0].violations == []
    for r, (change, message) in zip(got[1:], bad):
        assert message in r.violations, (change, r.violations)
    assert got[-1].violations == got[-2].violations == ["not a JSON object"]


def test_outcome_and_completeness(spark):
    df = spark.createDataFrame(
        [(1, "text/plain", True, None, []), (2, "image/png", False, None, []), (3, "image/png", True, "e", []),
         (4, "image/png", True, None, ["v"]), (5, "image/png", True, None, []), (6, None, True, None, [])],
        "i int, kind string, ready boolean, error string, problems array<string>",
    ).orderBy("i")
    codes = [r[0] for r in df.select(V.outcome(F.col("kind"), F.col("ready"), F.col("error"), F.col("problems"))).collect()]
    assert codes == [415, 503, 500, 422, 200, 415]
    texts = [json.dumps(GOOD), '{"store":{},"items":[],"total":null}', '{"store":{"name":""},"total":0}']
    got = {r.field: (r.n_present, r.n_total) for r in V.completeness(rows(spark, texts, "json")).collect()}
    assert got == {"store.name": (2, 3), "total": (2, 3), "items": (1, 3)}


def test_whole_receipts(spark):
    """Fields that no source tells are there as nulls or empty lists; a null document is an error row."""
    rows = [(0, '{"gt_parse":{"menu":{"nm":"tea","price":"3.00"}}}'), (1, '{"gt_parse":null}'), (2, '{"menu":[]}')]
    got = {r.ordinal: r for r in N.normalize_cord(spark.createDataFrame(rows, "ordinal int, ground_truth string")).collect()}
    assert got[1].receipt is None and got[1].error
    for i in (0, 2):
        assert got[i].error is None and got[i].receipt.discounts == [] and got[i].receipt.taxes == []
        item = got[i].receipt["items"][0]
        assert [item[n] for n in ("normalized_name", "sku", "category", "tax_code", "discount_applied")] == [None] * 5
    plain = N.normalize_sroie(spark.createDataFrame([(0, "{}")], "ordinal int, parsed_data string")).first().receipt
    assert plain.discounts == [] and plain.taxes == []


def test_objects_are_read_once(spark):
    """Lists and objects of a receipt are not built anew for every rule."""
    checked = V.validate(spark.createDataFrame([("{}",)], "json string"))
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.store") <= 3 and plan.count("$.payment") <= 3  # the fields, and what else it is
    texts = ['{"items":[null,3,{}],"store":null}', '{"store":[],"items":null,"loyalty":null,"payment":null}', "[]", "{"]
    got = V.validate(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert got[0].violations[:5] == [
        "date is required", "total is required", "store must be an object", "items must hold objects",
        "item needs line_number, name and total"]
    assert got[1].violations == ["date is required", "total is required", "store must be an object",
                                 "items must be a list", "payment must be an object"]
    assert got[2].violations == got[3].violations == ["not a JSON object"]


def test_readable_receipts_are_parsed_once(spark):
    """The rows without an error, repeated ones too; no text is parsed in a filter and again after it."""
    texts = ['{"menu": {"nm": "a", "price": "1"}, "total": {"total_price": "1"}}'] * 2 + ["nope", '{"sub_total": null}', None]
    df = rows(spark, texts, "ground_truth")
    read = N.readable(N.normalize_cord(df))
    assert [r.receipt.total for r in read.collect()] == [1.0, 1.0]
    assert read.collect() == N.normalize_cord(df).filter("error IS NULL").select("receipt").collect()
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "_json" in line]


def test_amounts_take_one_search_each(spark):
    """What an earlier search left in a number's text is not searched again."""
    from tallyroll.functions import amounts as A

    df = spark.createDataFrame([("Rp. 1.000,50",), ("+-5",), ("Rp.x.5",), ("1,2.3,4",), (".",)], "t string")
    read = df.select(A.cord_number(F.col("t")).alias("c"), A.serving_number(F.col("t")).alias("s"))
    assert [tuple(r) for r in read.collect()] == [(1.0005, 1000.5), (None, 5.0), (0.5, 0.0), (12.34, 12.34), (None, 0.0)]
    plan = read._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" not in plan and "RLIKE" not in plan
    plain = [("45,000",), ("45.000,50",), ("1..",), ("1.2.",), ("1.2.3",), ("5,",), (".5",), (",5",), ("٣",)]
    found = spark.createDataFrame(plain, "t string").select(A.locale_number(F.col("t"))).collect()
    assert [r[0] for r in found] == [45000.0, 45000.5, 1.0, 1.2, 0.0, 5.0, 5.0, 5.0, 0.0]
