import pytest
from pyspark.sql import functions as F

from tallyroll.functions import amounts as A

CASES = [
    # text, metric, locale, cord, serving
    ("1,234.50", 1234.5, 1234.5, 1234.5, 1234.5),
    ("£5", 5.0, 0.0, 5.0, 5.0),
    ("abc", None, 0.0, None, 0.0),
    (None, None, 0.0, None, 0.0),
    ("1,346,000", 1346000.0, 1346000.0, 1346000.0, 0.0),
    ("35.000,00", 35.0, 35000.0, 35.0, 35000.0),
    ("Rp 35.000", None, 35.0, 35.0, 35.0),
    ("Rp. 45,000", None, 45.0, 45000.0, 45.0),
    ("12,000원", None, 0.0, 12000.0, 12.0),
    ("-", None, 0.0, None, 0.0),
    ("-5", -5.0, -5.0, -5.0, 5.0),
    ("1,346", 1346.0, 1346.0, 1346.0, 1.346),
    ("1,346.50", 1346.5, 1346.5, 1346.5, 1346.5),
    ("1.346,50", 1.3465, 1346.5, 1.3465, 1346.5),
    ("1.0d", None, 0.0, 1.0, 1.0),
    (" $9.99\n", 9.99, 0.0, 9.99, 9.99),
    ("1_000", 1000.0, 1000.0, 1000.0, 1000.0),
    ("", None, 0.0, None, 0.0),
]


def test_dialects(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    s = F.col("s")
    got = {
        r.i: tuple(r)[1:]
        for r in df.select(
            "i", A.metric_number(s), A.locale_number(s), A.cord_number(s), A.serving_number(s)
        ).collect()
    }
    for i, (text, *want) in enumerate(CASES):
        assert list(got[i]) == pytest.approx(want), text


def test_quantities_and_match(spark):
    rows = [(0, None), (1, ""), (2, "x"), (3, "0"), (4, "2")]
    q = F.col("q")
    df = spark.createDataFrame(rows, "i int, q string").orderBy("i")
    got = df.select(A.corpus_quantity(q), A.eval_quantity(q), A.serving_quantity(q)).collect()
    assert [tuple(r) for r in got] == [
        (1.0, 1.0, 1.0), (1.0, 1.0, 1.0), (0.0, 1.0, 1.0), (0.0, 0.0, 1.0), (2.0, 2.0, 2.0),
    ]
    pairs = [(10.1, 10.0), (10.5, 10.0), (0.0, 0.0), (1.0, 0.0), (None, 1.0), (-10.1, -10.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p double, g double")
    got = df.orderBy("i").select(A.numeric_match(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, True]
