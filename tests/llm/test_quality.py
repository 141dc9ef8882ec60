import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.llm import quality

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ensemble(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(quality.training_sample(docs, labels))


def test_held_out_accuracy(spark, ensemble):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, ensemble).join(labels, "doc_id").filter(quality.fold("doc_id", 3) == 1).collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_columns_equal_rules_by_hand(spark, ensemble):
    """The compiled columns give what the rules and weights say."""
    texts = ["Some plain words, and more of them.", "AAA!! BBB!! AAA!!", "x x x x x x", "a | b | c |", "é ß ñ", "1 2 3\n1 2 3\n1 2 3"]
    got = quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ensemble).collect()
    assert 0 < len(ensemble.rules) <= 280 and len(ensemble.weights) == len(ensemble.rules) and 0 not in ensemble.weights
    for r in got:
        s = dict(zip(quality.STATISTICS, quality.statistics_of(texts[r.doc_id].encode())))
        z = ensemble.intercept + sum(w for rule, w in zip(ensemble.rules, ensemble.weights) if all(lo < s[n] <= hi for n, lo, hi in rule.bounds))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_edge_rows(spark, ensemble):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "word"), (5, "w" * 300_000), (6, "same"), (6, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"upper": F.lit("clash"), "score": F.lit(3), "row": F.lit(1)})
    got = quality.score_quality(docs, ensemble).collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows] and got[0].score == got[1].score and got[5] == got[6]
    assert quality.score_quality(docs.limit(0), ensemble).collect() == []


def test_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0), (3, None)], "doc_id long, quality int")
    used = quality.training_sample(docs, labels)
    assert used.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    alone = quality.fit(used)
    assert alone.rules == [] and quality.score_quality(docs, alone).first().score > 0.99
    nothing = quality.fit(used.limit(0))
    assert quality.score_quality(docs, nothing).first().score == pytest.approx(0.5, abs=0.01)


def test_paths():
    text = ("  Tree 0 (weight 1.0):\n    If (feature 6 <= 0.5)\n     If (feature 6 <= 0.25)\n      Predict: 1.0\n     Else (feature 6 > 0.25)\n"
            "      Predict: 0.0\n    Else (feature 6 > 0.5)\n     Predict: 0.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n")
    inf = np.inf
    assert [r.bounds for r in quality.path_rules(text)] == [(("upper", -inf, 0.5),), (("upper", -inf, 0.25),), (("upper", 0.25, 0.5),), (("upper", 0.5, inf),)]
