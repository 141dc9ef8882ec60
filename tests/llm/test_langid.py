import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.llm import langid

SMALL = "/root/testdata/sf0.001"


def slow_viterbi(scores, penalty):
    """Best labelling by trying every sequence."""
    from itertools import product

    def value(labels):
        return sum(s[k] for s, k in zip(scores, labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))
    return max(map(value, product(range(scores.shape[1]), repeat=len(scores)))), value


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 5, 1, 7, 0, 3])
    scores = rng.normal(0, 2, (sizes.sum(), 3)).astype(np.float32)
    labels, at = langid.viterbi(scores, sizes, 1.5), 0
    for n in sizes:
        if n:
            best, value = slow_viterbi(scores[at : at + n], 1.5)
            assert value(labels[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    greek = spark.createDataFrame([("λόγος και μύθος " * 5, "el")] * 3, "text string, lang string")
    return langid.train(langid.training_rows(docs).union(greek))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.label_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.fold("doc_id", 5) == 0).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_mixed_text_has_spans(spark, model):
    texts = {r.lang: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("n_chars between 800 and 3000").orderBy("doc_id").collect()}
    part = {k: " ".join(v.split()[:60]) for k, v in texts.items()}
    mixed = part["de"] + " " + part["es"] + " λόγος και μύθος λόγος και μύθος"
    r = langid.label_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    langs = [s.lang for s in r.spans]
    assert langs[0] == "de" and "es" in langs and langs[-1] == "el" and len(langs) <= 6
    assert sum(s.words for s in r.spans) == len(langid.words_of(mixed)) and r.spans[0].first == 0
    es = max((s for s in r.spans if s.lang == "es"), key=lambda s: s.words)
    assert abs(es.first - len(langid.words_of(part["de"]))) <= 4


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 -- 34!"), (None, "the and of that"), (5, "the and " * 30_000), (6, "汉字"), (6, "汉字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(9), "spans": F.lit("clash"), "lang_pred": F.lit("zz")})
    got = langid.label_languages(docs, model).collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [(r.lang_pred, r.score, r.spans) for r in got[:3]] == [("und", 0.0, [])] * 3
    assert got[4].lang_pred == "en" and got[4].score > 0.99 and got[5].lang_pred in model.languages and got[5] == got[6]
    kept = langid.keep_known(docs, model, 0.9)
    want = [r for r, g in zip(docs.collect(), got) if g.lang_pred != "und" and g.score >= 0.9]
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, want)) and want
    assert langid.keep_known(docs.limit(0), model, 0.9).collect() == []
    assert langid.label_languages(docs.limit(0), model).collect() == []
    assert langid.keep_known(docs, langid.Model([], model.cells[:, :0], model.scripts[:, :0]), 0).collect() == []
    none = langid.train(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    assert {r.lang_pred for r in langid.label_languages(docs, none).collect()} == {"und"}


def test_training_uses_no_held_out_row(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    import zlib
    used = {r.text for r in langid.training_rows(docs).collect()}
    assert used == {f"t{i}" for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert 20 < langid.training_rows(docs, most_rows=100).count() < 160


def test_letters_and_marks(spark, model):
    assert langid.words_of("हिन्दी है, café cafe\u0301") == ["हिन्दी", "है", "café", "cafe\u0301"]
    assert langid.words_of("½ ② Ⅷ ² \u0301 \u0301\u0302 1a_b") == ["a", "b"]
    docs = spark.createDataFrame([(1, "½ ② Ⅷ"), (2, "\u0301 12")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.label_languages(docs, model).collect()} == {("und", 0.0)}


def test_slices_change_nothing(model, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(4)
    texts = pa.array([" ".join(rnd.choice(["the", "and", "der", "und", "λόγος", "el", "que"]) for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, ""])
    whole = [own.tolist() for run in langid._Labeller(model, 2.0)(texts) for own in run]
    monkeypatch.setattr(langid, "_CELLS", 25 * len(model.languages))
    monkeypatch.setattr(langid, "_KEPT", 3)
    sliced = list(langid._Labeller(model, 2.0)(texts))
    assert len(sliced) > 20 and [own.tolist() for run in sliced for own in run] == whole
