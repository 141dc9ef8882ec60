import random
from hashlib import sha256

import pytest

from tallyroll.llm import fim


def slow(doc_id, text, seed, plain, spm, unit, marks):
    text = text or ""
    units = list(text) if unit == "char" else text.splitlines(keepends=True)
    if unit == "line":
        units = [u + "\n" for u in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text and not text.endswith("\n") else [])
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    a, b, c = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return doc_id, n, "spm", lo, hi - lo, s + c + p + a + m + b
    return doc_id, n, "psm", lo, hi - lo, p + a + s + c + m + b


def corpus():
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("aé世🎉 \n<P>") for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "null id"), (None, None), (902, "has <P> inside"), (903, "<M>"), (904, "<"), (904, "<"), (904, "P>")]
    rows += [(910 + i, "🎉é\n" * 30_000 + "x" * i) for i in range(4)] + [(930 + i, "<" * i) for i in range(6)]
    return rows


@pytest.mark.parametrize("slices", [(1 << 22, 1 << 20, 1 << 12), (64, 16, 8)])
@pytest.mark.parametrize("unit, marks", [("char", fim.SENTINELS), ("line", ("<pre>", "[suf]", "|"))])
def test_against_plain_strings(spark, monkeypatch, slices, unit, marks):
    for name, value in zip(("_SLICE", "_BLOCK", "_GRID"), slices):
        monkeypatch.setattr(fim, name, value)
    rows = corpus() if slices[0] > 64 else [r for r in corpus() if len(r[1] or "") < 1000]
    batch = fim.pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], **{
        f"h{i}": [int(sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for d, _ in rows] for i in range(4)}})
    out = list(fim._transformed(fim._marks(marks), 25, 40, unit)(iter([batch, batch.slice(3, 50), batch.slice(0, 0)])))
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [slow(*r, "7", 25, 40, unit, marks) for r in rows + rows[3:53]]
    assert got == want
    names = out[0].schema.names
    back = [r["restored"] for b in fim._restored(fim._marks(marks), names.index("output"), names.index("form"))(iter(out)) for r in b.to_pylist()]
    assert back == [t or "" for _, t in rows + rows[3:53]]


def test_on_spark(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, output string, n int").repartition(3)
    done = fim.transform(docs)
    assert done.columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    want = sorted(repr(slow(*r, "1", 10, 20, "char", fim.SENTINELS)) for r in rows)
    assert sorted(repr(tuple(r)) for r in done.collect()) == want
    assert {"plain", "psm", "spm"} == {r.form for r in done.select("form").collect()}
    back = fim.restore(done)
    assert sorted(repr((r.doc_id, r.restored)) for r in back.collect()) == sorted(repr((d, t or "")) for d, t in rows)
    assert fim.restore(fim.transform(docs.limit(0))).collect() == []


def test_wrong_outputs_and_marks(spark):
    odd = spark.createDataFrame([("no marks", "psm")], "output string, form string")
    with pytest.raises(Exception, match="exactly one mark"):
        fim.restore(odd).collect()
    nulls = spark.createDataFrame([(None, None, 1), ("<P> plain", None, 2), ("t", "plain", 3)], "output string, form string, restored int")
    assert sorted(r.restored for r in fim.restore(nulls).collect()) == ["", "<P> plain", "t"]
    for marks in (("", "b", "c"), ("a", "a", "b"), ("ab", "bc", "x"), ("aXa", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(odd, sentinels=marks, id_col="form", text_col="output")
    with pytest.raises(ValueError, match="unit"):
        fim.transform(odd, unit="word", id_col="form", text_col="output")
