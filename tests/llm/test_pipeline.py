import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from tallyroll.llm import queries
from test_contamination import slow as slow_hits
from test_jaccard import slow as slow_groups

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5": "page_id host path rule verdict", "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8": "doc_id n_shingles component_id",
    "op10": "doc_id held_out score predicted", "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = COLUMNS.get(name.split("_")[0], "").split()
    assert df.columns[: len(want)] == want
    rows = df.collect()
    if name.split("_")[0] not in ("op1", "op4"):
        table = "pages" if name.startswith("op5") else "documents"
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if name in queries.SQL:
        import duckdb

        db = duckdb.connect()
        for t in check.TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        result = db.execute(queries.SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert check._rows(df.columns, [tuple(r) for r in rows]) == check._rows(columns, result.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "123 !!", None, None, 6), (None, "the and of " * 9, "en", "s", 99)], docs.schema)
    docs = docs.union(odd).union(docs.filter("doc_id = 0"))
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SMALL)
    assert known.columns == docs.columns
    assert known.count() == docs.count() - 3 and known.filter("doc_id > 9000").count() == 0
    rows = [(r.doc_id, r.text) for r in known.collect()]
    one = stages["near copies"](spark, known, SMALL)
    groups = {c for d, n, c in slow_groups(rows, 5, 80)}
    assert one.columns == docs.columns and one.count() == len(groups) and {r.doc_id for r in one.collect()} == groups
    clean = stages["test passages"](spark, one, SMALL)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {r.doc_id for r in one.collect() if not slow_hits(r.text, items)[1]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want and clean.count() == len(want)
    private = stages["personal data"](spark, clean, SMALL)
    assert private.schema == docs.schema and private.count() == clean.count()
    assert private.filter("n_chars <> length(text)").count() == 0
    assert private.join(clean.withColumnRenamed("text", "old"), "doc_id").filter("text <> old").count() > 0
    packed = stages["packing"](spark, private, SMALL)
    assert packed.agg(F.sum("n_words")).first()[0] == private.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
