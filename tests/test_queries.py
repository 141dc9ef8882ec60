"""Every registered query against its SQL, and a skewed copy of the tables."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tallyroll.operators import scoring
from tallyroll.operators.ordinals import dense_ordinal
from tallyroll.plans import catalog
from tallyroll.plans import fixtures as fx
from tallyroll.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def database(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def compare(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = check._rows(df.columns, [tuple(r) for r in df.collect()])
    result = database(sf_dir).execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == check._rows(columns, result.fetchall())
    return got


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) and set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, name, SMALL)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """One line in twelve belongs to one order, a tenth of those are copies of one line."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    for t in check.TABLES:
        if t != "lineitem":
            shutil.copy(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    duckdb.sql(
        f"""COPY (
          WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_shipdate) AS rn
                     FROM '{SMALL}/lineitem.parquet')
          SELECT CASE WHEN rn % 12 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
            CASE WHEN rn % 120 = 0 THEN 5 ELSE l_partkey END AS l_partkey, l_suppkey,
            CASE WHEN rn % 120 = 0 THEN 1 ELSE l_linenumber END AS l_linenumber,
            CASE WHEN rn % 120 = 0 THEN 3.0 ELSE l_quantity END AS l_quantity,
            CASE WHEN rn % 120 = 0 THEN 9.5 ELSE l_extendedprice END AS l_extendedprice,
            l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM n
        ) TO '{folder}/lineitem.parquet'"""
    )
    return folder


@pytest.mark.parametrize(
    "name", ["score_receipts", "greedy_item_pairs", "split_train_val", "assign_shards", "normalize_cord", "shard_roundtrip"]
)
def test_large_order(spark, skewed, name):
    assert compare(spark, name, skewed)


def test_large_order_is_one_receipt(spark, skewed):
    gt = fx.receipts_gt(spark, skewed)
    own = gt.filter("order_key = 7").selectExpr("receipt_id", "size(items) n").collect()
    assert [r.receipt_id for r in own] == [7] and own[0].n >= 500
    rest = lambda folder: {tuple(r) for r in fx.receipts_gt(spark, folder).filter("order_key <> 7").selectExpr("receipt_id", "total").collect()}
    assert rest(skewed) == rest(SMALL)  # ids and totals do not depend on other orders


@pytest.mark.parametrize("name", ["best_candidates", "greedy_item_pairs"])
def test_matching_runs_once(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["compare_models", "numeric_match", "score_total"])
def test_no_sorted_aggregate(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert name == "compare_models" or "l_orderkey" not in plan


def test_ordinal_computes_its_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(seen, "id long")
    numbered = dense_ordinal(rows, "id", unique=True)
    assert [tuple(r) for r in numbered.orderBy("id").collect()] == [(i, i) for i in range(1000)]
    assert calls.value <= 2000  # once to sample the range, once to write


def test_gathered_lines_are_shared(spark):
    """Truth and predictions share the gathered lists, and what is dealt by the order is dealt by the receipt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        gt = fx.receipts_gt(spark, SMALL)
        pred = fx.predictions(fx.receipts_pred(gt, fx.MODELS[:1]))
        pairs = scoring.pair_models(fx.truth(gt), pred, list(fx.MODELS[:1]))
        pairs.write.format("noop").mode("overwrite").save()
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan[: plan.index("== Initial Plan ==")]
    assert "hashpartitioning(receipt_id" not in final
    assert final.count("hashpartitioning(l_partkey") == 2 and "ReusedExchange" in final  # lines and parts, once each


def test_shards_move_texts_once(spark, tmp_path, monkeypatch):
    """Only narrow rows are numbered; the JSON texts go to their shards in one shuffle."""
    wide = []

    def ordinal(df, *order, **options):
        wide.append(df.columns)
        return dense_ordinal(df, *order, **options)

    monkeypatch.setattr("tallyroll.operators.corpus.dense_ordinal", ordinal)
    catalog._packed(spark, SMALL, str(tmp_path / "s"))
    assert len(wide) == 1 and not {"json", "items"} & set(wide[0])
