"""Queries that write one of the library's formats and read it back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import jobs as J
from ..operators import scoring as S
from ..operators.ordinals import dense_ordinal, seeded_hash
from ..schema import FIELDS
from ..session import fresh_dir
from ..sources import annotations, images, reports
from ..streaming import jobs as stream
from . import fixtures as fx
from . import raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _r(column: str | Column) -> Column:
    return F.round(column, 6)


def _order_key(json: str, path: str) -> Column:
    return F.get_json_object(json, path).cast("bigint")


@query
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines, read back in file order."""
    path = fresh_dir(spark, "json-lines")
    image = F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    lines = fx.table(spark, sf_dir, "orders").orderBy("o_orderkey").select(
        F.col("o_orderkey").alias("receipt_number"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("total"),
        F.struct(image.alias("image_path"), F.lit("a\r\nb").alias("notes")).alias("metadata"),
    )
    annotations.write_json_lines(lines, path)
    return annotations.read_annotations(spark, path).select(
        "ordinal",
        _order_key("json", "$.receipt_number").alias("receipt_id"),
        F.get_json_object("json", "$.total").cast("double").alias("total"),
        "image_path",
    )


@query
def eval_jobs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job lines with an image path and an annotation."""
    path = fresh_dir(spark, "eval-jobs")
    jobs = fx.table(spark, sf_dir, "orders").orderBy("o_orderkey").select(
        F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("image_path"),
        F.struct(F.col("o_totalprice").alias("total"), F.lit("USD").alias("currency")).alias("annotation"),
    )
    annotations.write_json_lines(jobs, path)
    return annotations.read_eval_jobs(spark, path).select(
        "ordinal", "image_path", F.get_json_object("annotation", "$.total").cast("double").alias("total")
    )


def _scored(spark: SparkSession, sf_dir: str, models: tuple[str, ...]) -> DataFrame:
    gt = fx.receipts_gt(spark, sf_dir)
    pred = fx.predictions(fx.receipts_pred(gt, models))
    return S.score_receipts(S.pair_models(fx.truth(gt), pred, list(models)), ("receipt_id", "model_id"))


@query
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with summary and samples; the means follow from the samples read back."""
    path = fresh_dir(spark, "report")
    scored = _scored(spark, sf_dir, fx.MODELS[:1])
    reports.write_report(scored, ["receipt_id", F.struct(*FIELDS).alias("scores")], path)
    samples = spark.read.text(f"{path}/samples").select(
        J.restore_scores(F.get_json_object("value", "$.scores")).alias("r"))
    again = S.summary_rows(S.mean_scores(samples.select("r.*")))
    summary = S.summary_rows(spark.read.text(f"{path}/summary").select(
        J.restore_scores(F.col("value")).alias("r")).select("r.*"))
    both = again.join(summary.select("field", F.col("f1").alias("said")), "field")
    return both.filter(F.abs(F.col("f1") - F.col("said")) < 1e-9).select(
        "field", *[_r(p).alias(p) for p in S.PARTS[:3]], "n_pred", "n_gt")


@query
def comparison_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison with one skipped model, one JSON line a model."""
    path = fresh_dir(spark, "comparison")
    models = [*fx.MODELS, "model-d"]
    table = C.compare(_scored(spark, sf_dir, fx.MODELS), C.model_table(spark, models, {"model-d": "credential is not set"}))
    reports.write_comparison(table, path)
    one = F.explode(F.from_json("value", "map<string,string>")).alias("model_id", "json")
    read = spark.read.text(path).select(one)
    return read.select(
        "model_id",
        *[_r(F.get_json_object("json", f"$.{c}").cast("double")).alias(c) for c in C.F1_COLUMNS],
        F.coalesce(F.get_json_object("json", "$.skipped").cast("boolean"), F.lit(False)).alias("skipped"),
        F.get_json_object("json", "$.reason").alias("reason"),
    )


@query
def score_json_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as JSON text, with aliases and mixed number forms, scored like the typed receipts."""
    gt = fx.receipts_gt(spark, sf_dir)
    truth = raw.receipt_json(gt, defects=False).select("receipt_id", S.scorable_json(F.col("json")).alias("gt"))
    items = F.transform("items", lambda i: i.dropFields("source_line"))
    body = F.when(
        F.col("receipt_id") % 2 == 0, F.to_json(F.struct("store_name", "total", items.alias("line_items")))
    ).otherwise(F.to_json(F.struct(F.struct(F.col("store_name").alias("name")).alias("store"), "total", items.alias("items"))))
    pred = fx.receipts_pred(gt, fx.MODELS[:1]).select("receipt_id", S.scorable_json(body).alias("pred"))
    scored = S.score_receipts(S.join_predictions(truth, pred))
    return scored.select("receipt_id", *[_r(f"{f}.f1").alias(f"{f}_f1") for f in FIELDS], _r("overall_f1").alias("overall_f1"))


@query
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the place of every receipt in a full shuffle of one epoch."""
    keys = raw.receipt_keys(spark, sf_dir)
    numbered = dense_ordinal(keys, seeded_hash("receipt_id", 7, 1), "receipt_id", name="position", unique=True)
    return numbered.select("receipt_id", "position")


@query
def image_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per supplier, read as images and as a stream of submissions."""
    work = fresh_dir(spark, "submitted")
    name = F.concat(F.lit("s_suppkey="), F.coalesce(F.col("s_suppkey").cast("string"), F.lit("null")), F.lit(".txt"))
    suppliers = fx.table(spark, sf_dir, "supplier").select(name.alias("name"), F.coalesce("s_name", F.lit("")).alias("value"))
    images.write_texts(suppliers, f"{work}/in")
    with stream.few_listing_tasks(spark):
        stream.start_append(
            stream.submissions(spark, f"{work}/in"), f"{work}/out", f"{work}/ckpt").awaitTermination()
    submitted = spark.read.parquet(f"{work}/out")
    files = images.read_images(spark, f"{work}/in").select("path", "length")
    return submitted.join(files, "path").select(
        F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("bigint").alias("s_suppkey"),
        "content_type",
        F.trim(F.decode("content", "UTF-8"), F.lit("\n")).alias("text"),
        "length",
    )


def sql(known: dict[str, str]) -> dict[str, str]:
    """SQL of these queries; ``known`` has that of the queries they repeat by way of files."""
    return {
        "json_lines_roundtrip": """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS receipt_id,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS total, 'img/' || o_orderkey || '.jpg' AS image_path FROM orders""",
        "eval_jobs_roundtrip": """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, 'in/' || o_orderkey || '.png' AS image_path,
  o_totalprice AS total FROM orders""",
        "report_roundtrip": known["aggregate_scores"],
        "comparison_roundtrip": known["compare_models"],
        "score_json_receipts": known["score_receipts"],
        "shuffled_order": """
SELECT o_orderkey AS receipt_id, row_number() OVER (ORDER BY md5('7:1:' || o_orderkey), o_orderkey) - 1 AS position FROM orders""",
        "image_submissions": """
SELECT s_suppkey, 'application/octet-stream' AS content_type, s_name AS text, CAST(length(s_name) + 1 AS BIGINT) AS length FROM supplier""",
    }
