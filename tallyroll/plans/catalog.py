"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the whole driver tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import amounts as A
from ..functions import responses as R
from ..functions import text as X
from ..functions.similarity import token_sort_ratio
from ..operators import compare as C
from ..operators import corpus as K
from ..operators import jobs as J
from ..operators import normalize as N
from ..operators import predict as P
from ..operators import requests as Q
from ..operators import scoring as S
from ..operators import validate as V
from ..operators.ordinals import dense_ordinal
from ..schema import FIELDS, OVERALL_FIELDS, RECEIPT
from ..session import fresh_dir, written
from ..sources import annotations, images, shards
from ..streaming import jobs as stream
from ..streaming import life
from . import fixtures as fx
from . import raw, roundtrips

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query, name: str | None = None) -> Query:
    QUERIES[name or fn.__name__] = fn
    return fn


def _r(value: Column | str) -> Column:
    return F.round(value, 6)


# --- numbers and text -------------------------------------------------------


@query
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 to N4 on the same printed amounts."""
    orders = fx.table(spark, sf_dir, "orders")
    text = raw.amount_text(F.col("o_totalprice"), F.col("o_orderkey") % 8)
    value = F.col("raw")
    return orders.select(F.col("o_orderkey").alias("receipt_id"), text.alias("raw")).select(
        "receipt_id",
        "raw",
        A.metric_number(value).alias("n_metric"),
        A.locale_number(value).alias("n_locale"),
        A.cord_number(value).alias("n_cord"),
        A.serving_number(value).alias("n_serving"),
    )


@query
def default_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three quantity rules and the zero-as-absent unit price, per line."""
    lines = fx.receipts_gt(spark, sf_dir).select(
        "receipt_id", "order_key", F.posexplode("items").alias("pos", "item")
    )
    line = F.col("pos") + 1
    k = (F.col("order_key") + line) % 6
    text = (
        F.when(k == 0, F.col("item.quantity").cast("string"))
        .when(k == 1, "")
        .when(k == 3, "x")
        .when(k == 4, "0")
        .when(k == 5, "1,5")
    )
    price = F.when(line % 3 == 0, 0.0).otherwise(F.col("item.total"))
    q = F.col("q")
    return lines.select("receipt_id", line.alias("line_number"), text.alias("q"), price.alias("p")).select(
        "receipt_id",
        "line_number",
        A.corpus_quantity(q).alias("qty_gt"),
        A.eval_quantity(q).alias("qty_eval"),
        A.serving_quantity(q).alias("qty_serving"),
        A.zero_as_null(F.col("p")).alias("unit_price"),
    )


def _gt_and_pred(
    spark: SparkSession, sf_dir: str, models=fx.MODELS, with_items: bool = True
) -> tuple[DataFrame, DataFrame]:
    gt = fx.receipts_gt(spark, sf_dir, with_items)
    return gt, fx.receipts_pred(gt, models)


def _pairs(spark: SparkSession, sf_dir: str, with_items: bool = True) -> DataFrame:
    """J1 for one model: every receipt with that model's prediction."""
    gt, pred = _gt_and_pred(spark, sf_dir, fx.MODELS[:1], with_items)
    return S.join_predictions(fx.truth(gt), fx.predictions(pred).drop("model_id"))


def _model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every receipt once per model."""
    gt, pred = _gt_and_pred(spark, sf_dir)
    return S.pair_models(fx.truth(gt), fx.predictions(pred), list(fx.MODELS))


@query
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 on receipt totals of every model; no line is read."""
    gt = fx.receipts_gt(spark, sf_dir, with_items=False)
    pairs = S.pair_models(fx.truth(gt), fx.predictions(fx.receipts_pred(gt)), list(fx.MODELS))
    return pairs.select(
        "receipt_id",
        "model_id",
        F.col("pred.total").alias("pred_total"),
        F.col("gt.total").alias("gt_total"),
        A.numeric_match(F.col("pred.total"), F.col("gt.total")).alias("is_match"),
    )


def _token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on every distinct pair of a true line name and its predicted form."""
    gt, pred = _gt_and_pred(spark, sf_dir)
    edited = pred.select("receipt_id", F.explode("items").alias("i")).select(
        "receipt_id", F.col("i.source_line").alias("line"), F.col("i.name").alias("name_a")
    )
    true = gt.select("receipt_id", F.posexplode("items").alias("pos", "i")).select(
        "receipt_id", (F.col("pos") + 1).alias("line"), F.col("i.name").alias("name_b")
    )
    names = edited.join(true, ["receipt_id", "line"]).select("name_a", "name_b").distinct()
    return names.withColumn("ratio", _r(token_sort_ratio("name_a", "name_b")))


query(_token_sort_ratio, "token_sort_ratio")


# --- matching and scoring ---------------------------------------------------


@query
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar true line of every predicted line, nothing consumed."""
    best = S.best_per_item(_model_pairs(spark, sf_dir))
    # outer: a plain explode would first test the list for emptiness, which computes it twice
    rows = best.select("receipt_id", "model_id", F.posexplode_outer("best").alias("pos", "b"))
    return rows.filter("pos is not null").select(
        "receipt_id",
        "model_id",
        (F.col("pos") + 1).alias("pred_line"),
        (F.col("b.position") + 1).alias("gt_line"),
        _r("b.ratio").alias("ratio"),
    )


@query
def greedy_item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the line pairs the scorer consumes."""
    matched = S.match_items(_model_pairs(spark, sf_dir))
    return (
        matched.select("receipt_id", "model_id", F.posexplode_outer("matched").alias("pos", "j"))
        .filter("j >= 0")
        .select(
            "receipt_id",
            "model_id",
            (F.col("pos") + 1).alias("pred_line"),
            (F.col("j") + 1).alias("gt_line"),
        )
    )


def _parts(score: str) -> list[Column]:
    return [_r(f"{score}.{p}").alias(p) for p in S.PARTS[:3]] + [
        F.col(f"{score}.{n}").alias(n) for n in S.PARTS[3:]
    ]


@query
def score_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, F7."""
    scored = S.with_store_ratio(_pairs(spark, sf_dir)).select(
        "receipt_id", S.store_score(F.col("store_ratio")).alias("s")
    )
    return scored.select("receipt_id", *_parts("s"))


@query
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3; no line is read."""
    scored = _pairs(spark, sf_dir, with_items=False).select("receipt_id", S.total_score().alias("s"))
    return scored.select("receipt_id", *_parts("s"))


@query
def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four item fields per receipt."""
    scored = S.score_receipts(_pairs(spark, sf_dir))
    fields = [f for f in FIELDS if f.startswith("item_")]
    return scored.select(
        "receipt_id",
        *[_r(f"{f}.{p}").alias(f"{f}_{p}") for f in fields for p in S.PARTS[:3]],
        F.col("item_name.n_pred").alias("n_pred"),
        F.col("item_name.n_gt").alias("n_gt"),
    )


def _flat(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.select(
        *keys, *[_r(f"{f}.f1").alias(f"{f}_f1") for f in FIELDS], _r("overall_f1").alias("overall_f1")
    )


@query
def score_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, six F1s and the overall one per receipt."""
    return _flat(S.score_receipts(_pairs(spark, sf_dir)), "receipt_id")


@query
def aggregate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus means per field."""
    rows = S.summary_rows(S.mean_scores(S.score_receipts(_pairs(spark, sf_dir))))
    return rows.select("field", *[_r(p).alias(p) for p in S.PARTS[:3]], "n_pred", "n_gt")


class _NoKey(P.Runner):
    """A hosted model whose credential is not set."""

    model_id = "model-d"

    def __init__(self):
        raise EnvironmentError("credential is not set")

    def extract(self, image: bytes) -> str:
        raise NotImplementedError


class TextRunner(P.Runner):
    """An offline reader: the image bytes are the recognised text."""

    model_id = "text"

    def extract(self, image: bytes) -> str:
        return image.decode("utf-8")


REGISTRY = {**{m: TextRunner for m in fx.MODELS}, "model-d": _NoKey}


@query
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models and one that cannot load."""
    models = C.requested_models(fx.MODELS, REGISTRY, keyed="model-d", has_key=True)
    _, skipped = C.load_runners(models, REGISTRY)
    scored = S.score_receipts(_model_pairs(spark, sf_dir), ("receipt_id", "model_id"))
    table = C.compare(scored, C.model_table(spark, models, skipped))
    return table.select("model_id", *[_r(c).alias(c) for c in C.F1_COLUMNS], "skipped", "reason")


class SheetRunner(P.Runner):
    """Reads a receipt sheet (JSON bytes) with the mistakes of one model: words turned, dropped or unknown, wrong amounts."""

    salt = 0

    def _line(self, key: int, at: int, item: dict) -> dict | None:
        kind = (key * 7 + at + self.salt) % 10
        words, quantity, total = item["name"].split(" "), item["quantity"], item["total"]
        if kind == 0:
            return None
        name = {1: " ".join(reversed(words)), 2: " ".join(words[:-1]), 6: "UNKNOWN"}.get(kind, item["name"])
        line = {"name": name, "quantity": str({5: quantity + 1, 8: int(quantity)}.get(kind, quantity)),
                "total": {3: total * 1.015, 4: total * 1.05, 7: 0.0}.get(kind, total)}
        return line | ({"unit_price": total} if kind == 7 else {})

    def extract(self, image: bytes) -> str:
        return self._read(json.loads(image))

    def _read(self, sheet: dict) -> str:
        key, total, store = sheet["order_key"], sheet["total"], sheet["store_name"]
        if key % 11 == 0:
            return "This receipt cannot be read."
        if (key + self.salt) % 5 == 0:
            store = " ".join(reversed(store.split(" ")))
        elif (key + self.salt) % 5 == 1:
            store = store.split(" ")[0]
        elif (key + self.salt) % 17 == 0:
            store = None
        total = f"${total}" if key % 13 == 0 else str(total * 1.03) if key % 7 == 0 else str(total)
        lines = [self._line(key, at, item) for at, item in enumerate(sheet["items"], 1)]
        return json.dumps({"store_name": store, "total": total, "items": [line for line in lines if line]})


class ChattyRunner(SheetRunner):
    """Talks first about every fourth receipt, and answers in a fence when asked again."""

    salt = 1

    def extract(self, image: bytes) -> str:
        sheet = json.loads(image)
        return "Here is what I see." if sheet["order_key"] % 4 == 0 else self._read(sheet)

    def again(self, image: bytes, answer: str) -> str:
        return f"```json\n{super().extract(image)}\n```"


class ThirdRunner(SheetRunner):
    salt = 2


class FailingRunner(SheetRunner):
    """Cannot hold some receipts."""

    def extract(self, image: bytes) -> str:
        sheet = json.loads(image)
        if sheet["order_key"] % 50 == 3:
            raise MemoryError(f"receipt {sheet['order_key']} is too large")
        return self._read(sheet)


RUNNERS = {**dict(zip(fx.MODELS, (SheetRunner, ChattyRunner, ThirdRunner), strict=True)), "model-d": _NoKey, "model-e": FailingRunner}


@query
def compare_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models run over every receipt, asked again, scored and compared.

    One cannot be built, one raises on some receipts, one answers at the second try.
    """
    models = C.requested_models(fx.MODELS, RUNNERS, keyed="model-d", has_key=True) + ["model-e"]
    gt = fx.receipts_gt(spark, sf_dir)
    sheet = F.to_json(F.struct("order_key", "store_name", "total", "items"))
    samples = gt.select("receipt_id", F.encode(sheet, "UTF-8").alias("content"))
    answered = written(P.run_models(samples, {m: RUNNERS[m] for m in models}, "receipt_id"), "answers")
    pred = answered.filter("payload is not null").select("receipt_id", "model_id", S.scorable_json(F.col("payload")).alias("pred"))
    scored = S.score_receipts(S.pair_models(fx.truth(gt), pred, models), ("receipt_id", "model_id"))
    table = C.compare_run(scored, models, P.first_failures(answered, "receipt_id"))
    twice = answered.groupBy("model_id").agg(F.count_if(F.col("asked") > 1).alias("asked_again"))
    return table.join(twice, "model_id").select(
        "model_id", *[_r(c).alias(c) for c in C.F1_COLUMNS], "skipped", "reason",
        F.when(~F.col("skipped"), F.col("asked_again")).alias("asked_again"))


@query
def collect_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a task; only finished ones have a result."""
    events = fx.table(spark, sf_dir, "events")
    state = raw.event_state(F.col("event_type"))
    results = events.select(F.col("event_id").alias("task_id"), state.alias("state")).filter(
        F.col("state").isin("SUCCESS", "FAILURE")
    )
    return J.tally(J.collect(events.select(F.col("event_id").alias("task_id")), results))


@query
def restore_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored score records with absent fields, averaged."""
    key = F.col("o_orderkey")
    full = '{"precision":1.0,"recall":0.5,"f1":0.75,"n_pred":1,"n_gt":2}'
    text = (
        F.when(key % 3 == 0, F.lit(f'{{"store_name":{full}}}'))
        .when(key % 3 == 1, F.lit(f'{{"total":{full},"item_qty":{{"f1":0.25}}}}'))
        .otherwise(F.lit("{}"))
    )
    stored = fx.table(spark, sf_dir, "orders").select(J.restore_scores(text).alias("s")).select("s.*")
    rows = S.summary_rows(S.mean_scores(stored))
    return rows.select("field", *[_r(p).alias(p) for p in S.PARTS[:3]], "n_pred", "n_gt")


# --- responses --------------------------------------------------------------


@query
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 on every turn."""
    parsed = raw.responses(spark, sf_dir).withColumn("r", R.parse_response(F.col("response")))
    return parsed.select(
        "conv_id",
        "turn",
        F.col("r.status").alias("parse_status"),
        F.get_json_object("r.payload", "$.store").alias("store"),
        F.get_json_object("r.payload", "$.total").cast("bigint").alias("total"),
    )


@query
def retry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: turns as attempts, the first that parses wins."""
    attempts = raw.responses(spark, sf_dir).withColumn("r", R.parse_response(F.col("response"))).select(
        "conv_id", (F.col("turn") + 1).alias("attempt"), "r.status", "r.payload"
    )
    kept = J.retry_fallback(attempts, "conv_id")
    return kept.select(
        "conv_id",
        "parse_status",
        "retried",
        F.get_json_object("payload", "$.store").alias("store"),
    )


@query
def unwrap_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P7, P8 on decoded sequences."""
    s = F.col("sequence")
    return raw.sequences(spark, sf_dir).select(
        "receipt_id",
        R.between_tags(s).alias("payload"),
        R.unwrap_envelope(R.between_tags(s)).alias("inner_payload"),
        R.slice_tags(s).alias("sliced"),
    )


@query
def ocr_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 to P14 on whole documents."""
    found = raw.ocr_texts(spark, sf_dir).select("doc_id", X.ocr_receipt(F.col("text")).alias("r"))
    return found.select(
        "doc_id",
        F.col("r.store.name").alias("store_name"),
        F.col("r.total").alias("total"),
        F.size("r.items").alias("n_items"),
        F.length("r.metadata.notes").alias("n_notes"),
    )


# --- normalisation ----------------------------------------------------------


def _normalised(df: DataFrame) -> DataFrame:
    item_totals = F.aggregate("receipt.items", F.lit(0.0), lambda a, i: a + i["total"])
    return df.select(
        "receipt_id",
        F.col("receipt.store.name").alias("store"),
        F.col("receipt.date").alias("date"),
        _r("receipt.total").alias("total"),
        _r("receipt.subtotal").alias("subtotal"),
        F.when(F.col("receipt").isNotNull(), F.size("receipt.items")).alias("n_items"),
        F.element_at("receipt.items", -1)["line_number"].alias("last_line"),
        F.round(item_totals, 4).alias("item_total"),
        F.col("receipt.metadata.image_path").alias("image_path"),
        "error",
    )


def _cord_snapshot(spark: SparkSession, gt: DataFrame) -> DataFrame:
    """S3, F2: the raw corpus as stored, every 37th row without an image."""
    stored = raw.cord_raw(gt).drop("body").withColumn(
        "image", F.when(F.col("order_key") % 37 != 0, F.col("image"))
    )
    return annotations.read_cord(spark, raw.snapshot(stored, "cord"))


def _sroie_snapshot(spark: SparkSession, gt: DataFrame) -> DataFrame:
    """S4."""
    return annotations.read_sroie(spark, raw.snapshot(raw.sroie_raw(gt), "sroie"))


@query
def normalize_cord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F2, P2, P6, P17, P22, N2, N5, N6."""
    return _normalised(N.normalize_cord(_cord_snapshot(spark, fx.receipts_gt(spark, sf_dir))))


@query
def normalize_sroie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4, P1, P17, P22, T4f."""
    return _normalised(N.normalize_sroie(_sroie_snapshot(spark, fx.receipts_gt(spark, sf_dir))))


def _remapped(df: DataFrame) -> DataFrame:
    return df.select(
        "receipt_id",
        F.col("receipt.store.name").alias("store"),
        _r("receipt.total").alias("receipt_total"),
        F.explode_outer("receipt.items").alias("i"),
    ).select(
        "receipt_id",
        "store",
        "receipt_total",
        F.col("i.line_number").alias("line_number"),
        F.col("i.name").alias("name"),
        _r("i.quantity").alias("quantity"),
        _r("i.unit_price").alias("unit_price"),
        _r("i.total").alias("total"),
    )


def _model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw corpus objects as model output, half of them in an envelope."""
    body = raw.cord_raw(fx.receipts_gt(spark, sf_dir), notes=False)
    enveloped = F.concat(F.lit('{"cord-v2":'), F.col("body"), F.lit("}"))
    return body.select(
        "receipt_id",
        F.when(F.col("order_key") % 2 == 0, enveloped).otherwise(F.col("body")).alias("payload"),
    )


@query
def remap_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P5, P6, N3, N5."""
    return _remapped(N.remap_eval(_model_output(spark, sf_dir)))


@query
def remap_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5, P6, N4, N5, N6, P17."""
    return _remapped(N.remap_serving(_model_output(spark, sf_dir)))


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corpora together, counted by source."""
    gt = fx.receipts_gt(spark, sf_dir)
    sroie = N.readable(N.normalize_sroie(_sroie_snapshot(spark, gt)))
    cord = N.readable(N.normalize_cord(_cord_snapshot(spark, gt)))
    common = lambda df: df.withColumn(
        "receipt",
        F.struct(
            *[F.col(f"receipt.{c}").alias(c) for c in ("store", "date", "items", "total", "currency", "metadata")]
        ),
    )
    both = N.union_sources(common(sroie), common(cord))
    return both.groupBy(F.col("receipt.metadata.source").alias("source")).agg(
        F.count("*").alias("n"), F.round(F.sum("receipt.total"), 3).alias("sum_total")
    )


# --- validation -------------------------------------------------------------


def _receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.receipt_json(fx.receipts_gt(spark, sf_dir))


@query
def validate_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, V1 to V14."""
    checked = V.validate(_receipt_texts(spark, sf_dir))
    return checked.select(
        "receipt_id",
        "valid",
        F.size("violations").alias("n_violations"),
        F.try_element_at("violations", F.lit(1)).alias("first_violation"),
    )


@query
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    return V.completeness(_receipt_texts(spark, sf_dir))


@query
def extraction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status codes over all receipts."""
    key = F.col("order_key")
    kind = F.when(key % 10 == 1, "text/plain").when(key % 10 != 2, "image/jpeg")
    error = F.when(key % 10 == 3, "decoder failed")
    checked = V.violations(_receipt_texts(spark, sf_dir), name="problems")
    codes = checked.select(V.outcome(kind, key % 10 != 4, error, F.col("problems")).alias("status_code"))
    return codes.groupBy("status_code").agg(F.count("*").alias("n"))


# --- corpus -----------------------------------------------------------------


@query
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size seeded split."""
    return K.split_train_val(raw.receipt_keys(spark, sf_dir), "receipt_id").select("receipt_id", "split")


def _image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts in key order; every third has no stored image path."""
    numbered = dense_ordinal(raw.receipt_keys(spark, sf_dir), "receipt_id", unique=True)
    stored = F.concat(F.lit("scans/2024/receipt_"), F.col("receipt_id").cast("string"), F.lit(".jpg"))
    return numbered.withColumn("image_path", F.when(F.col("receipt_id") % 3 != 0, stored))


def _image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored images: one per order with lines, and one per part number for the fallback names."""
    lines, parts = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "part")
    scans = lines.select(
        F.concat(F.lit("img/receipt_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("path")
    )
    return scans.union(parts.select(F.format_string("img/cord_%05d.jpg", "p_partkey").alias("path")))


@query
def resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, J2, F3, S7, T3."""
    found = K.resolve_images(_image_records(spark, sf_dir), _image_listing(spark, sf_dir))
    return found.select("receipt_id", "image_name", "exists")


@query
def assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards over the records whose image exists."""
    found = K.with_image(K.resolve_images(_image_records(spark, sf_dir), _image_listing(spark, sf_dir)))
    return K.shard_sizes(K.assign_shards(found.select("receipt_id"), "receipt_id"), "receipt_id")


@query
def seeded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, L3: batches of four of a seeded shuffle."""
    return K.batches(raw.receipt_keys(spark, sf_dir), "receipt_id", 4, seed=7).select("batch_id", "receipt_id")


@query
def first_n_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the sample limit; the first rows are numbered, not the table."""
    first = raw.receipt_keys(spark, sf_dir).orderBy("receipt_id").limit(200)
    return first.select("receipt_id", (F.row_number().over(Window.orderBy("receipt_id")) - 1).cast("long").alias("ordinal"))


@query
def training_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target sequences cut at 24 tokens."""
    texts = raw.receipt_json(fx.receipts_gt(spark, sf_dir), defects=False)
    return K.training_targets(texts, max_length=24).select(
        "receipt_id", "n_tokens", "truncated", F.element_at("tokens", -1).alias("last_token")
    )


@query
def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bytes as images, every third after a failed answer."""
    pages = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("receipt_id"),
        F.encode("html", "UTF-8").alias("content"),
        F.when(F.col("page_id") % 3 == 0, "not json").alias("failed"),
    )
    asked = Q.build_requests(pages, RECEIPT, failed="failed")
    parts = F.col("messages")[0]["content"]
    return asked.select(
        "receipt_id",
        F.size("messages").alias("n_messages"),
        F.length(parts[1]["text"]).alias("prompt_chars"),
        F.md5(parts[0]["data"].cast("binary")).alias("image_md5"),
    )


# --- jobs and streams -------------------------------------------------------


@query
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, P21 in batch."""
    return J.latest_state(raw.job_events(fx.table(spark, sf_dir, "events")))


@query
def dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 in batch: first delivery per task."""
    first = J.first_result(raw.deliveries(fx.table(spark, sf_dir, "events")))
    # Wall-clock time, as the event table stores it.
    return first.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


@query
def running_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 in batch: samples and mean overall F1 per model."""
    scored = S.score_receipts(_model_pairs(spark, sf_dir), ("receipt_id", "model_id"))
    return scored.groupBy("model_id").agg(
        F.count("*").alias("n"), _r(F.avg("overall_f1")).alias("mean_f1")
    )


@query
def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, P21 over the event table as a stream of four micro-batches in no order of time."""
    work = fresh_dir(spark, "job-states")
    events = raw.job_events(raw.batched_stream(fx.table(spark, sf_dir, "events"), "event_id", f"{work}/in"))
    stream.start_job_states(events, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return stream.current_states(spark, f"{work}/out")


@query
def stream_job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 with a result life of a day, over four micro-batches in no order of time: the jobs that still show a state."""
    work = fresh_dir(spark, "job-life")
    events = raw.job_events(raw.batched_stream(fx.table(spark, sf_dir, "events"), "event_id", f"{work}/in"))
    life.start_expiring_states(events, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return life.live_states(spark, f"{work}/out").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


class BusyRunner(P.Runner):
    """A service that turns the first tries of some images away; the image says how many."""

    model_id = "busy"

    def extract(self, image: bytes) -> str:
        return self.attempt(image, 1)

    def attempt(self, image: bytes, number: int) -> str:
        fails, text = image.decode().split("|")
        if number <= int(fails):
            raise ConnectionError("busy")
        return text


@query
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a submission to a busy service; failed ones come back when due, three times at most."""
    work = fresh_dir(spark, "retries")
    sent = raw.submissions(fx.table(spark, sf_dir, "events"))
    arriving = raw.timed_stream(sent, "ts", f"{work}/in", batches=4, closing=5)
    life.start_retrying(arriving, "busy", BusyRunner, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return life.tries(spark, f"{work}/out").filter("job_id >= 0").select(
        "job_id", "attempt", F.col("due").cast("timestamp_ntz").alias("due"), "raw", "error", "waits")


@query
def stream_dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 over four micro-batches in no order of time: each task comes through once."""
    work = fresh_dir(spark, "results")
    results = raw.deliveries(raw.batched_stream(fx.table(spark, sf_dir, "events"), "event_id", f"{work}/in"))
    stream.start_settling(results, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return spark.read.parquet(f"{work}/out").groupBy("task_id").agg(F.count("*").alias("n"))


@query
def stream_running_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples written once, then read as a stream of score rows."""
    work = fresh_dir(spark, "running")
    scored = S.score_receipts(_model_pairs(spark, sf_dir), ("receipt_id", "model_id"))
    log = scored.select("receipt_id", "model_id", "overall_f1")
    log.write.parquet(f"{work}/log")
    rows = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{work}/log")
    )
    stream.start_running_means(rows, f"{work}/out", f"{work}/ckpt").awaitTermination()
    return stream.last_means(spark, f"{work}/out").select("model_id", "n", _r("mean_f1").alias("mean_f1"))


@query
def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted receipts through the model stage to valid and quarantined rows."""
    work = fresh_dir(spark, "extract")
    bodies = raw.cord_raw(fx.receipts_gt(spark, sf_dir), notes=False)
    key = F.col("order_key")
    submitted = bodies.select(
        F.col("receipt_id").cast("string").alias("job_id"),
        F.when(key % 8 == 1, "text/plain").otherwise("image/jpeg").alias("content_type"),
        F.when(key % 8 == 2, F.encode(F.lit("no json"), "UTF-8"))
        .when(key % 8 == 3, F.unhex(F.lit("FF")))
        .otherwise(F.encode("body", "UTF-8"))
        .alias("content"),
    )
    # every eighth order asks for a model whose credential is not set
    asked = submitted.withColumn("model", F.when(F.col("job_id").cast("bigint") % 8 == 4, "model-d").otherwise("text"))
    asked.write.partitionBy("model").parquet(f"{work}/in")
    for model, factory in (("text", TextRunner), ("model-d", _NoKey)):
        arriving = spark.readStream.schema(submitted.schema).option("maxFilesPerTrigger", 8).parquet(
            f"{work}/in/model={model}"
        )
        stream.start_extraction(
            arriving, model, factory, f"{work}/out/{model}", f"{work}/ckpt/{model}"
        ).awaitTermination()
    text, unready = (stream.extraction_results(spark, f"{work}/out/{m}") for m in ("text", "model-d"))
    done = text.unionByName(unready)
    return done.groupBy("status_code", "valid").agg(F.count("*").alias("n"))


@query
def predict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images through the model stage, then read as OCR text."""
    sent = raw.uploads(fx.table(spark, sf_dir, "documents")).select("job_id", "content")
    read = P.predict(sent, "text", TextRunner)
    return read.select(
        "job_id",
        "model_id",
        "attempt",
        X.ocr_store_name(F.col("raw")).alias("store_name"),
        F.length("raw").alias("n_chars"),
        "error",
    )


def _packed(spark: SparkSession, sf_dir: str, path: str) -> None:
    # Numbered are the heads of the receipts; their texts are made after that and move once, to their shards.
    heads = fx.receipts_gt(spark, sf_dir, with_items=False).drop("items")
    numbered = fx.add_items(spark, sf_dir, K.assign_shards(heads, "receipt_id"))
    texts = raw.receipt_json(numbered, defects=False, keep=("shard_id", "idx"))
    bytes_ = F.encode(F.col("receipt_id").cast("string"), "UTF-8")
    shards.write_shards(texts.withColumn("jpg", bytes_), path)


@query
def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts packed into tar shards and read back."""
    work = fresh_dir(spark, "shards")
    _packed(spark, sf_dir, work)
    return shards.read_shards(spark, work).select(
        "shard_id",
        "idx",
        F.decode("jpg", "UTF-8").cast("bigint").alias("receipt_id"),
        F.get_json_object("json", "$.store.name").alias("store"),
        (F.length(F.get_json_object("json", "$.items")) > 2).alias("has_items"),
    )


@query
def buffered_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch over the packed shards in seeded order, each through a shuffle buffer.

    SQL knows the order of shards, not the draws: told is whether a sample came within the buffer's reach.
    """
    work = fresh_dir(spark, "epoch")
    _packed(spark, sf_dir, work)
    epoch = shards.read_shards(spark, work, ["shard_place", "place", "shard_id", "idx", "json"], seed="7:0", buffer=100)
    return epoch.select(
        "shard_place", "shard_id", "idx", F.get_json_object("json", "$.store.name").alias("store"),
        (F.col("idx") <= F.col("place") + 100).alias("in_reach"))


@query
def list_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and sizes of all packed shards."""
    work = fresh_dir(spark, "listed")
    _packed(spark, sf_dir, work)
    listed = images.list_prefix(spark, work)
    return listed.select("key", (F.col("length") > 0).alias("has_bytes"))


QUERIES.update(roundtrips.QUERIES)
