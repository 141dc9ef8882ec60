"""Precision, recall and F1 per receipt field, and their corpus means.

Input rows carry both sides as ``pred`` and ``gt`` structs in the scorer's form
(see ``schema.SCORABLE``). Scoring itself is narrow: the only shuffles are the
join that pairs the sides and the final partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import metric_number, numeric_match
from ..functions.responses import bare, once
from ..functions.similarity import STORE_THRESHOLD, best_candidates, greedy_pairs, token_sort_ratio
from ..schema import FIELDS, OVERALL_FIELDS

PARTS = ("precision", "recall", "f1", "n_pred", "n_gt")


def field_score(matches: Column, n_pred: Column, n_gt: Column) -> Column:
    """A1: precision, recall and F1 from counts; a zero denominator scores 0."""
    p = F.when(n_pred > 0, matches / n_pred).otherwise(0.0)
    r = F.when(n_gt > 0, matches / n_gt).otherwise(0.0)
    # 2pr / (p + r) with both ratios from one match count
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return _score(p, r, f1, n_pred, n_gt)


def _score(p: Column, r: Column, f1: Column, n_pred: Column, n_gt: Column) -> Column:
    return F.struct(
        p.cast("double").alias("precision"),
        r.cast("double").alias("recall"),
        f1.cast("double").alias("f1"),
        n_pred.cast("bigint").alias("n_pred"),
        n_gt.cast("bigint").alias("n_gt"),
    )


def _presence_score(pred: Column, gt: Column, matched: Column) -> Column:
    """Score of a single-valued field: counts are presence, a match needs both sides."""
    n_pred = F.coalesce(pred, F.lit(False)).cast("int")
    n_gt = F.coalesce(gt, F.lit(False)).cast("int")
    hit = (n_pred == 1) & (n_gt == 1) & F.coalesce(matched, F.lit(False))
    return field_score(hit.cast("int"), n_pred, n_gt)


def join_predictions(gt: DataFrame, pred: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Every truth row with its prediction; a missing one scores as an empty receipt.

    ``pred`` must hold one row per key (and model); use ``latest_prediction`` first otherwise.
    """
    return gt.join(pred, key, "left")


def latest_prediction(pred: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One prediction per key, the last by ``order``; combines before the shuffle."""
    rest = [c for c in pred.columns if c not in keys]
    return pred.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in rest]
    )


def pair_models(gt: DataFrame, pred: DataFrame, models: list[str], key: str = "receipt_id") -> DataFrame:
    """Every truth row once per model, with that model's prediction if there is one.

    Predictions meet their receipt first, as one list, and rows are multiplied only
    after the join: the shuffle carries each truth row once, and predictions of one
    receipt combine before it. The model list is a driver-side registry.
    """
    listed = pred.groupBy(key).agg(F.collect_list(F.struct("model_id", "pred")).alias("_preds"))
    rows = [
        F.struct(
            F.lit(m).alias("model_id"),
            F.get(_of_model(m), F.lit(0))["pred"].alias("pred"),
        )
        for m in models
    ]
    joined = gt.join(listed, key, "left")
    return joined.select(*gt.columns, F.inline(F.array(*rows)))


def _of_model(model: str) -> Column:
    return F.filter("_preds", lambda p: p["model_id"] == model)


def match_items(pairs: DataFrame) -> DataFrame:
    """A4 with W3 bookkeeping: adds ``matched``, the consumed true position per predicted item."""
    return pairs.withColumn(
        "matched", greedy_pairs(F.col("pred.items.name"), F.col("gt.items.name"))
    )


def _length(items: Column) -> Column:
    """Element count; a missing list is empty."""
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def item_counts(pairs: DataFrame) -> DataFrame:
    """Item and match counts of both sides, from ``match_items``."""
    pred, gt = F.col("pred.items"), F.col("gt.items")
    hits = F.filter(
        F.arrays_zip(pred.alias("p"), F.col("matched").alias("j")), lambda h: h["j"] >= 0
    )
    both = F.transform(
        hits, lambda h: F.struct(h["p"].alias("p"), F.element_at(gt, h["j"] + 1).alias("g"))
    )
    return pairs.withColumn("_both", both).select(
        "*",
        _length(pred).alias("n_pred"),
        _length(gt).alias("n_gt"),
        _length(F.col("_both")).alias("name_hits"),
        _length(
            F.filter("_both", lambda b: numeric_match(b["p"]["price"], b["g"]["price"]))
        ).alias("total_hits"),
        _length(
            F.filter("_both", lambda b: b["p"]["quantity"] == b["g"]["quantity"])
        ).alias("qty_hits"),
    ).drop("_both")


def item_scores(n_pred: Column, n_gt: Column, hits: dict[str, Column]) -> dict[str, Column]:
    """The four item fields from counts; two empty lists agree on the count and score 0 elsewhere."""
    none = (n_pred == 0) & (n_gt == 0)
    one = (~none).cast("int")
    same = (n_pred == n_gt).cast("double")
    scores = {"item_count": _score(same, same, same, one, one)}
    for field, hit in hits.items():
        scores[field] = field_score(hit, n_pred, n_gt)
    return scores


def with_store_ratio(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn(
        "store_ratio", token_sort_ratio(F.col("pred.store_name"), F.col("gt.store_name"))
    )


def store_score(ratio: Column) -> Column:
    """A2 over a similarity computed by ``with_store_ratio``."""
    return _presence_score(
        F.col("pred.store_name").isNotNull(),
        F.col("gt.store_name").isNotNull(),
        ratio >= STORE_THRESHOLD,
    )


def total_score() -> Column:
    """A3: presence is *not NULL*, so a total of 0 counts as present."""
    matched = numeric_match(F.col("pred.total"), F.col("gt.total"))
    return _presence_score(F.col("pred.has_total"), F.col("gt.has_total"), matched)


def score_receipts(pairs: DataFrame, keep: tuple[str, ...] = ("receipt_id",)) -> DataFrame:
    """A5: six field scores per row, as one struct column per field, plus ``overall_f1``."""
    counted = item_counts(match_items(with_store_ratio(pairs)))
    items = item_scores(
        F.col("n_pred"),
        F.col("n_gt"),
        {f"item_{h}": F.col(f"{h}_hits") for h in ("name", "total", "qty")},
    )
    scored = counted.select(
        *keep,
        store_score(F.col("store_ratio")).alias("store_name"),
        total_score().alias("total"),
        *[score.alias(field) for field, score in items.items()],
    )
    return scored.withColumn("overall_f1", overall_f1())


def overall_f1(of=lambda field: F.col(f"{field}.f1")) -> Column:
    """Mean of five F1s; the item count is left out."""
    total = sum((of(f) for f in OVERALL_FIELDS[1:]), of(OVERALL_FIELDS[0]))
    return total / len(OVERALL_FIELDS)


def mean_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Mean P, R, F1 and summed counts per field; no rows gives zeros (ungrouped)."""
    aggs = []
    for field in FIELDS:
        means = [F.coalesce(F.avg(f"{field}.{p}"), F.lit(0.0)).alias(p) for p in PARTS[:3]]
        sums = [F.coalesce(F.sum(f"{field}.{n}"), F.lit(0)).alias(n) for n in PARTS[3:]]
        aggs.append(F.struct(*means, *sums).alias(field))
    return scores.groupBy(*by).agg(*aggs)


def summary_rows(means: DataFrame) -> DataFrame:
    """A6 in long form: one row per field, with the overall row last."""
    rows = [
        F.struct(F.lit(f).alias("field"), *[F.col(f"{f}.{p}").alias(p) for p in PARTS])
        for f in FIELDS
    ]
    overall = F.struct(
        F.lit("overall").alias("field"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        overall_f1().alias("f1"),
        F.lit(None).cast("bigint").alias("n_pred"),
        F.lit(None).cast("bigint").alias("n_gt"),
    )
    return means.select(F.inline(F.array(*rows, overall)))


def best_per_item(pairs: DataFrame) -> DataFrame:
    """Each predicted item's most similar true item, before any is consumed."""
    return pairs.withColumn(
        "best", best_candidates(F.col("pred.items.name"), F.col("gt.items.name"))
    )


def scorable_json(text: Column) -> Column:
    """A receipt JSON object in the scorer's form; aliases and absent values are resolved.

    Leaves are read as variants, since plain text would lose that the number 0
    is absent while the text ``"0"`` is not. Each is looked up once: lambdas share nothing.
    """
    def at(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "variant")

    def told(number: Column) -> Column:
        # Doubles print in positional form up to 1e16, with at least one decimal.
        wide = F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when((F.abs(number) >= 1e7) & (F.abs(number) < 1e16), wide).otherwise(number.cast("string"))

    def as_text(v: Column, kind: Column) -> Column:
        return (
            F.when(kind == "VOID", None)
            .when(kind == "BOOLEAN", F.initcap(v.cast("string")))
            .when((kind == "STRING") | kind.rlike("^(ARRAY|OBJECT)"), v.cast("string"))
            .when(kind == "BIGINT", v.cast("string"))
            .otherwise(once(F.try_variant_get(v, "$", "double"), told))
        )

    def present(v: Column, kind: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        empty = (
            F.when(kind == "VOID", True)
            .when(kind == "STRING", plain == "")
            .when(kind == "BOOLEAN", plain == "false")
            .when(kind.rlike("^(ARRAY|OBJECT)"), plain.isin("[]", "{}"))
            .otherwise(F.try_variant_get(v, "$", "double") == 0)
        )
        return F.when(~empty, as_text(v, kind))

    def leaf(v: Column, path: str, read=present) -> Column:
        return once(at(v, path), lambda found: once(F.schema_of_variant(found), lambda kind: read(found, kind)))

    def items(doc: Column, path: str) -> Column:
        return once(F.try_variant_get(doc, path, "array<variant>"), lambda found: F.when(F.size(found) > 0, found))

    def quantity(text: Column) -> Column:
        return once(bare(text), lambda body: F.when(body != "", body))

    def row(i: Column) -> Column:
        return F.struct(
            leaf(i, "$.name").alias("name"),
            once(leaf(i, "$.quantity"), quantity).alias("quantity"),
            metric_number(F.coalesce(leaf(i, "$.total"), leaf(i, "$.unit_price"))).alias("price"),
        )

    def receipt(doc: Column) -> Column:
        rows = F.coalesce(items(doc, "$.line_items"), items(doc, "$.items"), F.array().cast("array<variant>"))
        return once(leaf(doc, "$.total", as_text), lambda total: F.struct(
            F.coalesce(leaf(doc, "$.store.name"), leaf(doc, "$.store_name")).alias("store_name"),
            total.isNotNull().alias("has_total"),
            metric_number(total).alias("total"),
            F.transform(rows, row).alias("items"),
        ))

    return once(F.try_parse_json(text), receipt)
