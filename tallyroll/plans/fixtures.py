"""Receipts, predictions, responses and events derived from the driver tables.

An order is a receipt and its line items are the receipt's lines, whatever its
size; its id is the order's key. Lines are gathered from lists that each map task
has already made, and a receipt with many lines is matched in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import metric_number, zero_as_null

MODELS = ("model-a", "model-b", "model-c")
LINE_ORDER = ("no", "name", "quantity", "total")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .select(
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("no"),
            "name",
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("total"),
        )
    )


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    shop = (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.concat_ws(" ", "n_name", "c_mktsegment").alias("store_name"),
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(shop, "o_custkey")
        .select(
            F.col("o_orderkey").alias("order_key"),
            "store_name",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_totalprice").alias("total"),
        )
    )


def _collected(lines: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its lines in order; positions are the line numbers."""
    ordered = F.sort_array(F.collect_list(F.struct(*LINE_ORDER)))
    return lines.groupBy(*keys).agg(ordered.alias("items"))


def add_items(spark: SparkSession, sf_dir: str, heads: DataFrame) -> DataFrame:
    """``heads`` with the ``items`` of their ``order_key``; an order without lines has an empty list."""
    items = _collected(_lines(spark, sf_dir), "order_key")
    return heads.join(items, "order_key", "left").withColumn("items", F.coalesce("items", _no_items()))


def _no_items() -> Column:
    return F.array().cast("array<struct<no:int,name:string,quantity:double,total:double>>")


def receipts_gt(spark: SparkSession, sf_dir: str, with_items: bool = True) -> DataFrame:
    """``receipt_id, order_key, store_name, date, total, items[no, name, quantity, total]``.

    Without items the list is empty and no line is read. The id is named after the
    join, so Spark knows that rows dealt by the order are dealt by the receipt.
    """
    heads = _heads(spark, sf_dir)
    whole = add_items(spark, sf_dir, heads) if with_items else heads.withColumn("items", _no_items())
    return whole.select(F.col("order_key").alias("receipt_id"), "order_key", "store_name", "date", "total", "items")


def _tokens(name: Column) -> Column:
    return F.split(name, " ")


def _edit(line_no: Column, item: Column, order_key: Column, salt: Column) -> Column:
    """One predicted line: a deterministic mistake chosen by order, line and model."""
    kind = F.pmod(order_key * 7 + line_no + salt, F.lit(10))
    tokens = _tokens(item["name"])
    name = (
        F.when(kind == 1, F.array_join(F.reverse(tokens), " "))
        .when(kind == 2, F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), " "))
        .when(kind == 6, "UNKNOWN")
        .otherwise(item["name"])
    )
    quantity = (
        F.when(kind == 5, (item["quantity"] + 1).cast("string"))
        .when(kind == 8, item["quantity"].cast("bigint").cast("string"))
        .otherwise(item["quantity"].cast("string"))
    )
    total = (
        F.when(kind == 3, item["total"] * 1.015)
        .when(kind == 4, item["total"] * 1.05)
        .when(kind == 7, 0.0)
        .otherwise(item["total"])
    )
    return F.struct(
        kind.alias("kind"),
        line_no.alias("source_line"),
        name.alias("name"),
        quantity.alias("quantity"),
        F.when(kind == 7, item["total"]).alias("unit_price"),
        total.alias("total"),
    )


def receipts_pred(gt: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """``receipt_id, model_id, store_name, total, items[source_line, name, quantity, unit_price, total]``.

    Every 11th order has no prediction at all; the models differ by their salt. That
    test names the list too, else Spark moves it below the gathering of the lists,
    which truth and predictions then could not share.
    """
    key = F.col("order_key")
    each = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(s).alias("salt")) for s, m in enumerate(models)])
    salted = F.explode(F.when((key % 11 != 0) & (F.size("items") >= 0), each))
    made = F.transform(
        "items", lambda item, i: _edit(i + 1, item, key, F.col("m.salt"))
    )
    store = F.split("store_name", " ")
    return (
        gt.withColumn("m", salted)
        .select(
            "receipt_id",
            F.col("m.model_id").alias("model_id"),
            F.when((key + F.col("m.salt")) % 5 == 0, F.array_join(F.reverse(store), " "))
            .when((key + F.col("m.salt")) % 5 == 1, F.element_at(store, 1))
            .when((key + F.col("m.salt")) % 17 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("store_name"))
            .alias("store_name"),
            F.when(key % 13 == 0, F.concat(F.lit("$"), F.col("total").cast("string")))
            .when(key % 7 == 0, (F.col("total") * 1.03).cast("string"))
            .otherwise(F.col("total").cast("string"))
            .alias("total"),
            F.filter(made, lambda line: line["kind"] != 0).alias("items"),
        )
    )


def truth(gt: DataFrame) -> DataFrame:
    """Ground truth in the scorer's form: ``receipt_id, gt``."""
    items = F.transform(
        "items",
        lambda i: F.struct(
            i["name"].alias("name"),
            zero_as_null(i["quantity"]).cast("string").alias("quantity"),
            zero_as_null(i["total"]).alias("price"),
        ),
    )
    return gt.select(
        "receipt_id",
        F.struct(
            "store_name",
            F.col("total").isNotNull().alias("has_total"),
            "total",
            items.alias("items"),
        ).alias("gt"),
    )


def predictions(pred: DataFrame) -> DataFrame:
    """Predictions in the scorer's form: ``receipt_id, model_id, pred``."""
    items = F.transform(
        "items",
        lambda i: F.struct(
            i["name"].alias("name"),
            i["quantity"].alias("quantity"),
            F.coalesce(zero_as_null(i["total"]), zero_as_null(i["unit_price"])).alias("price"),
        ),
    )
    return pred.select(
        "receipt_id",
        "model_id",
        F.struct(
            "store_name",
            F.col("total").isNotNull().alias("has_total"),
            metric_number(F.col("total")).alias("total"),
            items.alias("items"),
        ).alias("pred"),
    )
