"""Raw receipt records and model output to the receipt schema.

Each source keeps its own reading rules; rows that the rules cannot read carry
an ``error`` instead of a receipt and never fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import (
    cord_number,
    corpus_quantity,
    eval_quantity,
    locale_number,
    serving_number,
    serving_quantity,
    strict_double,
    strip,
    zero_as_null,
)
from ..functions.responses import json_kind, unwrap_envelope
from ..functions.text import date_prefix

# Placeholders, dates and notes of the normalised corpora.
NO_DATE = "1970-01-01"
SROIE_NOTES = (
    "Sparse — only store/date/total reliably populated. Line items must be re-annotated."
)
CORD_NOTES = "Line items populated. Currency is KRW unless otherwise marked."

# Fixed value: the annotator that served receipts carry.
SERVING_ANNOTATOR = "donut-cord"

_LINE = "struct<nm:string,cnt:string,unitprice:string,price:string>"
_SUB_TOTAL = "struct<storenm:string,subtotal_price:string>"
_CORD = "struct<menu:string,sub_total:string,total:string>"
_SROIE = "struct<company:string,date:string,address:string,total:string>"
_ITEM_OUT = (
    "struct<line_number:int,name:string,quantity:double,unit:string,unit_price:double,total:double,"
    "normalized_name:string,sku:string,category:string,tax_code:string,discount_applied:double>"
)
_DISCOUNTS = "array<struct<description:string,amount:double,applies_to_line:int>>"
_TAXES = "array<struct<label:string,rate:double,amount:double>>"


def _unknown() -> list[Column]:
    """Item fields that no source tells."""
    texts = ("normalized_name", "sku", "category", "tax_code")
    return [F.lit(None).cast("string").alias(n) for n in texts] + [
        F.lit(None).cast("double").alias("discount_applied")
    ]


def _none_of(kind: str) -> Column:
    return F.array().cast(kind)


def placeholder_items() -> Column:
    """The single line that stands for "no line items"."""
    return F.array(
        F.struct(
            F.lit(1).alias("line_number"),
            F.lit("UNKNOWN").alias("name"),
            F.lit(1.0).alias("quantity"),
            F.lit("each").alias("unit"),
            F.lit(None).cast("double").alias("unit_price"),
            F.lit(0.0).alias("total"),
            *_unknown(),
        )
    ).cast(f"array<{_ITEM_OUT}>")


def or_placeholder(items: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(placeholder_items())


def has_key(json: Column, key: str) -> Column:
    """True when the JSON object has the key, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def menu_elements(menu: Column) -> Column:
    """Raw JSON text of each menu entry; a single object is a list of one."""
    text = F.trim(menu)
    return (
        F.when(text.startswith("["), F.from_json(text, "array<string>"))
        .when(text.isNotNull(), F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )


def _menu_items(menu: Column, build) -> Column:
    """Items with 1-based line numbers; entries that are no object are skipped but counted."""
    read = F.transform(
        menu_elements(menu),
        lambda raw: F.struct(
            raw.alias("raw"), F.when(raw.startswith("{"), F.from_json(raw, _LINE)).alias("m")
        ),
    )
    # Each entry is parsed once: the second pass only reads fields of the first one's struct.
    made = F.transform(
        read, lambda e, i: F.when(e["m"].isNotNull(), build(e["m"], e["raw"], i + 1))
    )
    return F.filter(made, lambda item: item.isNotNull())


def _item(line: Column, name: Column, quantity: Column, unit_price: Column, total: Column) -> Column:
    return F.struct(
        line.cast("int").alias("line_number"),
        name.alias("name"),
        quantity.alias("quantity"),
        F.lit("each").alias("unit"),
        unit_price.alias("unit_price"),
        total.alias("total"),
        *_unknown(),
    )


def _metadata(source: str, annotator: str, notes: str | None, image: Column) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        F.lit(annotator).alias("annotator"),
        F.lit(notes).cast("string").alias("notes"),
        image.cast("string").alias("image_path"),
    )


def _receipt(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def normalize_sroie(raw: DataFrame, annotator: str = "tallyroll", text: str = "parsed_data") -> DataFrame:
    """Adds ``receipt`` and ``error`` to rows of ``ordinal`` (stream index) and JSON ``text``."""
    json = F.coalesce(F.nullif(F.col(text), F.lit("")), F.lit("{}"))
    parsed = raw.withColumn("_json", json).withColumn("_p", F.from_json("_json", _SROIE))

    def or_default(key: str, default: str) -> Column:
        # An absent key takes the default, a JSON null turns into the text "None".
        value = F.col(f"_p.{key}")
        return F.coalesce(value, F.when(has_key(F.col("_json"), key), "None").otherwise(default))

    total = F.col("_p.total")
    amount = F.when(total.isNull() | (total == ""), 0.0).otherwise(strict_double(total))
    name = strip(or_default("company", "UNKNOWN"))
    receipt = _receipt(
        store=F.struct(F.when(name == "", "UNKNOWN").otherwise(name).alias("name")),
        date=date_prefix(or_default("date", NO_DATE)),
        items=placeholder_items(),
        subtotal=F.lit(None).cast("double"),
        discounts=_none_of(_DISCOUNTS),
        taxes=_none_of(_TAXES),
        total=amount,
        currency=F.lit("USD"),
        payment=F.struct(F.lit("other").alias("method")),
        metadata=_metadata(
            "sroie", annotator, SROIE_NOTES, F.format_string("images/sroie_%05d.jpg", "ordinal")
        ),
    )
    error = F.when(~F.coalesce(json_kind(F.col("_json")).startswith("OBJECT"), F.lit(False)), "not a JSON object").when(
        amount.isNull(), "total is not a number"
    )
    return _with_outcome(parsed, receipt, error).drop("_json", "_p")


def cord_document(ground_truth: Column) -> Column:
    """S3: the annotated object, under ``gt_parse`` or bare; a null ``gt_parse`` is no document."""
    return F.when(
        has_key(ground_truth, "gt_parse"), F.get_json_object(ground_truth, "$.gt_parse")
    ).otherwise(ground_truth)


def normalize_cord(
    raw: DataFrame, annotator: str = "tallyroll", text: str = "ground_truth"
) -> DataFrame:
    """Adds ``receipt`` and ``error`` to rows of ``ordinal`` (stream index) and JSON ``text``."""
    parsed = (
        raw.withColumn("_json", cord_document(F.col(text)))
        .withColumn("_c", F.from_json("_json", _CORD))
        .withColumn("_s", F.from_json("_c.sub_total", _SUB_TOTAL))
        .withColumn(
            "_items",
            _menu_items(
                F.col("_c.menu"),
                lambda m, raw_item, i: _item(
                    i,
                    F.coalesce(m["nm"], F.when(has_key(raw_item, "nm"), "None").otherwise("?")),
                    corpus_quantity(m["cnt"]),
                    F.when(m["unitprice"] != "", locale_number(m["unitprice"])),
                    locale_number(m["price"]),
                ),
            ),
        )
    )
    total = F.get_json_object("_c.total", "$.total_price")
    receipt = _receipt(
        store=F.struct(
            F.coalesce(F.nullif("_s.storenm", F.lit("")), F.lit("UNKNOWN")).alias("name")
        ),
        date=F.lit(NO_DATE),
        items=or_placeholder(F.col("_items")),
        subtotal=zero_as_null(locale_number(F.col("_s.subtotal_price"))),
        discounts=_none_of(_DISCOUNTS),
        taxes=_none_of(_TAXES),
        total=locale_number(total),
        currency=F.lit("KRW"),
        payment=F.struct(F.lit("other").alias("method")),
        metadata=_metadata(
            "cord", annotator, CORD_NOTES, F.format_string("images/cord_%05d.jpg", "ordinal")
        ),
    )
    error = F.when(F.col("_c").isNull() | json_kind(F.col("_json")).isNull(), "not JSON").when(
        F.col("_c.sub_total").isNull() & has_key(F.col("_json"), "sub_total"), "sub_total is null"
    )
    return _with_outcome(parsed, receipt, error).drop("_json", "_c", "_s", "_items")


def _with_outcome(df: DataFrame, receipt: Column, error: Column) -> DataFrame:
    """A receipt or an error, never both."""
    return df.withColumn("error", error).withColumn("receipt", F.when(F.col("error").isNull(), receipt))


def readable(df: DataFrame) -> DataFrame:
    """``receipt`` of the rows without an ``error``.

    Both come out of one expression: a filter would be moved below the parsing, and every text parsed twice.
    """
    return df.select(F.inline(F.when(F.col("error").isNull(), F.array(F.struct("receipt")))))


def remap_eval(raw: DataFrame, text: str = "payload") -> DataFrame:
    """Model output to a receipt under the evaluation rules; adds ``receipt``."""
    doc = F.from_json(unwrap_envelope(F.col(text)), _CORD)
    items = _menu_items(
        F.col("_c.menu"),
        lambda m, _, i: _item(
            i,
            F.coalesce(m["nm"], F.lit("")),
            eval_quantity(m["cnt"]),
            cord_number(m["unitprice"]),
            cord_number(m["price"]),
        ),
    )
    store = F.coalesce(F.get_json_object("_c.sub_total", "$.storenm"), F.lit(""))
    receipt = _receipt(
        store=F.struct(store.alias("name")),
        date=F.lit(NO_DATE),
        currency=F.lit("KRW"),
        items=items,
        total=cord_number(F.get_json_object("_c.total", "$.total_price")),
    )
    return raw.withColumn("_c", doc).withColumn("receipt", receipt).drop("_c")


def remap_serving(raw: DataFrame, text: str = "payload") -> DataFrame:
    """Model output to a receipt under the serving rules; adds ``receipt``."""
    doc = F.from_json(unwrap_envelope(F.col(text)), _CORD)
    items = _menu_items(
        F.col("_c.menu"),
        lambda m, raw_item, i: _item(
            i,
            F.coalesce(m["nm"], F.when(~has_key(raw_item, "nm"), "UNKNOWN")),
            serving_quantity(m["cnt"]),
            zero_as_null(serving_number(m["unitprice"])),
            serving_number(m["price"]),
        ),
    )
    store = F.nullif(F.get_json_object("_c.sub_total", "$.storenm"), F.lit(""))
    receipt = _receipt(
        store=F.struct(F.coalesce(store, F.lit("Unknown")).alias("name")),
        date=F.lit(NO_DATE),
        items=or_placeholder(F.col("_i")),
        total=serving_number(F.get_json_object("_c.total", "$.total_price")),
        currency=F.lit("KRW"),
        metadata=_metadata("user_scan", SERVING_ANNOTATOR, None, F.lit(None)),
    )
    return (
        raw.withColumn("_c", doc).withColumn("_i", items).withColumn("receipt", receipt).drop("_c", "_i")
    )


def union_sources(*corpora: DataFrame) -> DataFrame:
    """One corpus from several; ``receipt.metadata.source`` tells them apart."""
    first, *rest = [c.select("receipt") for c in corpora]
    for other in rest:
        first = first.unionByName(other)
    return first
