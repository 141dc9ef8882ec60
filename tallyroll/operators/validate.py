"""Receipt rules over variant values, completeness and the outcome of an extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAYMENT_METHODS, SOURCES, UNITS

NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
REQUIRED = ("store", "date", "items", "total")
NULLABLE_TEXT = ("time", "receipt_number", "cashier", "register")


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant")


def _kind(value: Column) -> Column:
    """Type name of a variant; NULL when it is absent."""
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _is(kind: Column, pattern: str) -> Column:
    return kind.rlike(pattern)


def _wrong(value: Column, pattern: str) -> Column:
    """Present, and of another type."""
    return F.coalesce(~_is(_kind(value), pattern), F.lit(False))


def _not_in(value: Column, allowed: tuple[str, ...]) -> Column:
    kind = _kind(value)
    return F.coalesce(kind.isNotNull() & ~((kind == "STRING") & _text(value).isin(*allowed)), F.lit(False))


def _off_pattern(value: Column, pattern: str) -> Column:
    """A string that misses the pattern; other types are not the pattern's business."""
    return F.coalesce((_kind(value) == "STRING") & ~_text(value).rlike(pattern), F.lit(False))


def _not_integer(value: Column, least: int | None = None) -> Column:
    """Not a whole number (1.0 is one), or below ``least``; absent is fine."""
    number = F.try_variant_get(value, "$", "double")
    bad = ~_is(_kind(value), NUMBER) | (number != F.floor(number))
    if least is not None:
        bad = bad | (number < least)
    return F.coalesce(bad, F.lit(False))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


NULL_OR_TEXT = "^(VOID|STRING)$"
NULL_OR_NUMBER = f"{NUMBER}|^VOID$"

# The fields that rules look at, by object. An object is read in one pass to a struct
# of their values; what is no object, or JSON null, gives a null struct.
OBJECTS = {
    "store": ("name", "branch", "address", "phone", "vat_number"),
    "payment": ("method", "card_last4", "amount_tendered", "change_given"),
    "loyalty": ("program", "card_id_masked", "points_earned", "points_balance"),
    "metadata": ("source", "annotator", "captured_at", "device", "notes", "image_path"),
}
ELEMENTS = {
    "items": (
        "line_number", "name", "normalized_name", "sku", "category", "tax_code", "quantity", "unit", "total",
        "unit_price", "discount_applied",
    ),
    "discounts": ("description", "amount", "applies_to_line"),
    "taxes": ("label", "rate", "amount"),
}


def _struct(fields: tuple[str, ...]) -> str:
    return f"struct<{','.join(f'{f}:variant' for f in fields)}>"


# Message and test per element of a list.
ITEM_RULES = (
    ("items must hold objects", lambda i: i.isNull()),
    (
        "item needs line_number, name and total",
        lambda i: _any(*[i[f].isNull() for f in ("line_number", "name", "total")]),
    ),
    ("line_number must be an integer from 1", lambda i: _not_integer(i["line_number"], 1)),
    (
        "item text fields must be text",
        lambda i: _any(
            _wrong(i["name"], "^STRING$"),
            *[_wrong(i[f], NULL_OR_TEXT) for f in ("normalized_name", "sku", "category", "tax_code")],
        ),
    ),
    ("quantity must be a number", lambda i: _wrong(i["quantity"], NUMBER)),
    ("unit is not known", lambda i: _not_in(i["unit"], UNITS)),
    (
        "item amounts must be numbers",
        lambda i: _any(
            _wrong(i["total"], NUMBER),
            *[_wrong(i[f], NULL_OR_NUMBER) for f in ("unit_price", "discount_applied")],
        ),
    ),
)
DISCOUNT_RULES = (
    (
        "discounts are malformed",
        lambda d: _any(
            d.isNull(),
            d["description"].isNull(),
            d["amount"].isNull(),
            _wrong(d["description"], "^STRING$"),
            _wrong(d["amount"], NUMBER),
            _wrong(d["applies_to_line"], "^VOID$") & _not_integer(d["applies_to_line"]),
        ),
    ),
)
TAX_RULES = (
    (
        "taxes are malformed",
        lambda t: _any(
            t.isNull(),
            t["rate"].isNull(),
            t["amount"].isNull(),
            _wrong(t["label"], "^STRING$"),
            _wrong(t["rate"], NUMBER),
            _wrong(t["amount"], NUMBER),
        ),
    ),
)
LISTS = {"items": ITEM_RULES, "discounts": DISCOUNT_RULES, "taxes": TAX_RULES}


def _element_flags(doc: Column, path: str) -> Column:
    """Per element one flag per rule of its list, so every element is read in one pass; NULL unless a list."""
    found = F.try_variant_get(doc, f"$.{path}", f"array<{_struct(ELEMENTS[path])}>")
    tests = LISTS[path]
    return F.transform(
        found, lambda e: F.struct(*[test(e).alias(f"r{n}") for n, (_, test) in enumerate(tests)])
    )


def _rules(doc: Column, read: dict[str, Column]) -> list[tuple[str, Column]]:
    """Message and the condition under which it applies, in rule order."""

    def some(path: str) -> list[tuple[str, Column]]:
        # An array of structs yields the array of one field's values.
        return [
            (msg, F.coalesce(F.array_contains(read[path][f"r{n}"], True), F.lit(False)))
            for n, (msg, _) in enumerate(LISTS[path])
        ]

    def absent(path: str) -> Column:
        # What was read as an object or a list is there; only others are looked up.
        there = _at(doc, path).isNull()
        return read[path].isNull() & there if path in read else there

    def no(path: str, pattern: str) -> Column:
        """Present, and neither the object or list it should be nor of a type that ``pattern`` allows."""
        return read[path].isNull() & _wrong(_at(doc, path), pattern)

    store, payment, loyalty, metadata = (read[p] for p in OBJECTS)
    (discounts, bad_discount), (taxes, bad_tax) = some("discounts")[0], some("taxes")[0]
    return [
        *[(f"{field} is required", absent(field)) for field in REQUIRED],
        ("store must be an object", no("store", "^OBJECT")),
        ("store.name is required", store.isNotNull() & store["name"].isNull()),
        ("store.name must be text", _wrong(store["name"], "^STRING$")),
        (
            "store fields must be text or null",
            _any(*[_wrong(store[f], NULL_OR_TEXT) for f in ("branch", "address", "phone", "vat_number")]),
        ),
        ("date must be text", _wrong(_at(doc, "date"), "^STRING$")),
        (
            "header fields must be text or null",
            _any(*[_wrong(_at(doc, f), NULL_OR_TEXT) for f in NULLABLE_TEXT]),
        ),
        ("items must be a list", no("items", "^ARRAY")),
        ("items must not be empty", F.coalesce(F.size(read["items"]) == 0, F.lit(False))),
        *some("items"),
        (discounts, no("discounts", "^ARRAY") | bad_discount),
        (taxes, no("taxes", "^ARRAY") | bad_tax),
        ("total must be a number", _wrong(_at(doc, "total"), NUMBER)),
        ("subtotal must be a number or null", _wrong(_at(doc, "subtotal"), NULL_OR_NUMBER)),
        (
            "currency must be three capitals",
            _wrong(_at(doc, "currency"), "^STRING$") | _off_pattern(_at(doc, "currency"), "^[A-Z]{3}$"),
        ),
        ("payment must be an object", no("payment", "^OBJECT")),
        ("payment.method is not known", _not_in(payment["method"], PAYMENT_METHODS)),
        (
            "payment.card_last4 must be four digits or null",
            _wrong(payment["card_last4"], NULL_OR_TEXT) | _off_pattern(payment["card_last4"], "^[0-9]{4}$"),
        ),
        (
            "payment amounts must be numbers or null",
            _any(*[_wrong(payment[f], NULL_OR_NUMBER) for f in ("amount_tendered", "change_given")]),
        ),
        (
            "loyalty is malformed",
            _any(
                no("loyalty", "^(OBJECT|VOID)"),
                *[_wrong(loyalty[f], "^STRING$") for f in ("program", "card_id_masked")],
                *[_wrong(loyalty[f], NUMBER) for f in ("points_earned", "points_balance")],
            ),
        ),
        (
            "metadata is malformed",
            _any(
                no("metadata", "^OBJECT"),
                _not_in(metadata["source"], SOURCES),
                *[_wrong(metadata[f], "^STRING$") for f in ("annotator", "captured_at")],
                *[_wrong(metadata[f], NULL_OR_TEXT) for f in ("device", "notes", "image_path")],
            ),
        ),
    ]


def violations(df: DataFrame, json: str = "json", name: str = "violations") -> DataFrame:
    """Adds every rule message the JSON text breaks, in rule order; empty when valid.

    The text is parsed once per row, and each list and object of it is read once.
    """
    names = [*LISTS, *OBJECTS]
    doc, read = F.col("_doc"), {path: F.col(f"_{path}") for path in names}
    walked = df.withColumn("_doc", F.try_parse_json(json)).withColumns(
        {f"_{p}": _element_flags(doc, p) for p in LISTS}
        | {f"_{p}": F.try_variant_get(doc, f"$.{p}", _struct(fields)) for p, fields in OBJECTS.items()}
        | {"_object": F.try_variant_get(doc, "$", "struct<date:variant>").isNotNull()}
    )
    broken = F.array_compact(F.array(*[F.when(test, F.lit(msg)) for msg, test in _rules(doc, read)]))
    checked = F.when(~F.col("_object"), F.array(F.lit("not a JSON object"))).otherwise(broken)
    return walked.withColumn(name, checked).drop("_doc", "_object", *[f"_{p}" for p in names])


def validate(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds ``violations`` and ``valid``."""
    return violations(df, json).withColumn("valid", F.size("violations") == 0)


def presence(json: Column) -> dict[str, Column]:
    """Non-null, and for lists non-empty."""
    doc = F.try_parse_json(json)

    def there(path: str) -> Column:
        kind = _kind(_at(doc, path))
        filled = F.coalesce(F.size(F.try_variant_get(doc, f"$.{path}", "array<variant>")) > 0, F.lit(True))
        return F.coalesce((kind != "VOID") & filled, F.lit(False))

    return {field: there(field) for field in ("store.name", "total", "items")}


def completeness(df: DataFrame, json: str = "json") -> DataFrame:
    """One row per required field: how many rows have it."""
    flags = presence(F.col(json))
    names = list(flags)
    marked = df.select(*[test.alias(f"_f{i}") for i, test in enumerate(flags.values())])
    counts = marked.agg(
        F.count("*").alias("n_total"), *[F.count_if(f"_f{i}").alias(f"_n{i}") for i in range(len(names))]
    )
    rows = [
        F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("n_present"), F.col("n_total"))
        for i, f in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def outcome(
    content_type: Column, model_ready: Column, error: Column, problems: Column
) -> Column:
    """The status code of one extraction."""
    image = F.coalesce(content_type.startswith("image/"), F.lit(False))
    return (
        F.when(~image, 415)
        .when(~model_ready, 503)
        .when(error.isNotNull(), 500)
        .when(F.size(problems) > 0, 422)
        .otherwise(200)
    )
