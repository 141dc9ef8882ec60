"""Request tables for hosted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_base64

# The prompt texts.
PROMPT = (
    "Extract this receipt as JSON conforming to this schema. "
    "Return JSON only, no markdown fences.\nSchema: {schema_json}"
)
RETRY_PROMPT = (
    "Your previous response was not valid JSON. "
    "Please return only a valid JSON object matching the schema, no markdown fences."
)


def _part(kind: str, text: Column, media_type: Column, data: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        text.cast("string").alias("text"),
        media_type.cast("string").alias("media_type"),
        data.cast("string").alias("data"),
    )


def _turn(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def build_requests(
    images: DataFrame, schema_json: str, content: str = "content", failed: str | None = None
) -> DataFrame:
    """Adds ``messages``; where the ``failed`` column holds a bad answer, the retry turns follow.

    The bytes become text in place: they are never carried through a shuffle.
    """
    none = F.lit(None)
    ask = _turn(
        "user",
        _part("image", none, F.lit("image/jpeg"), plain_base64(F.col(content))),
        _part("text", F.lit(PROMPT.format(schema_json=schema_json)), none, none),
    )
    if failed is None:
        return images.withColumn("messages", F.array(ask))
    again = F.array(
        ask,
        _turn("assistant", _part("text", F.col(failed), none, none)),
        _turn("user", _part("text", F.lit(RETRY_PROMPT), none, none)),
    )
    return images.withColumn("messages", F.when(F.col(failed).isNull(), F.array(ask)).otherwise(again))
