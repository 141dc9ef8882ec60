"""JSON-lines annotations, eval jobs, raw corpora, and the JSON-lines sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.amounts import strip
from ..functions.responses import json_kind
from ..session import written


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, json`` of the non-blank lines in file order.

    Lines, their blocks and places are written in one pass, so the ordinals fit the
    lines whatever splits a later read would choose. The ordinal is the row's place
    in its file block plus the rows of all blocks before it: counts per block, no
    sort and no single-partition pass over rows.
    """
    kept = written(
        spark.read.text(path)
        .select(
            strip(F.col("value")).alias("json"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
        .filter(F.col("json") != "")
        .withColumn("_at", F.monotonically_increasing_id()),
        "lines",
    )
    blocks = kept.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return kept.join(before, ["_file", "_block"]).select(
        (F.col("_before") + F.col("_at") - F.col("_first")).alias("ordinal"), "json"
    )


def _well_formed(json: Column) -> Column:
    """True, or an error; used as a filter, which no pruning of columns can drop."""
    return F.when(json_kind(json).isNotNull(), True).otherwise(
        F.raise_error(F.concat(F.lit("malformed JSON line: "), json)).cast("boolean")
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, json, image_path``; a malformed line fails the job."""
    checked = json_lines(spark, path).filter(_well_formed(F.col("json")))
    return checked.withColumn("image_path", F.get_json_object("json", "$.metadata.image_path"))


def read_eval_jobs(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, image_path, annotation`` (JSON text)."""
    checked = json_lines(spark, path).filter(_well_formed(F.col("json")))
    return checked.select(
        "ordinal",
        F.get_json_object("json", "$.image_path").alias("image_path"),
        F.get_json_object("json", "$.annotation").alias("annotation"),
    )


def _as_text(df: DataFrame, name: str) -> Column:
    """The column as JSON text, whether stored as text or as an object."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    stored = df.schema[name].dataType
    return F.col(name) if isinstance(stored, T.StringType) else F.to_json(name)


def read_raw(
    spark: SparkSession, path: str, fields: tuple[str, ...], text: str, format: str = "parquet"
) -> DataFrame:
    """A raw corpus snapshot with the first present of ``fields`` as ``text``.

    Rows without an image are dropped; the bytes themselves are not read on.
    """
    raw = spark.read.format(format).load(path)
    found = F.coalesce(*[F.nullif(_as_text(raw, f), F.lit("")) for f in fields])
    rows = raw.withColumn(text, found)
    if "image" in raw.columns:
        rows = rows.filter(F.col("image").isNotNull()).drop("image")
    return rows


def read_cord(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_raw(spark, path, ("ground_truth", "gt_parse_str"), "ground_truth", format)


def read_sroie(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return read_raw(spark, path, ("parsed_data",), "parsed_data", format)


def one_line(json: Column) -> Column:
    return F.translate(json, "\r\n", "  ")


def write_json_lines(df: DataFrame, path: str, column: str | None = None) -> None:
    """One object per line, NULL fields kept; raw text columns pass through unchanged."""
    json = (
        F.col(column)
        if column and isinstance(df.schema[column].dataType, T.StringType)
        else F.to_json(column or F.struct("*"), {"ignoreNullFields": "false"})
    )
    df.select(one_line(json).alias("value")).write.text(path)
