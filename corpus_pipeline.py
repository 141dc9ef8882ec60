"""From raw documents to packed sequences: languages, near copies, test passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroll.llm import contamination, jaccard, langid, packing, pii
from tallyroll.llm.tables import unused
from tallyroll.session import ship_package, written

LEAST_SHARE = 0.4  # of a text's words in its main language; a text in two languages stays
KEY = "corpus-2025"
CAPACITY = 2048


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or without a language of at least two fifths of the words, go; so do null and empty ones.

    Repeated rows are judged alike, an empty table stays empty, other columns stay as they are.
    """
    ship_package(spark)
    model = langid.train(langid.training_rows(docs))
    return langid.keep_known(docs, model, LEAST_SHARE)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8: the document of least id of each group stays.

    Of repeated rows one stays, also of null and empty texts, which are near to nothing.
    """
    ship_package(spark)
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def without_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts and items have none.

    Documents of one id are judged by their own texts; columns of any name stay.
    """
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.find_contamination(docs, items, slop=0).filter("contaminated")
    same_id, key = (unused(docs.columns, c) for c in ("id", "key"))
    leaks = written(found.select(F.col("doc_id").alias(same_id), F.col("key").alias(key)).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(same_id)) & (contamination.text_key() == F.col(key))
    return docs.join(leaks, same, "left_anti")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get keyed surrogates; n_chars follows the new text, and stays where it is null."""
    changed = pii.pseudonymise(docs, KEY).select(*docs.columns)
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 words and the sequence each goes to; null and empty texts as `pack_documents` says."""
    ship_package(spark)
    return packing.pack_documents(docs, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near copies", one_of_near_copies),
    ("test passages", without_test_passages),
    ("personal data", surrogates),
    ("packing", packed),
]

#: No SQL can express the stages (model, keyed hashes, best fit); tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
