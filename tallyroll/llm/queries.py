"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, fim, jaccard, langid, merkle, packing, pii, quality, sharding, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op5_url_templates": urls.SQL, "op7_decontamination": contamination.SQL,
                       "op8_jaccard_join": jaccard.SQL, "op11_merkle_manifest": merkle.SQL, "op13_fill_in_middle": fim.SQL}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    found = langid.label_languages(docs, model)
    return found.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "spans")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record, and its metadata and conversion records."""
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return derived.select(F.col("source_id").cast("long").alias("page_id"), *derived.columns[1:])


@query
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 24)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact windows, which SQL can tell; with ``slop`` the operator also lists proximity matches."""
    found = contamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=0)
    return found.drop("near_items", "key")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents")).drop("th", "keep")


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="corpus-2025")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = quality.fit(quality.training_sample(docs, table(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, ensemble)
    return scored.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against texts of which a third is shown in lower case."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = merkle.leaf(*fields, F.col("text"))
    shown = F.when(langid.fold("doc_id", 3) == 0, merkle.leaf(*fields, lower))
    proofs = merkle.prove(docs.select("doc_id", "lang", told.alias("leaf"), shown.alias("shown")))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("shown", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, space_starts=True)
    return bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
