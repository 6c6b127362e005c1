"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmend.llm import decontam, exact_dedup, langid, merkle, mixing, ngram_join, phrases, pieces, quality, toxicity, warc
from trackmend.llm._shared import shared_folder, stored, table
from trackmend.llm.token_counts import count_tokens
from trackmend.llm.token_store import read_token_store, write_token_store


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_quality(documents, quality.fit_quality(documents, table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # without payloads the records are small: the archives are parsed once, not for each side of the joins
    captures = warc.assemble(stored(warc.read_warc(spark, path), "records"))
    pages = captures.select(F.col("capture_id").alias("target_id"), F.col("metadata.page").alias("target_page"))
    # responses refer to nothing: they look themselves up, so that no task gets all of them under null
    found = captures.join(pages, F.coalesce(F.col("response.refers_to"), F.col("capture_id")) == F.col("target_id"), "left")
    return found.select(
        F.col("metadata.page").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), F.col("target_page")).alias("refers_to"),
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents"), path)
    return read_token_store(spark, path)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_exact_dedup, op4_quality, op5_language, op6_toxicity, op7_ngram_join, op8_decontamination, op9_warc_captures, op10_token_store, op11_phrases, op12_mixing, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op9_warc_captures": warc.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op12_mixing": mixing.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
