"""Documents to training text in five stages, each of which works on what the one before it kept.

quality classifier -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> SentencePiece ids

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
they are called.  Null texts count as empty.  Of rows repeated under one key one stays.  Rows with a null key are judged by
their texts and dropped only as bad or as exact copies.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmend.llm import decontam, exact_dedup, ngram_join, pieces, quality
from trackmend.llm._shared import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, with the columns of ``docs``."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect."""
    return ngram_join.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, ids, reads_back) of each document that is left."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]

#: The fitted classifier and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
