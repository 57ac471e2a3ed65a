"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next.

The stage `simhash_near_dedup` brings texts together by SimHash fingerprints and decides by whole sets: near copies are texts of
five-word Jaccard similarity 0.8 or more. Fingerprints can't promise to find all of them, so prefixes find the rest (README). Ids are whole numbers, or texts of such; another id is an error.

Null and empty texts have no words, so the quality rules reject them. Of rows that repeat an id and a text one stays, rows
that share an id only are documents of their own, and rows without an id are never duplicates. Ties go to the least id.
Other columns pass as they are, whatever they are called; the last stage drops the text and gives n_tokens, ids and
token_bytes, in place of columns of these names. Empty tables give an empty result. Very long texts are worked on alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm import bpe, decontamination, near_copies, pii, quality_rules
from tillage.llm.shared import new_folder, remove_folder, scratch, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, found by SimHash and then by prefixes, stays: the one with the least id."""
    return near_copies.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars, where there is such a column, follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts become ids, with the byte length of each token to decode them by."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", personal_data),
    ("byte_bpe", encode),
]

#: The near-duplicate, PII and BPE stages go beyond SQL; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir. What a stage writes goes once the next is written; the last
    stage reads the one before it when its result is read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(f"pipeline-{name}"):
            path = new_folder(spark, f"pipeline-{name}")
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
