"""Corpus pipeline over documents: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. What a stage leaves out is gone for those after it.

Rows are judged as rows: where a doc_id repeats with different texts, each goes or stays by its own text. Null and empty
texts fail the quality rules; repeated rows leave one at the near-duplicates. Ties: the smallest doc_id, then the first row,
stands for a group. Texts are taken whole. Columns of any other name are kept to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import common, decontaminate, mixing, near_dup, repetition, token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return repetition.quality_rules(docs).where("kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of texts that share 0.8 of their five-word shingles."""
    return near_dup.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose sources, languages and topics have their target weights."""
    return mixing.mixed(docs).where("sampled").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document as read back from the token files."""
    return token_files.token_index(token_files.read_tokens(spark, token_files.write_tokens(docs)))


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("decontamination", clean), ("mixing", mix), ("token files", tokens)]

#: Suffix arrays, SimHash components and tokenizers are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
