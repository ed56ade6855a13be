"""A training-data pipeline over documents: toxicity, exact and near deduplication, source mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.bpe import default_tokenizer, encode_digests
from threadloom.llm.common import documents, saved
from threadloom.llm.exact import drop_copies
from threadloom.llm.mixing import MAX_REPEATS, mix_sources
from threadloom.llm.neardup import drop_near_copies
from threadloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null and empty texts stay.

    Repeated rows go or stay together; other columns, also of clashing names, are passed on; an empty table stays empty.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays.

    Null counts as an empty text; a null doc_id loses to any other; of rows with equal doc_id and text one stays, any of them if
    their other columns differ; other columns are passed on; an empty table stays empty.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, a similarity of 0.8 or more) the one with the smallest doc_id stays.

    Null and empty texts and null doc_ids are linked with nothing and stay; rows that share a doc_id stay or go together;
    other columns are passed on; an empty table stays empty.
    """
    return drop_near_copies(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come again, up to MAX_REPEATS times, as their budgets ask.

    Null sources are one source; null and empty texts weigh nothing and are used in each whole pass; rows that share a doc_id
    are used alike; other columns are passed on, but for pass and block; an empty table stays empty.
    """
    return mix_sources(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row that training will see.

    Null counts as an empty text, which has no tokens; repeated rows are each encoded; other columns are left out; an
    empty table gives an empty result.
    """
    return encode_digests(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("bpe", bpe)]

#: The learned scores of the first stage cannot be written as SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
