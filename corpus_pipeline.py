"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
further columns of any name, as its docstring says; an empty docs gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beliefmill.llm import decontaminate, jaccard, mixing, quality, tokens
from beliefmill.llm.common import staged
from beliefmill.llm.queries import public_tokenizer, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't in the resampled corpus go.

    Null and empty texts have a log ratio of 0 and stay or go by the threshold; null ids draw their
    noise by text; rows that tie with the last one of the sample stay; repeated rows share their fate.
    Without usable labels all rows stay.
    """
    return quality.keep_sampled(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Texts without words are near nothing and stay; of rows that repeat id and text one stays; rows of
    one id with unlike texts are documents of their own; null ids lose to any other id of their group.
    """
    return jaccard.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, as operator 5's query finds them.

    Null and empty texts leak nothing and stay; repeated rows go together; null ids are judged like
    others; items without words never leak.
    """
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"), inside=True, distinct=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 2 times.

    Texts without words have size 0; a null source is a source of its own, the last; documents of equal
    keys are taken together, so repeated rows share their fate; null ids draw their key by text.
    """
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they say of each document: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; null ids come first, and equal ids by their texts' hash,
    so repeated rows stand side by side; an empty mix gives no rows.
    """
    return tokens.read_tokens(spark, tokens.write_tokens(docs, public_tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: SQL expresses neither the hashed models nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None
