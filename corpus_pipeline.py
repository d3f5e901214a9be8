"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Quality rules, language ID and the n-gram Jaccard join drop documents, mixing repeats or drops them, and the last stage
encodes what stays. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import language, mixing, near_duplicates, pieces, quality
from veilspark.llm.common import materialized, table
from veilspark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are removed; documents that the rules reject go."""
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the stage's own labelled rows; documents whose language it rejects go."""
    return language.keep_known(docs, language.fit(docs))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays."""
    return near_duplicates.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped so that the sources meet their targets."""
    return mixing.mix(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicate_join", near_duplicate_join),
    ("source_mixing", source_mixing),
    ("sentence_pieces", sentence_pieces),
]

#: A trained classifier and MinHash stand between input and result: no SQL says the same. ``tests/llm/test_pipeline.py`` holds a run in
#: plain Python, stage after stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
