"""From raw documents to token files: each stage is one operator of ``terraload.llm``.

A stage takes the documents that the one before it left, and returns documents with the same
columns; the last one writes token files and returns what a reader finds in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraload.llm import language
from terraload.llm.catalog import register, table
from terraload.llm.decontaminate import without_contamination
from terraload.llm.mixing import mixed_documents
from terraload.llm.neardup import one_of_each
from terraload.llm.queries import fold, vocabulary
from terraload.llm.scratch import Scratch
from terraload.llm.token_files import token_digests

#: A document goes if no language has at least this share of its score.
LEAST_SCORE = 0.5

#: The language model and the tokenizer are outside of SQL; the stages are tested against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts in no language that the labelled ones show, go."""
    return language.identified(docs, language.train(docs.where(fold(5) != 0)), LEAST_SCORE)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, until each source has its share."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the token files."""
    return token_digests(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", single),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("token_ids", tokens),
]


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        done = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = done
    return docs
