"""Training-data pipeline: quality, toxicity, line dedup, near-dedup and packing, each over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelf.llm import common, line_dedup, minhash, packing, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality.accepted(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that don't score as toxic by a lexicon learned on the labelled ones among them."""
    return toxicity.accepted(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller doc_id has; text and n_chars follow."""
    return line_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return minhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("lines", line_stage), ("near", near_stage), ("packing", packing_stage)]
#: Classifiers and tokens can't be had from SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, read by the next and then deleted, but
    for what the last reads."""
    docs, before = common.documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        at = common.shared_folder(spark)
        docs = common.written(stage(spark, docs, sf_dir), at)
        if before:
            common.discard(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
