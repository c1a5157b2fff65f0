"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all that the one before it kept; all but the last return the columns of ``documents``. A stage removes
the scratch tables of the stage before, whose result has been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelkite.llm import chunk_dedup, line_rules, ordinal, packing, simhash
from labelkite.llm.common import dropped, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and documents that lose too much or fail as a whole."""
    return _counted(line_rules.clean(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a low tail probability go. The model is fitted on the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.train(docs, ordinal.graded(labels))
    return ordinal.score(docs, model).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    with scratch(spark, "pipeline"):
        return simhash.near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood before are cut; a document of which nothing is left goes."""
    with scratch(spark, "pipeline"):
        cut = chunk_dedup.dedup(docs).filter((F.col("words_cut") == 0) | (F.col("text") != ""))
    return _counted(cut.select(*docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of tokens."""
    with scratch(spark, "pipeline"):
        return packing.pack_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: tokenizing, chunking and the trained classifier can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
