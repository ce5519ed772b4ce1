"""The stages of the corpus pipeline: each takes the documents that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.exact_dedup import without_copies
from inkfold.llm.jaccard_join import one_of_each
from inkfold.llm.language import in_known_language
from inkfold.llm.packing import best_fit_packing
from inkfold.llm.secret_scan import redacted
from inkfold.session import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model has learned."""
    return in_known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the least id."""
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least id."""
    return one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or piece of one, in a sequence."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

# A learned classifier and best-fit packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
