"""A corpus from documents to training windows: quality, repeated lines, near duplicates, test items, packing.

All stages take an empty table (and give one), and carry other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope import ship
from filingscope.llm.common import drop_table, write_table  # noqa: F401  (write_table: for those who run stages one by one)
from filingscope.llm.decontamination import without_leaks
from filingscope.llm.jaccard_join import keep_one
from filingscope.llm.line_dedup import MADE, dedupe_lines
from filingscope.llm.packing import pack
from filingscope.llm.quality_classifier import accepted, fit_quality
from filingscope.tables import write_alone


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of the stage's own documents.

    Each row is judged by its text; null and empty texts have the score of the bias. Without labels all
    scores are 0.5 and all rows stay. Rows that repeat, or share an id, are judged alike or each by itself.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, fit_quality(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that are later copies as a whole go.

    Null texts, and texts without a worded line, stay. Of rows with one id any counts as the first copy.
    """
    ship(spark)
    names = {c: f"{c} of docs" if c in MADE else c for c in docs.columns}
    left = dedupe_lines(docs.toDF(*names.values())).filter("n_deleted = 0 or n_deleted < n_lines")
    return left.select(*[F.col(f"`{new}`").alias(c) for c, new in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group that 0.8 of the five-word shingles links.

    Decisions are by row: of rows with one id and different texts each is judged by its own text, rows
    without an id come after those with one, and texts without a word stay.
    """
    ship(spark)
    return keep_one(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item. Rows are told apart by id and text, so rows without an id go too if they hold one."""
    ship(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    ship(spark)
    return pack(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", leaks), ("packing", windows)]

#: SQL has no n-gram classifier, tokenizer or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass. Each stage's input, and what it wrote on its way, goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, write_alone(lambda: stage(spark, docs, sf_dir), name, spark)  # noqa: B023
        if i:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
