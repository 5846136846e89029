"""The corpus pipeline: quality rules, SimHash near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next stage's docs.  All but the last give the columns of documents; further columns of docs are left
out there, whatever their names.

Defined results of all stages: a null text counts as an empty one and stays null; null and repeated ids
and repeated rows are rows like any others, each decided for itself (near_dedup keeps one of equal rows);
texts of any length are handled whole; an empty table gives an empty one.  Each operator's docstring says
how ties go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import op1_quality, op2_pii, op4_mixing, op7_packing, op10_simhash
from linkloom.llm.tables import read, stage

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; a null or empty text has too few words."""
    return op1_quality.keep(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (null last), of each component of near-duplicates."""
    return op10_simhash.keep_one(docs).select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced; n_chars is that of the new text, null where it is null."""
    return op2_pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them; the null source is a source."""
    return op4_mixing.mixed(docs).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every copy of every row, with their ids; a null text has one token."""
    return op7_packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The fitted trees of the PII stage can't be told in SQL; tests/llm/test_pipeline.py holds each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for documents."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
