"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Quality classifier (rejected documents go), line de-duplication (repeated lines go, and documents left without text),
MinHash near-duplicates (one document of each group stays), mixing to target weights (documents leave or are repeated),
byte-level BPE (one row of token counts and digests for each row of the mix).  Each stage works on everything the stage
before it kept; learning and thresholds use the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import bpe, linededup, minhash, mixing, pulearn
from flowlens.llm.common import clear_scratch, scratch_mark, shipped, table, written


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pulearn.accepted(docs, table(spark, sf_dir, "labels"))


@shipped
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.cleaned(docs, linededup.WORD_EDITS)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


@shipped
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


@shipped
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Learned scores and token merges are not SQL; tests hold each stage but the first against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is a written table, and what a stage wrote on the way to it
    is deleted when it stands."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_scratch(spark, mark, docs)
    return docs


QUERIES = {"pipeline": run}
