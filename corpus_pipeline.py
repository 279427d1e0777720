"""The corpus pipeline: what stays of documents, and its tokens.

Each stage reads the table that the one before it wrote. The first four return the columns of
documents; the last returns ids.

Defined cases, for every stage: a null text counts as empty; texts of any length are taken whole;
an empty table gives an empty one; other columns, whatever their names, stay as they are and are
never read. Rows that share a doc_id and differ in text are judged apart; rows that repeat both are
all kept or all dropped. A null doc_id takes part, and loses to any other in its group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusmill.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, quality
from locusmill.llm.scratch import saved


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled ones among them.

    Without labels of both classes it rejects by their share alone: nothing where there is none.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.drop_rejected(docs, machine)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id; empty texts are one group."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the document with the smallest doc_id.

    Texts without words are in no group and stay; of several texts of a group under that doc_id one stays.
    """
    return near_dedup.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item, or a whole item of fewer words. Texts without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the text decoded from them, one row for each row; an empty text has no ids."""
    return byte_bpe.summary(byte_bpe.round_trip(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level bpe", encode_tokens),
]

#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
