"""A corpus pipeline made of the operators of ``policyflow.llm``: quality, lines, near duplicates, benchmark passages, tokens.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from policyflow.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from policyflow.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model does not reject (score of 0.5 or more)."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=True, into="__score").filter("__score >= 0.5").drop("__score")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks of earlier ones; n_chars follows the text, and a document of which nothing is left goes."""
    cleaned = line_dedup.clean(docs, counts=("__lines", "__removed"))
    left = cleaned.filter((F.col("__removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("__removed") > 0, length).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.representatives(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
