"""A corpus pipeline over ``documents`` that chains five of the training-data operators.

Each stage works on all that its predecessor kept, is written as Parquet in the
shared folder and read again; all but the last return the columns of documents.
What a stage wrote on its way is deleted when the stage is written itself, and its
input with it.

Documents are rows: nulls, repeated keys and further columns pass through every
stage, which drops a row for its own text only; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm import linededup, pieces, setjoin, toxicity, winnow
from ripple.llm.common import drop, quoted, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (operator 6)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(*quoted(docs.columns))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share go, except in the last of them (operator 2)."""
    done = linededup.dedup_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 (operator 10)."""
    return setjoin.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of any benchmark item go (operator 8)."""
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as ids, with two sampled segmentations (operator 1)."""
    return pieces.encode(docs, slice_bytes=1 << 19, keep=15_000, carry=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        drop(before)  # the stage before is read no more
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learned classifier and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
