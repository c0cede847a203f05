"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm import audio, chat, licenses, linededup, lmscore, pieces, quality, setjoin, toxicity, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as mu-law audio, read back, with features and its sound as 16-bit PCM at 16 kHz."""
    return audio.read(audio.store(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", pcm=True)


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have 90 % in common."""
    return setjoin.similar_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


ORACLES["op10_ngram_jaccard_join"] = setjoin.ORACLE


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that 5 documents share go, except in the last of them."""
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLES["op2_line_dedup"] = linededup.ORACLE


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document that repeats 8-word windows of benchmark items."""
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_benchmark_decontamination"] = winnow.ORACLE


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document, by a lexicon learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document, by a factorisation machine fitted outside the held-out fold."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better each document fits a model of the English part than a model of all."""
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), F.col("lang") == "en")


ORACLES["op4_lm_cross_entropy"] = lmscore.ORACLE


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's own ids, and four segmentations sampled without replacement, with the check that all decode to it."""
    return pieces.encode(table(spark, sf_dir, "documents"), k=4)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices that documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


ORACLES["op3_license_scan"] = licenses.ORACLE


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, logged as events, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(chat.fold(chat.log(rows.unionByName(probe)))))


ORACLES["op5_chat_formatting"] = chat.ORACLE
