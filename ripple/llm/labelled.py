"""What the classifiers share: folds by document, bounded samples of labelled rows, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ripple.llm.common import quote, written

FOLDS = 5
#: A classifier is fitted on so many labelled rows at most, those with the smallest hashes of their ids, and on so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20


def held_out(key: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text leaves 0 modulo FOLDS; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, text, label, and ``more`` of the documents) of labelled documents outside the held-out fold.

    The sample is the same for any partitioning: at most ``rows`` documents, in the
    order of their ids' hashes, until their texts exceed ``size`` bytes.  Rows
    without id or label are not used; a label above 0 counts as 1, others as 0; of
    an id with several labels, the largest; an id's documents are all its rows, equal
    ones once.
    """
    known = labels.select(F.col(quote(key)).alias("at"), (F.col(quote(label)) > 0).cast("int").alias("label")).where(F.col("at").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("at")))
    known = known.groupBy("at").agg(F.max("label").alias("label")).orderBy(F.xxhash64("at"), "at").limit(rows)
    plain = docs.select(F.col(quote(key)).alias("id"), F.coalesce(quote(text), F.lit("")).alias("text"), *[x.alias(c) for c, x in (more or {}).items()])
    # Which of them are within the bounds is found without their texts; the window sees ``rows`` rows at most.
    order = [F.xxhash64("id"), F.col("id"), F.col("text_hash")]
    few = plain.join(F.broadcast(known), F.col("id") == F.col("at")).groupBy("id", F.xxhash64("text").alias("text_hash")).agg(F.max("label").alias("label"), F.max(F.octet_length("text")).alias("n"))
    few = few.orderBy(*order).limit(rows).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    few = written(few.where(F.col("before") <= size).select(F.col("id").alias("at"), F.col("text_hash").alias("of"), "label"), "chosen")
    found = plain.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(few), (F.col("id") == F.col("at")) & (F.col("text_hash") == F.col("of")))
    return written(found.dropDuplicates(["id", "text_hash"]).select("id", "text", "label", *(more or {})), "labelled")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
