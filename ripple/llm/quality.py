"""Quality by a factorisation machine over hashed words and structure statistics (operator 9).

Each word has a weight and a short vector, by hash; so has each statistic of the
text's structure.  All pairs of features interact through the product of their
vectors, and the sum over pairs is had in linear time as half of (the square of
the sum less the sum of the squares).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import Hashes, fields, lean, quote, raw_texts, slices, small_batches
from ripple.llm.labelled import SAMPLE_BYTES, SAMPLE_ROWS, held_out, sigmoid, training_rows

BUCKETS = 1 << 15
RANK = 8
EPOCHS, BATCH, RATE, RIDGE = 6, 64, 0.08, 1e-5
STATS = 20


def _stats(raw: bytes, words: list[bytes], counts: np.ndarray, n_chars: int | None) -> list[float]:
    """Statistics of structure; ``counts`` are those of the distinct words, ``n_chars`` is metadata that came with the text."""
    if not raw:
        return [0.0] * STATS
    n, n_words = len(raw), max(1, len(words))
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    lines = raw.split(b"\n")
    distinct = len(set(lines))
    return [
        math.log1p(n),
        math.log1p(n_words),
        n / n_words,
        upper / n,
        digit / n,
        marks / n,
        int(by[128:].sum()) / n,
        int(by[124]) / n_words,  # bars
        int(by[35] + by[36] + by[37] + by[38] + by[42]) / n_words,
        int(by[33]) / n_words,
        int(by[46] + by[44]) / n_words,
        int(by[60] + by[62] + by[123] + by[125]) / n_words,
        upper / max(1, upper + lower),
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        1 - distinct / len(lines),
        len(counts) / n_words,
        float(counts.max()) / n_words if len(counts) else 0.0,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        math.log1p(abs((n_chars or 0) - n) / n),
    ]


def features(batch: pa.RecordBatch, words: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, values, statistics) of a batch with columns text and n_chars."""
    buckets, values, sizes, stats = [], [], [], []
    for raw, n_chars in zip(raw_texts(batch, "text"), batch.column("n_chars").to_pylist(), strict=True):
        split = raw.split()
        at, count = np.unique(words.of(split) & np.uint64(BUCKETS - 1), return_counts=True)
        value = np.log1p(count.astype(np.float32))
        buckets.append(at.astype(np.int32))
        values.append(value / max(1e-9, float(np.sqrt((value * value).sum()))))
        sizes.append(len(at))
        stats.append(_stats(raw, split, count, n_chars))
    ends = np.cumsum(sizes)
    return ends - sizes, np.concatenate(buckets), np.concatenate(values).astype(np.float32), np.array(stats, dtype=np.float32)


class Machine:
    """A factorisation machine; the last STATS features are the statistics, scaled."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, bias: float) -> None:
        rng = np.random.default_rng(7)
        self.mean, self.spread, self.bias = mean, spread, bias
        self.weights = np.zeros(BUCKETS + STATS, dtype=np.float32)
        self.vectors = rng.normal(0, 0.02, (BUCKETS + STATS, RANK)).astype(np.float32)

    def joined(self, starts: np.ndarray, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each entry, feature, value): words and statistics together, by row."""
        n = len(starts)
        rows = np.repeat(np.arange(n), np.diff(np.append(starts, len(at))))
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / math.sqrt(STATS)
        rows = np.concatenate([rows, np.repeat(np.arange(n), STATS)])
        order = np.argsort(rows, kind="stable")
        at = np.concatenate([at, np.tile(np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32), n)])
        return rows[order], at[order], np.concatenate([value, scaled.astype(np.float32).ravel()])[order]

    def margins(self, rows: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, each entry's value times its vector, the sums of these by row)."""
        starts = np.searchsorted(rows, np.arange(n))
        scaled = self.vectors[at] * value[:, None]
        sums = np.add.reduceat(scaled, starts)
        linear = np.add.reduceat(self.weights[at] * value, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, starts)).sum(axis=1)
        return self.bias + linear + pairs, scaled, sums

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """Adagrad over shuffled batches of (buckets, values, statistics)."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full_like(self.weights, 1e-4), np.full_like(self.vectors, 1e-4), 1e-4
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for start in range(0, len(order), BATCH):
                pick = order[start : start + BATCH].tolist()
                sizes = [len(docs[i][0]) for i in pick]
                rows, at, value = self.joined(np.cumsum(sizes) - sizes, np.concatenate([docs[i][0] for i in pick]), np.concatenate([docs[i][1] for i in pick]), np.stack([docs[i][2] for i in pick]))
                margin, scaled, sums = self.margins(rows, at, value, len(pick))
                error = ((sigmoid(margin) - y[pick]) / len(pick)).astype(np.float32)
                by = np.argsort(at, kind="stable")
                at, rows, value = at[by], rows[by], value[by]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ids = at[first]
                pull = (error[rows] * value)[:, None]
                dw = np.add.reduceat(pull[:, 0], first) + RIDGE * self.weights[ids]
                dv = np.add.reduceat(pull * (sums[rows] - scaled[by]), first) + RIDGE * self.vectors[ids]
                db = float(error.sum())
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                gb += db * db
                self.weights[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.vectors[ids] -= RATE * dv / np.sqrt(gv[ids])
                self.bias -= RATE * db / math.sqrt(gb)

    def score(self, starts: np.ndarray, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        rows, at, value = self.joined(starts, at, value, stats)
        return sigmoid(self.margins(rows, at, value, len(starts))[0].astype(np.float64))


def _counted(docs: DataFrame, text: str, n_chars: str | None) -> Column:
    """The metadata column with a text's length; where it is null or missing the text is counted."""
    known = F.col(quote(n_chars)).cast("long") if n_chars and n_chars in docs.columns else F.lit(None).cast("long")
    return F.coalesce(known, F.char_length(quote(text)).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Machine:
    """A machine fitted on a bounded sample of labelled documents outside the held-out fold.

    Features of ``size`` bytes of text come to the driver, some four times as many bytes at most.
    """
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, key, text, rows, size, {"n_chars": _counted(docs, text, n_chars)}).select("text", "n_chars", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for batch in slices(batches, "text"):
            starts, at, value, stats = features(batch, words)
            ends = np.append(starts[1:], len(at)).tolist()
            cut = list(zip(starts.tolist(), ends, strict=True))
            columns = [pa.array([at[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary()), batch.column("label")]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "value", "stats", "label"])

    got = sample.mapInArrow(lean(run), "at binary, value binary, stats binary, label int").toArrow().to_pylist()
    got.sort(key=lambda r: (r["stats"], r["at"], r["label"]))  # the same order for any partitioning
    docs_ = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), np.frombuffer(r["stats"], np.float32)) for r in got]
    y = np.array([r["label"] for r in got], dtype=np.float32)
    stats = np.stack([d[2] for d in docs_]) if docs_ else np.zeros((1, STATS), np.float32)
    mean = float(y.mean()) if len(y) else 0.5
    machine = Machine(stats.mean(axis=0), stats.std(axis=0) + np.float32(1e-3), math.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if docs_:
        machine.fit(docs_, y)
    return machine


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for each document.

    ``score`` is 0 to 1, higher where label 1 is likelier; null and empty texts
    have no words and zero statistics, and the score of such texts.  Repeated
    rows have equal scores; where ``n_chars`` is null or missing the text is
    counted; other columns are not read; an empty table gives an empty one.  Without
    labelled rows every score is that of an unfitted machine.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", key, text, n_chars))
    plain = docs.select(F.col(quote(key)).alias("id"), F.col(quote(text)).alias("text"), _counted(docs, text, n_chars).alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for batch in slices(batches, "text"):
            p = machine.value.score(*features(batch, words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    done = plain.mapInArrow(lean(run), fields(id=plain.schema["id"].dataType, score="double", predicted="int"))
    return done.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", "predicted")
