"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from ripple.sources.shared import drop, settled, written

#: Text and rows handled at once by a Python worker; they bound its memory whatever the batch size.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 8192
#: Bytes of the Arrow batches that Spark sends to Python workers, where the session does not say.
BATCH_BYTES = "4m"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, unless it does so itself: 10,000 rows of text can be of any size."""
    if spark.conf.get(BATCH_CONF, "1b") == "1b":  # a value that nobody sets
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fields(**columns: DataType | str) -> StructType:
    """A schema of nullable columns, given by their types or names of types."""
    return StructType([StructField(c, _parse_datatype_string(t) if isinstance(t, str) else t) for c, t in columns.items()])


def quote(name: str) -> str:
    """A column's name, which may hold dots and backticks, as expressions take it."""
    return "`" + name.replace("`", "``") + "`"


def quoted(names: list[str]) -> list[Column]:
    return [F.col(quote(c)) for c in names]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least) and at most so many rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(size, base + limit, "right"))))
            yield batch.slice(start, end - start)
            start = end


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


class Hashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything past ``limit`` words."""

    def __init__(self, limit: int = 60_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes of an array from which the C library gives it back to the system when it is freed.
HELD = 4 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], held: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map over record batches, after which its worker gives free memory back.

    Workers outlive their tasks; what their allocators keep would count against
    the executor in all later stages.  Arrays of fewer than ``held`` bytes may be
    kept until then.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(held)
        yield from run(batches)
        trim()

    return whole


def give_back(held: int = HELD) -> None:
    """Have the C library return arrays of so many bytes to the system as soon as they are freed.

    Left alone it keeps ever more of them, as its thresholds follow the largest it has seen.
    """
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, held)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, held)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Give memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean_group(run: Callable[[pa.Table], pa.Table], least: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """The same map over groups, after which its worker gives free memory back if the group was of so many bytes."""

    def whole(table: pa.Table) -> pa.Table:
        give_back()
        size = table.nbytes
        out = run(table)
        del table
        if size >= least:
            trim()
        return out

    return whole


def swept(spark: SparkSession) -> None:
    """Have shuffle files that nothing reads any more deleted now; they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over an array; another function for each salt."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * M1
        x = (x ^ (x >> np.uint64(30))) * M2
        return x ^ (x >> np.uint64(27))


#: Keys that a join treats as hot at most; each holds this share of the rows at least, so there cannot be more.
HOT_KEYS = 50_000


def led(rows: DataFrame, key: str, to: DataFrame, value: str, n_rows: int) -> DataFrame:
    """``rows`` (about ``n_rows``) with ``value`` of the row of ``to`` (key, value; a key once) that has their key, null where there is none.

    A left join whose hot keys - at most HOT_KEYS, by their share of the rows -
    are met where they are, so that no task gets all rows of one key.  Rows
    without key are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    hot = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > max(1000, n_rows // HOT_KEYS)).select("k")
    hot = written(hot.join(to.select(F.col(key).alias("k2"), F.col(value).alias(value)), F.col("k") == F.col("k2"), "left").select("k", value), "hot")
    if not hot.limit(1).count():
        return rows.join(to.select(key, value), key, "left")
    few = rows.join(F.broadcast(hot.select("k")), rows[key] == F.col("k"), "left_anti").join(to.select(key, value), key, "left")
    return rows.join(F.broadcast(hot), rows[key] == F.col("k")).select(*quoted(rows.columns), value).unionByName(few)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Components of an undirected graph given as rows of two long columns.

    Returns (node, component), component being the smallest node reachable.
    Large-star and small-star steps alternate until nothing changes (Kiveris et
    al., 2014): each row points to ever smaller nodes, rows never outnumber the
    input, and each round's rows are written to the shared folder, so neither a
    lost executor nor many rounds lengthen the lineage; the round before is
    deleted.  A node without a smaller neighbour is its own least one and meets
    no row, and the rows of a node with a large share of them are not dealt to
    one task.  Edges with nulls are ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    last, n = None, pairs.count()
    while True:
        # Large-star: every larger neighbour of a node is linked to the node's smallest neighbour, or else to the node.
        least = pairs.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = written(led(pairs, "b", least, "m", n).select("a", F.coalesce("m", "b").alias("b")).distinct(), "cc")
        # Small-star: every smaller neighbour of a node, and the node, are linked to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = led(large, "a", least, "m", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        drop(large)
        drop(pairs)
        pairs = after
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = now[0]
        if now == last:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        last = now


class Sieve:
    """A Bloom filter over 64-bit hashes, of a size that never exceeds MAX_BITS.

    It only lessens what a later exact join has to shuffle: hashes that are in
    it always pass, others mostly do not; where a table outgrows it, all pass.
    The bits are put together by an aggregation, so the driver receives at most
    MAX_BITS / 64 words (16 MB) whatever the number of rows.
    """

    MAX_BITS = 1 << 27
    PROBES = 2

    def __init__(self, hashes: DataFrame, column: str, rows: int) -> None:
        bits = 1 << 10
        while bits < min(self.MAX_BITS, 16 * rows):
            bits *= 2
        self.bits = bits

        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(self._at(batch.column(0).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

        found = hashes.select(F.col(column).cast("long")).mapInArrow(spots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.words = np.zeros(bits // 64, dtype=np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)

    def _at(self, hashes: np.ndarray) -> list[np.ndarray]:
        return [(mix(hashes.astype(np.int64).view(np.uint64), 21 + i) % np.uint64(self.bits)).astype(np.int64) for i in range(self.PROBES)]

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in self._at(hashes):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def without(docs: DataFrame, gone: DataFrame, on: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` for which ``gone`` has no row with the same values; null equals null.

    ``on`` gives, for each column of ``gone``, the expression over ``docs`` that it
    is compared with.  Rows that a bounded Bloom filter tells from all of ``gone``
    pass as they are; only the others are shuffled for the exact anti-join.
    """
    spark = docs.sparkSession
    gone = written(gone.select(*on).distinct(), "gone")
    n = gone.count()
    if not n:
        return docs
    sieve = spark.sparkContext.broadcast(Sieve(gone.select(F.xxhash64(*on).alias("h")), "h", n))
    wide = docs.select(F.xxhash64(*on.values()).alias("h"), F.struct(*[x.alias(c) for c, x in on.items()]).alias("on"), F.struct(*quoted(docs.columns)).alias("row"))
    kinds = fields(on=wide.schema["on"].dataType, row=wide.schema["row"].dataType)

    def sifted(batches: Iterator[pa.RecordBatch], through: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = sieve.value.passes(batch.column("h").to_numpy(zero_copy_only=False))
            yield batch.select(["on", "row"]).filter(pa.array(mask if through else ~mask))

    clear = wide.mapInArrow(lean(lambda it: sifted(it, False)), kinds).select("row")
    doubtful = wide.mapInArrow(lean(lambda it: sifted(it, True)), kinds)
    gone = gone.select(*[F.col(c).alias(f"gone_{i}") for i, c in enumerate(on)])
    same = [F.col(f"on.{c}").eqNullSafe(F.col(f"gone_{i}")) for i, c in enumerate(on)]
    left = doubtful.join(gone, functools.reduce(lambda a, b: a & b, same), "left_anti").select("row")
    return clear.unionByName(left).select("row.*")
