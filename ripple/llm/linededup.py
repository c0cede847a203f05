"""Dropping lines that many documents share (operator 2).

Lines are keyed by 128 bits of their stripped, lower-cased bytes.  The distinct
keys that reach ``min_docs`` documents are dealt over shards; each shard is a
minimal perfect hash that numbers its keys, with arrays by that number: a 64-bit
fingerprint, the count of documents, and the largest document id.  Documents
never meet lines in a join: their keys, packed by shard into a few rows of bytes
for each stretch of the table, probe the shard's arrays, and the fingerprint
turns away keys that the shard does not hold.  A shard's arrays come first in its
rows and are held while the probes stream past.

Counts are summed within stretches before they are shuffled, so that a line of
a third of all documents costs one row a stretch.  Keys that hold more than one
in HOT_KEYS of all probes, so at most that many, make a shard of their own that is
sent to every task: their probes are answered where they are and never shuffled.
A Bloom filter of bounded size spares most of the other probes that would miss.
Documents that lose none but hot lines, or none, are not shuffled either.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm import perfecthash
from ripple.llm.common import Sieve, drop, fields, lean, quote, quoted, raw_texts, shuffle_partitions, slices, small_batches, written

SPACE = b" \t\n\v\f\r"
SHARD_KEYS = 500_000
HOT_KEYS = 20_000
STRETCH_BYTES = 4 << 20
NULL_ID = -(1 << 63)  # stands for a null id in packed arrays; sorts first


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line's key, or none for a short key."""
    if len(line) < min_chars:
        return None
    line = line.strip(SPACE).lower()
    if len(line) < min_chars or not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def _stretches(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """For each stretch of documents one row: ids and keys of all long lines, a key once for each document."""
    for batch in slices(batches, "text", STRETCH_BYTES):
        ids, keys = [], []
        for id_, text in zip(batch.column("id").to_pylist(), raw_texts(batch, "text"), strict=True):
            found = {x for line in text.split(b"\n") if (x := _key(line, min_chars)) is not None} if len(text) >= min_chars else ()
            keys += found
            ids += [NULL_ID if id_ is None else id_] * len(found)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([b"".join(keys)], pa.binary())], names=["ids", "keys"])


def _unpacked(ids: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    return np.frombuffer(ids, np.int64), both[:, 0], both[:, 1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch its distinct keys, with the count of documents and the largest id."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, lo, hi = _unpacked(row["ids"], row["keys"])
            order = np.lexsort((ids, hi, lo))
            ids, lo, hi = ids[order], lo[order], hi[order]
            last = np.flatnonzero(np.append((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True))
            columns = [lo[last].view(np.int64), hi[last].view(np.int64), np.diff(last, prepend=-1), ids[last]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["lo", "hi", "n", "top"])


class Index:
    """The arrays of one shard: a minimal perfect hash, and by its numbers the fingerprints, counts and largest ids."""

    def __init__(self, sizes: list[int], levels: np.ndarray, prints: np.ndarray, counts: np.ndarray, tops: np.ndarray) -> None:
        self.sizes, self.levels, self.prints, self.counts, self.tops = sizes, levels, prints, counts, tops

    @classmethod
    def over(cls, table: pa.Table) -> Index:
        lo, hi = (table.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi"))
        sizes, levels = perfecthash.build(lo, hi)
        order = np.argsort(perfecthash.lookup(sizes, levels, lo, hi))
        return cls(sizes, levels, hi[order], *(table.column(c).to_numpy()[order] for c in ("n", "top")))

    def packed(self) -> list[bytes]:
        return [np.array(self.sizes, dtype=np.int64).tobytes(), *(x.tobytes() for x in (self.levels, self.prints, self.counts, self.tops))]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Index:
        kinds = (np.uint8, np.uint64, np.int64, np.int64)
        return cls(np.frombuffer(parts[0], np.int64).tolist(), *(np.frombuffer(x, k) for x, k in zip(parts[1:], kinds, strict=True)))

    def found(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for keys that are not here."""
        if not self.sizes:
            return np.full(len(lo), -1, dtype=np.int64)
        at = perfecthash.lookup(self.sizes, self.levels, lo, hi)
        at[(at >= 0) & (self.prints[at] != hi)] = -1
        return at

    def dropped(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each document loses the line."""
        at = self.found(lo, hi)
        return (at >= 0) & (self.counts[at] >= min_docs) & (self.tops[at] != ids) if len(self.counts) else at >= 0


ARRAYS = ["sizes", "levels", "prints", "counts", "tops"]
#: Rows of a shard: its arrays (kind 0), then the probes of stretches (kind 1).
PROBES = "shard long, kind int, " + ", ".join(f"{x} binary" for x in ARRAYS)


def _index(table: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    packed = Index.over(table).packed()
    return pa.table({"shard": table.column("shard")[:1], "kind": pa.array([0], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in zip(ARRAYS, packed, strict=True)}})


def _dealt(batches: Iterator[pa.RecordBatch], shards: int, hot: Index, sieve: Sieve) -> Iterator[pa.RecordBatch]:
    """The probes of stretches by shard, without those of hot keys and those that the filter tells from all shards'."""
    for batch in batches:
        for packed in zip(batch.column("ids").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            ids, lo, hi = _unpacked(*packed)
            kept = np.flatnonzero(sieve.passes(lo.view(np.int64)))
            kept = kept[hot.found(lo[kept], hi[kept]) < 0]
            ids, lo, hi = ids[kept], lo[kept], hi[kept]
            shard = lo.view(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            ids, keys = ids[order], np.ascontiguousarray(np.stack([lo, hi], 1)[order])
            full = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            columns = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for x in (ids, keys)]
            none = pa.nulls(len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([1] * len(full), pa.int32()), *columns, none, none, none], names=["shard", "kind", *ARRAYS])


def _probed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """(id, key) of the lines to drop, from rows sorted by shard and kind."""
    shard, index = None, None
    for batch in batches:
        for at, kind, *packed in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", *ARRAYS)), strict=True):
            if kind == 0:
                shard, index = at, Index.unpacked(packed)
            elif index is not None and at == shard:
                ids, lo, hi = _unpacked(packed[0], packed[1])
                drop_ = np.flatnonzero(index.dropped(ids, lo, hi, min_docs))
                keys = np.stack([lo, hi], 1)[drop_]
                yield pa.RecordBatch.from_arrays([pa.array(ids[drop_], pa.int64()), pa.array([x.tobytes() for x in keys], pa.binary())], names=["id", "line"])


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, Index]:
    """The lines to drop: (id, lines), lines being the 128-bit keys that document ``id`` loses; and the shard of the hot keys, which are not among them."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(quote(key)).cast("long").alias("id"), F.col(quote(text)).alias("text"))
    stretches = written(plain.mapInArrow(lean(lambda it: _stretches(it, min_chars)), "ids binary, keys binary"), "stretches")
    counted = stretches.mapInArrow(lean(_counted), "lo long, hi long, n long, top long")
    common = written(counted.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= min_docs), "common")
    probes = stretches.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 8
    # Fewer than HOT_KEYS keys can have so many documents each.
    often = F.col("n") > probes // HOT_KEYS
    hot = Index.over(common.where(often).toArrow())
    rare = common.where(~often)
    n_rare = rare.count()
    shards = max(shuffle_partitions(spark), math.ceil(n_rare / SHARD_KEYS))
    index = rare.withColumn("shard", F.pmod("lo", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(_index, PROBES)
    shared = spark.sparkContext.broadcast((hot, Sieve(rare.select("lo"), "lo", n_rare)))
    dealt = stretches.mapInArrow(lean(lambda it: _dealt(it, shards, *shared.value)), PROBES)
    stream = index.unionByName(dealt).repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "kind")
    dropped = stream.mapInArrow(lean(lambda it: _probed(it, min_docs)), "id long, line binary")
    lines = written(dropped.groupBy("id").agg(F.collect_set("line").alias("lines")), "lines")
    drop(stretches)
    return lines.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))), hot


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop the lines that at least ``min_docs`` documents share, except in the document with the largest key.

    Returns all columns of ``docs`` with the remaining lines in ``text``, and
    ``n_lines`` (before) and ``n_dropped``.  A line's key is the line without
    white space at its ends, A-Z lower-cased; shorter keys than ``min_chars``
    code points are left alone.  A null or empty text is one empty line and
    becomes an empty text.  Each input row is a document: repeated rows count
    each, and all rows of the largest key keep their lines; a null key sorts
    before all others.  Keys are whole numbers.  Columns named n_lines and
    n_dropped are replaced; an empty table gives an empty one.
    """
    spark, names = docs.sparkSession, docs.columns
    others = [c for c in names if c not in (text, "n_lines", "n_dropped")]
    lines, hot = shared_lines(docs, key, text, min_chars, min_docs)
    sieve = Sieve(lines.select(F.xxhash64("id").alias("h")), "h", lines.count())
    shared = spark.sparkContext.broadcast((sieve, hot))
    wide = docs.select(F.struct(*quoted(others)).alias("row"), F.col(quote(key)).cast("long").alias("id"), F.col(quote(text)).alias("text"))
    wide = wide.withColumn("h", F.xxhash64("id"))
    row = wide.schema["row"].dataType
    done = fields(row=row, text="string", n_lines="long", n_dropped="long")

    def cut(batch: pa.RecordBatch, lost: list[list[bytes] | None]) -> pa.RecordBatch:
        """The batch's texts without the lines whose keys are given, and without hot ones."""
        raws, ids = raw_texts(batch, "text"), batch.column("id").fill_null(NULL_ID).to_numpy()
        keys = [[_key(x, min_chars) for x in raw.split(b"\n")] if len(raw) >= min_chars else () for raw in raws]
        owner = np.repeat(np.arange(len(raws)), [sum(k is not None for k in x) for x in keys])
        both = np.frombuffer(b"".join(k for x in keys for k in x if k is not None), np.uint64).reshape(-1, 2).T.copy()
        hot = iter(shared.value[1].dropped(ids[owner], both[0], both[1], min_docs).tolist())
        texts, before, gone = [], [], []
        for raw, mine, drop in zip(raws, keys, lost, strict=True):
            drop = set(drop or ())
            out = [k is not None and (next(hot) or k in drop) for k in mine]
            n = sum(out)
            texts.append(b"\n".join(x for x, o in zip(raw.split(b"\n"), out, strict=True) if not o) if n else raw)
            before.append(len(mine) or raw.count(b"\n") + 1)
            gone.append(n)
        columns = [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_dropped"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(~shared.value[0].passes(batch.column("h").to_numpy())))
            yield cut(batch, [None] * batch.num_rows)

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[0].passes(batch.column("h").to_numpy()))).select(["row", "id", "text"])

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield cut(batch, batch.column("lines").to_pylist())

    clear = wide.mapInArrow(lean(passing), done)
    met = wide.mapInArrow(lean(losing), fields(row=row, id="long", text="string"))
    met = met.join(lines.select(F.col("id").alias("at"), "lines"), F.col("id").eqNullSafe(F.col("at")), "left").mapInArrow(lean(lost), done)
    back = [F.col("text").alias(text) if c == text else F.col("row." + quote(c)).alias(c) for c in names if c in others or c == text]
    return clear.unionByName(met).select(*back, "n_lines", "n_dropped")


def digest(texts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by the lowercase hex SHA-256 of its UTF-8 bytes."""
    return texts.withColumn("kept_sha256", F.sha2(F.col(text).cast("binary"), 256)).drop(text)


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (
  SELECT k, max(doc_id) AS top FROM (SELECT DISTINCT r, doc_id, k FROM lines WHERE length(k) >= 40) GROUP BY k HAVING count(*) >= 5
), marked AS (
  SELECT l.*, c.k IS NOT NULL AND c.top <> l.doc_id AS gone FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
