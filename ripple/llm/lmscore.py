"""Cross-entropy difference under matched bigram models (operator 4).

Two bigram models, of a target part of the corpus and of the whole of it, share
one vocabulary, one order and one smoothing (Moore and Lewis, 2010).  A document's
score is the mean over its tokens of the loss under the target model less that
under the background model; the lower, the more it is like the target.

Every word has its own statistics.  The most frequent words, so many as a
parameter says, are known to every task by number and count, a bounded 1.5 MB;
all others, the rare ones, go by 64 bits of hash, and their counts stay in shards.
Tasks send each shard the distinct bigrams of a stretch of documents with their
counts, and for each of these, in the same order, the documents that hold it.  A
bigram that ends in a rare word goes to that word's shard, which so sees all of its
occurrences and can count it; others are dealt by their own hash.  As each rare
word of a text ends one bigram and begins the next, the weight of the context it
is in the next is charged where its count is known, with the bigram it ends.  A
shard's rows are sorted so that all counts come first; it remembers for each stretch
where its bigrams are in the model, the documents then stream past the finished
model, and only sums for each document leave the shard.

The most frequent bigrams would make some shards' tasks long.  A small sample says
which these are; they are counted over all documents together with the words, and
every task charges them itself.  Which bigrams are so treated changes no result.

A loss is the sum of two whole numbers of micro-nats, of the bigram's weight and of
its context's, so that sums are the same in any order and by any route.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import Hashes, lean, mix, quote, raw_texts, shuffle_partitions, slices, small_batches

VOCABULARY = 65_533  # words that have numbers, at most
UNKNOWN, BEGIN, END = 65_533, 65_534, 65_535  # UNKNOWN stands for any rare word
RARE = np.uint64(1 << 63)  # set in the codes of rare words, and in the keys of bigrams that hold one
PRIOR = 50.0  # weight, in tokens, of the unigram model in each bigram context
STRETCH_TOKENS, STRETCH_DOCS = 750_000, 1 << 16  # a stretch's documents are numbered in 16 bits
SHARD_WORDS, SHARD_BIGRAMS = 1_000_000, 500_000  # entries that a shard is meant to hold
SAMPLE_DOCS, HOT_BIGRAMS = 20_000, 4096  # for the choice of the frequent bigrams
NULL_ID = -(1 << 63)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before, 35) ^ after, 36)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _batches(rows: Iterator[list], names: list[str], kinds: list[pa.DataType], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with binary columns as batches of about ``limit`` bytes."""
    kept: list[list] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)

    for row in rows:
        kept.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield batch()
            kept, size = [], 0
    if kept:
        yield batch()


# ------------------------------------------------------------------ words


class Hot:
    """The frequent bigrams, by the hashes of their words."""

    def __init__(self, first: np.ndarray, last: np.ndarray) -> None:
        pair = _pair(first, last)
        order = np.argsort(pair)
        self.pairs, self.first, self.last = pair[order], first[order], last[order]
        self.low = np.zeros(1 << 16, dtype=bool)  # what the last 16 bits of their hashes can be
        self.low[(pair & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of those bigrams that are among these."""
        if not len(self.pairs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair = _pair(before, after)
        some = np.flatnonzero(self.low[(pair & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.pairs, pair[some]), len(self.pairs) - 1)
        same = self.pairs[at] == pair[some]
        return some[same], at[same]


def _inner(split: list[list[bytes]], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before, words after, document) of the bigrams within texts."""
    doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
    within = np.flatnonzero(doc[1:] == doc[:-1])
    return hashes[within], hashes[within + 1], doc[within]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of the sample that a slice holds more often than one in HOT_BIGRAMS."""
    words = Hashes()
    for batch in slices(batches, "text"):
        split = [x.lower().split() for x in raw_texts(batch, "text")]
        before, after, _ = _inner(split, words.of([w for x in split for w in x]))
        pair, at, n = np.unique(_pair(before, after), return_index=True, return_counts=True)
        kept = np.flatnonzero(n > max(1, len(before) // HOT_BIGRAMS))
        columns = [before[at[kept]].view(np.int64), after[at[kept]].view(np.int64), n[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["first", "last", "n"])


COUNTED = "shard long, word binary, n binary, t binary"


def _word_counts(batches: Iterator[pa.RecordBatch], shards: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    """Counts in all and in the target for each shard: of the words, for each stretch; of the frequent bigrams once a task, in shards below 0."""
    words, pending, size = Hashes(), [], 0
    pairs = np.zeros((2, len(hot.pairs)), dtype=np.int64)
    names, kinds = ["shard", "word", "n", "t"], [pa.int64(), *[pa.binary()] * 3]

    def dealt(keys: np.ndarray, n: np.ndarray, t: np.ndarray, shard: np.ndarray) -> Iterator[list]:
        order = np.argsort(shard, kind="stable")
        first = _runs(shard[order])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=False):
            at = order[a:b]
            yield [int(shard[at[0]]), keys[at].tobytes(), n[at].tobytes(), t[at].tobytes()]

    def flush() -> Iterator[list]:
        hashes, target = (np.concatenate([x[i] for x in pending]) for i in (0, 1))
        pending.clear()
        keys, flat = np.unique(hashes, return_inverse=True)
        n, t = np.bincount(flat, minlength=len(keys)).astype(np.int64), np.bincount(flat, target, minlength=len(keys)).astype(np.int64)
        yield from dealt(keys, n, t, (mix(keys, 31) % np.uint64(shards)).astype(np.int64))

    def rows() -> Iterator[list]:
        nonlocal size
        for batch in slices(batches, "text"):
            split = [x.lower().split() for x in raw_texts(batch, "text")]
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = words.of([w for x in split for w in x])
            before, after, doc = _inner(split, hashes)
            place, number = hot.find(before, after)
            pairs[0] += np.bincount(number, minlength=len(hot.pairs))
            pairs[1] += np.bincount(number, target[doc[place]], minlength=len(hot.pairs)).astype(np.int64)
            pending.append((hashes, np.repeat(target, [len(x) for x in split])))
            size += len(hashes)
            if size >= STRETCH_TOKENS:
                yield from flush()
                size = 0
        if size:
            yield from flush()
        some = np.flatnonzero(pairs[0])
        if len(some):
            yield from dealt(hot.pairs[some], pairs[0][some], pairs[1][some], -1 - (mix(hot.pairs[some], 31) % np.uint64(shards)).astype(np.int64))

    yield from _batches(rows(), names, kinds)


def _top_words(table: pa.Table, limit: int) -> pa.Table:
    """The words of a shard that can have numbers, and the shard's totals and number of words in a row without word; of shards below 0 all."""
    word, n, t = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("word", np.uint64), ("n", np.int64), ("t", np.int64)))
    pairs = table.column("shard")[0].as_py() < 0
    order = np.argsort(word, kind="stable")
    first = _runs(word[order])
    word, n, t = word[order][first], np.add.reduceat(n[order], first), np.add.reduceat(t[order], first)
    best = np.arange(len(word)) if pairs else np.lexsort((word.view(np.int64), -n))[:limit]
    return pa.table({
        "kind": pa.array([3 if pairs else 0] * len(best) + [4 if pairs else 1], pa.int32()),
        "word": pa.concat_arrays([pa.array(word[best].view(np.int64)), pa.nulls(1, pa.int64())]),
        "n": np.append(n[best], n.sum()),
        "t": np.append(t[best], t.sum()),
        "d": np.append(np.zeros(len(best), np.int64), len(word)),
    })


class Vocabulary:
    """Sorted hashes of numbered words, most frequent first, and the counts of all numbers in the whole (0) and the target (1)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, documents: np.ndarray, distinct: int = 0) -> None:
        order = np.argsort(words)
        self.words, self.numbers = words[order], order.astype(np.uint64)
        self.counts = np.zeros((2, END + 1), dtype=np.int64)
        self.counts[:, : len(words)] = counts
        self.counts[:, UNKNOWN] = totals - counts.sum(axis=1)
        self.counts[:, BEGIN] = self.counts[:, END] = documents
        #: What can follow a word: the words, END and one that is in no text; as many as there are numbers at least.
        self.types = max(END, distinct + 2)
        #: Frequent bigrams: sorted keys, and their losses under the whole and the target; see ``charge``.
        self.keys, self.charges = np.empty(0, np.uint64), np.empty((2, 0), np.int64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words: numbers, or of rare words their hashes."""
        if not len(self.words):
            return hashes | RARE
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.numbers[at], hashes | RARE)

    def losses(self, model: int, counts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Micro-nats of each bigram that occurs ``counts`` times in the model's texts.

        ``before`` has numbers (UNKNOWN for a rare word), ``after`` codes; all
        bigrams that end in a rare word have to be here.
        """
        own = self.counts[model].astype(np.float64)
        weight = np.round(1e6 * np.log(own + PRIOR))
        weight[UNKNOWN] = 0  # that of a rare word is charged with the bigram it ends
        own[BEGIN] = 0  # all but BEGIN can follow
        total = own.sum() + self.types
        rare = after >= RARE
        seen = own[np.where(rare, 0, after).astype(np.int64)]
        _, flat = np.unique(after[rare], return_inverse=True)
        seen[rare] = np.bincount(flat, counts[rare])[flat] if rare.any() else 0
        out = weight[before.astype(np.int64)] - np.round(1e6 * np.log(counts + PRIOR * ((seen + 1) / total)))
        out[rare] += np.round(1e6 * np.log(seen[rare] + PRIOR))
        return out.astype(np.int64)

    def charge(self, first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> None:
        """Let every task know the losses of these bigrams (of hashes, with counts in all and in the target); those with a rare word are passed over."""
        before, after = self.of(first), self.of(last)
        known = np.flatnonzero((before < RARE) & (after < RARE))
        key = before[known] << np.uint64(16) | after[known]
        order = np.argsort(key)
        known = known[order]
        self.keys = key[order]
        self.charges = np.stack([self.losses(m, counts[m][known], before[known], after[known]) for m in (0, 1)])

    def charged(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are those of frequent bigrams, the numbers of these)."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        return same, at[same]


class Numbers(dict):
    """Word to its code, remembered."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 60_000) -> None:
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        new = [w for w in set(words) if w not in self]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        self.update(zip(new, self.vocabulary.of(hashes).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


# ---------------------------------------------------------------- bigrams

FIELDS = ["c1", "c2", "c3", "c4", "c5", "c6"]
STREAM = "shard long, kind int, stretch long, " + ", ".join(f"{c} binary" for c in FIELDS)


def _keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.where((before | after) >= RARE, _pair(before, after) | RARE, before << np.uint64(16) | after)


class Stretch:
    """Documents whose bigrams are dealt out together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []  # keys, words before, words after, documents, times
        self.heads: list[tuple[np.ndarray, ...]] = []  # ids, numbers of words, whether target, losses of frequent bigrams under the whole and the target
        self.tokens = self.docs = 0

    def add(self, batch: pa.RecordBatch, vocabulary: Vocabulary, numbers: Numbers) -> None:
        split = [x.lower().split() for x in raw_texts(batch, "text")]
        count = np.array([len(x) for x in split], dtype=np.int64)
        flat = numbers.of([w for x in split for w in x])
        full = np.flatnonzero(count)  # texts without words have no tokens at all
        # Each text with words becomes BEGIN, its words, END.
        ends = np.cumsum(count[full] + 2)
        tokens, doc = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64), np.repeat(full, count[full] + 2)
        inner = np.ones(len(tokens), dtype=bool)
        inner[ends - 1] = inner[ends - count[full] - 2] = False
        tokens[inner], tokens[ends - 1], tokens[ends - count[full] - 2] = flat, END, BEGIN
        within = doc[1:] == doc[:-1]
        before, after, doc = tokens[:-1][within], tokens[1:][within], doc[:-1][within]
        key = _keys(before, after)
        hot, number = vocabulary.charged(key)
        sums = [np.bincount(doc[hot], x[number], minlength=len(split)).astype(np.int64) for x in vocabulary.charges]
        left = np.flatnonzero(~hot)
        left = left[np.lexsort((key[left], doc[left]))]
        key, doc = key[left], doc[left]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else left
        at = left[first]
        self.parts.append((key[first], before[at], after[at], doc[first] + self.docs, np.diff(np.append(first, len(key)))))
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(np.int64)
        self.heads.append((batch.column("id").fill_null(NULL_ID).to_numpy(), count, target, *sums))
        self.tokens, self.docs = self.tokens + len(tokens), self.docs + len(split)

    def rows(self, name: int, shards: int) -> Iterator[list]:
        """For each shard the bigrams with their counts (kind 0) and their documents (kind 1); the documents (kind 2)."""
        ids, count, target, whole, own = (np.concatenate([x[i] for x in self.heads]) for i in range(5))
        yield [name % shards, 2, name, ids.tobytes(), _packed(count), _packed(whole), _packed(own), None, None]
        key, before, after, owner, time = (np.concatenate([x[i] for x in self.parts]) for i in range(5))
        self.parts.clear()
        if not len(key):
            return
        dealt = (mix(np.where(after >= RARE, after, key), 33) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((key, dealt))
        key, owner, time = key[order], owner[order], time[order]
        first = _runs(key)
        n, t = np.add.reduceat(time, first), np.add.reduceat(time * target[owner], first)
        span = np.diff(np.append(first, len(key)))
        before, after, dealt = (x[order[first]] for x in (before, after, dealt))
        rare = [np.concatenate([[0], np.cumsum(x >= RARE)]) for x in (before, after)]
        hashes = [x[x >= RARE] for x in (before, after)]
        short = [np.where(x >= RARE, UNKNOWN, x).astype(np.uint16) for x in (before, after)]
        cut = np.searchsorted(dealt, np.arange(shards + 1))
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            a, b = int(cut[i]), int(cut[i + 1])
            c, d = int(first[a]), int(first[b]) if b < len(first) else len(key)
            yield [i, 0, name, *(x[a:b].tobytes() for x in short), *(h[r[a] : r[b]].tobytes() for h, r in zip(hashes, rare, strict=True)), _packed(n[a:b]), _packed(t[a:b])]
            yield [i, 1, name, _packed(span[a:b]), owner[c:d].astype(np.uint16).tobytes(), _packed(time[c:d]), None, None, None]


def _bigrams(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: int) -> Iterator[pa.RecordBatch]:
    """The rows of all stretches of a task."""
    numbers, task = Numbers(vocabulary), TaskContext.get().partitionId()

    def rows() -> Iterator[list]:
        stretch, nth = Stretch(), 0
        for batch in slices(batches, "text", rows=min(8192, STRETCH_DOCS)):
            if stretch.docs + batch.num_rows > STRETCH_DOCS or stretch.tokens >= STRETCH_TOKENS:
                yield from stretch.rows((task << 32) + nth, shards)
                stretch, nth = Stretch(), nth + 1
            stretch.add(batch, vocabulary, numbers)
        if stretch.docs:
            yield from stretch.rows((task << 32) + nth, shards)

    yield from _batches(rows(), ["shard", "kind", "stretch", *FIELDS], [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6])


class Shard:
    """The bigrams of one shard: first counts by stretch, then the finished model."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.names: list[int] = []
        self.losses: list[np.ndarray] | None = None

    def count(self, stretch: int, columns: list[bytes]) -> None:
        before, after = (np.frombuffer(x, np.uint16).astype(np.uint64) for x in columns[:2])
        for x, hashes in ((before, columns[2]), (after, columns[3])):
            x[x == UNKNOWN] = np.frombuffer(hashes, np.uint64)
        short = np.frombuffer(columns[0], np.uint16)
        self.parts.append((_keys(before, after), short, after, _unpacked(columns[4]), _unpacked(columns[5])))
        self.names.append(stretch)

    def finish(self, vocabulary: Vocabulary) -> None:
        ends = np.cumsum([len(p[0]) for p in self.parts]).tolist()
        key, first, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        #: For each stretch, where its bigrams are in the model.
        self.at = {s: at[a:b] for s, a, b in zip(self.names, [0, *ends[:-1]], ends, strict=True)}
        before, after = (np.concatenate([p[i] for p in self.parts])[first] for i in (1, 2))
        counts = [np.bincount(at, np.concatenate([p[i] for p in self.parts]), minlength=len(key)) for i in (3, 4)]
        self.parts.clear()
        self.losses = [vocabulary.losses(m, counts[m], before, after) for m in (0, 1)]

    def sums(self, stretch: int, columns: list[bytes]) -> list[bytes]:
        """Documents of the stretch with the sums of their losses here."""
        each = np.repeat(self.at.pop(stretch), _unpacked(columns[0]))
        doc, times = np.frombuffer(columns[1], np.uint16), _unpacked(columns[2]).astype(np.float64)
        sums = [np.bincount(doc, x[each] * times).astype(np.int64) for x in self.losses]  # exact: far below 2**53
        some = np.unique(doc)
        return [some.tobytes(), *(x[some].tobytes() for x in sums)]


SUMS = "stretch long, kind int, c1 binary, c2 binary, c3 binary, c4 binary"


def _scored(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Sums of losses for the documents of each stretch, from rows sorted by shard and kind."""

    def rows() -> Iterator[list]:
        at, shard = None, Shard()
        for batch in batches:
            for here, kind, stretch, *columns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if here != at:
                    at, shard = here, Shard()
                if kind == 0:
                    shard.count(stretch, columns)
                elif kind == 1:
                    if shard.losses is None:
                        shard.finish(vocabulary)
                    yield [stretch, 1, *shard.sums(stretch, columns), None]
                else:
                    yield [stretch, 0, *columns[:4]]

    yield from _batches(rows(), ["stretch", "kind", *FIELDS[:4]], [pa.int64(), pa.int32(), *[pa.binary()] * 4])


def _summed(table: pa.Table) -> pa.Table:
    """The documents of one stretch with their sums."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", *FIELDS[:4])), strict=True))
    _, ids, count, *sums = next(r for r in rows if r[0] == 0)
    ids, sums = np.frombuffer(ids, np.int64), [_unpacked(x).astype(np.int64) for x in sums]
    for kind, docs, *more, _ in rows:
        if kind == 1:
            at = np.frombuffer(docs, np.uint16)
            for x, y in zip(sums, more, strict=True):
                x[at] += np.frombuffer(y, np.int64)
    return pa.table({"id": pa.array(ids, mask=ids == NULL_ID), "n_tokens": _unpacked(count).astype(np.int64), "t": sums[1], "b": sums[0]})


def cross_entropy_difference(docs: DataFrame, target: Column, key: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """Score each document by bigram models of the rows where ``target`` holds and of all rows.

    Returns (key, n_tokens, target_loss, background_loss, ce_difference), one row
    for each input row; losses are nats a token, the end of the text included.
    Words are the runs without ASCII white space, A-Z lower-cased.  Null texts,
    and texts without words, have no tokens, are in no model and score 0; a null
    target is false; keys are whole numbers or null; repeated rows count each.
    An empty target leaves its model uniform; an empty table gives an empty one.
    Other columns are not read.  ``vocabulary`` is how many words have numbers
    (65,533 at most and unless given); it changes no result, only what is sent.
    ``docs`` is read four times and should be a table, or written as one before:
    what tasks send depends on their rows' order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    limit = min(VOCABULARY if vocabulary is None else vocabulary, UNKNOWN)
    plain = docs.select(F.col(quote(key)).cast("long").alias("id"), F.col(quote(text)).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    filled = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n_docs, full, own, size = plain.agg(F.count("*"), F.count_if(filled), F.count_if(filled & F.col("target")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Which bigrams are frequent.
    some = plain.where(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0)
    often = some.select("text").mapInArrow(lean(_frequent), "first long, last long, n long").groupBy("first", "last").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "first", "last").limit(HOT_BIGRAMS).toArrow()
    hot = Hot(*(often.column(c).to_numpy().view(np.uint64) for c in ("first", "last")))

    shards = max(shuffle_partitions(spark), math.ceil(n_docs * 200 / SHARD_WORDS))
    shared_hot = spark.sparkContext.broadcast(hot)
    counted = plain.select("text", "target").mapInArrow(lean(lambda it: _word_counts(it, shards, shared_hot.value)), COUNTED)
    tops = counted.groupBy("shard").applyInArrow(lambda t: _top_words(t, limit), "kind int, word long, n long, t long, d long")
    # One job: the numbered words are bounded by ``limit`` and the frequent bigrams by HOT_BIGRAMS; totals are a row a shard, summed at once.
    # Words are ranked in one task, so rarer ones are left out: a word has two bytes with its space, so 128 for each number can pass at most.
    ranked = tops.where("kind = 0").where(F.col("n") >= size // (256 * VOCABULARY)).orderBy(F.desc("n"), "word").limit(limit)
    others = tops.where("kind = 1").groupBy("kind").agg(F.lit(None).cast("long").alias("word"), *[F.sum(c).alias(c) for c in ("n", "t", "d")])
    got = ranked.unionByName(tops.where("kind = 3")).unionByName(others).toArrow().to_pylist()
    words = sorted((r for r in got if r["kind"] == 0), key=lambda r: (-r["n"], r["word"]))
    sums = next((r for r in got if r["kind"] == 1), {"n": 0, "t": 0, "d": 0})
    known = Vocabulary(
        np.array([r["word"] for r in words], dtype=np.int64).view(np.uint64), np.array([[r[c] for r in words] for c in ("n", "t")], dtype=np.int64).reshape(2, -1),
        np.array([sums["n"], sums["t"]]), np.array([full, own]), sums["d"],
    )
    pairs = {r["word"]: (r["n"], r["t"]) for r in got if r["kind"] == 3}
    known.charge(hot.first, hot.last, np.array([pairs.get(p, (0, 0)) for p in hot.pairs.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 2).T)

    shared = spark.sparkContext.broadcast(known)
    shards = max(shuffle_partitions(spark), math.ceil((sums["n"] + full) / SHARD_BIGRAMS))
    stream = plain.mapInArrow(lean(lambda it: _bigrams(it, shared.value, shards)), STREAM)
    stream = stream.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "kind")
    done = stream.mapInArrow(lean(lambda it: _scored(it, shared.value)), SUMS).groupBy("stretch").applyInArrow(_summed, "id long, n_tokens long, t long, b long")
    tokens = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1)
    mean = lambda x: F.coalesce(x / (tokens * 1e6), F.lit(0.0))
    return done.select(
        F.col("id").alias(key), "n_tokens", mean(F.col("t")).alias("target_loss"), mean(F.col("b")).alias("background_loss"), mean(F.col("t") - F.col("b")).alias("ce_difference")
    )


#: The registered query's, target being the rows of lang = 'en'.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang = 'en', FALSE) AS target,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, target, list_concat(list_concat([' b'], w), [' e']) AS w FROM d WHERE len(w) > 0
), p AS (
  SELECT r, target, w[i] AS a, w[i + 1] AS b FROM (SELECT r, target, w, unnest(generate_series(1, len(w) - 1)) AS i FROM s)
), bi AS (
  SELECT a, b, count(*) AS n0, count(*) FILTER (WHERE target) AS n1 FROM p GROUP BY a, b
), uni AS (
  SELECT b AS x, count(*) AS n0, count(*) FILTER (WHERE target) AS n1 FROM p GROUP BY b
  UNION ALL SELECT ' b', count(*), count(*) FILTER (WHERE target) FROM s
), total AS (
  SELECT sum(n0) + greatest(65535, count(*) + 1) AS t0, sum(n1) + greatest(65535, count(*) + 1) AS t1 FROM uni WHERE x <> ' b'
), loss AS (
  SELECT bi.a, bi.b, round(1e6 * ln(f.n0 + 50.0::DOUBLE)) - round(1e6 * ln(bi.n0 + 50.0::DOUBLE * ((l.n0 + 1) / CAST(t0 AS DOUBLE)))) AS l0,
         round(1e6 * ln(f.n1 + 50.0::DOUBLE)) - round(1e6 * ln(bi.n1 + 50.0::DOUBLE * ((l.n1 + 1) / CAST(t1 AS DOUBLE)))) AS l1
  FROM bi JOIN uni f ON f.x = bi.a JOIN uni l ON l.x = bi.b, total
), sums AS (
  SELECT r, CAST(sum(l0) AS BIGINT) AS l0, CAST(sum(l1) AS BIGINT) AS l1 FROM p JOIN loss ON p.a = loss.a AND p.b = loss.b GROUP BY r
)
SELECT doc_id, len(w) AS n_tokens, coalesce(l1 / ((len(w) + 1) * 1e6::DOUBLE), 0) AS target_loss, coalesce(l0 / ((len(w) + 1) * 1e6::DOUBLE), 0) AS background_loss,
       coalesce((l1 - l0) / ((len(w) + 1) * 1e6::DOUBLE), 0) AS ce_difference
FROM d LEFT JOIN sums USING (r)
"""
