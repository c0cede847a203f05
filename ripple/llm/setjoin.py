"""Similarity self-join of word-shingle sets through token-group matrices (operator 10).

The result is exact: two documents are linked when ``den * |A & B| >= num * |A | B|``,
and every link between different sets counts towards the components.

1. Equal sets are one set from here on, named by 128 bits of its hash.
2. *Similar documents are dealt into groups.*  Sets of like size share a number
   of parts p, and each set's tokens are dealt over the parts by hash.  Sets that
   reach the threshold differ in at most d tokens, so with p = d + 1 + spare parts
   at least 1 + spare of them agree; the hash of each part that is not empty is a
   signature.  (Two sets whose agreeing parts are all empty have more empty parts
   than are spare; such sets also have the tokens of their prefixes as signatures,
   of which similar sets share one.)  A bucket of sets that share a signature needs no pairs: a star to its smallest
   set will do, as the components of these stars enclose all links.  Stars are
   made within each task first, so that a signature that many documents share
   costs one row a task.  Where sketches are compared, which are far larger than
   a signature, signatures go alone first, and only those that come more
   than once go again, with the sketches of their sets.  These go in two rounds,
   as similar sets meet in many shards, and each would say the same of them:
   the signatures of the first FIRST parts make components, and by the others
   only sets of different components are compared.
3. *Each group's token union* is a row of the token-group matrix: the members of
   a component stand in the order of their smallest hashes and are cut into groups
   of GROUP sets.  An inverted list over the unions bounds |Q & G| for a query and
   all groups at once; only groups with ``den * |Q & G| >= num * |Q|`` are opened,
   and of those only members not yet connected with the query are intersected.
4. Components of over BLOCK sets are cut into blocks, and each pair of blocks is
   a task of its own; the links they find are connected in turn.

No step gathers an unbounded group: signatures are dealt over shards whose number
follows the number of documents, matrices hold bounded batches of sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ripple.llm.common import Hashes, Sieve, connected_components, lean, lean_group, led, mix, quote, quoted, raw_texts, shuffle_partitions, slices, small_batches, swept, without, written
from ripple.llm.shingles import set_key, shingle_sets

SPARE_SHARE = 0.25  # spare parts at most, of the others
WIDE = 2000
GROUP = 32
BLOCK, BLOCK_TOKENS = 4096, 2_000_000  # sets and tokens of a component that are verified in one task
FLUSH_ROWS = 200_000  # signatures gathered in a task before they are dealt out; up to four times as many where shards are many
FIRST = 8  # parts of a set whose signatures are compared in the first of two rounds
SIG_BYTES = 5  # of a signature that goes to its shard without sketch
SHARD_ROWS = 400_000  # signatures that a shard is meant to hold
BATCH_SETS = 400  # sets of small components whose matrix is made together
CELLS = 256  # of a sketch
ALL, TAKEN = 60, 24  # a sketch has all tokens where at most ALL may differ, else a share of them, of which at most TAKEN are expected to


class Classes:
    """Size classes: for a set size the class, its number of parts, and whether a larger partner can be in the next class."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1]
        #: Whether parts are so small that sets of one bucket have to be told apart by sketches.
        self.sketched = 100 * num < 88 * den

    def at(self, size: int) -> int:
        while self.low[-1] <= size:
            # By the square of den / num, so that a partner is in the same class or the next.
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.den**2 // self.num**2)))
        lo, hi = 0, len(self.low) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.low[mid] <= size else (lo, mid)
        return lo

    def parts(self, c: int) -> tuple[int, int]:
        """(number of parts, how many of them are spare); none where the class admits equal sets only."""
        self.at(self.low[c])
        while len(self.low) < c + 2:
            self.at(self.low[-1])
        d = 2 * (self.low[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        if not d:
            return 0, 0
        spare = 2
        for _ in range(4):  # so many that few sets have as many empty parts
            parts = d + 1 + spare
            empty = parts * math.exp(-self.low[c] / parts)
            spare = 2 + math.ceil(min(empty + 3 * math.sqrt(empty), SPARE_SHARE * (d + 1)))
        return d + 1 + spare, spare

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """The (class, parts, spare) under which a set of this size has signatures."""
        c = self.at(size)
        found = [c]
        if size * self.den >= self.low[c + 1] * self.num:
            found.append(c + 1)
        return [(x, p, e) for x in found for p, e in [self.parts(x)] if p]


def sketches(tokens: np.ndarray, entry: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
    """Parities by cells of those tokens of each entry whose hash is among ``rate`` of 2**32; 4 words an entry."""
    hashed = mix(tokens, 17)
    taken = (hashed & np.uint64(0xFFFFFFFF)) < rate[entry]
    cell = entry[taken] * CELLS + (hashed[taken] >> np.uint64(40) & np.uint64(CELLS - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=CELLS * n).astype(np.uint8).reshape(n, CELLS) & 1, axis=1).view(np.uint64)


def limits(total: np.ndarray, rate: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many cells the sketches of two sets of ``total`` tokens together may differ if these reach the threshold; all where there is no sketch.

    It follows the sizes of the two, not their class, whose largest sets may
    differ in half as many tokens again.
    """
    differ = total * (den - num) // (den + num)
    share = differ * (rate / 2.0**32)
    return np.where(rate == 0, CELLS, np.where(rate < 1 << 32, np.ceil(share + 8 * np.sqrt(share)), differ)).astype(np.int64)


def signatures(sets: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, its entry) of all parts of all sets; and for each entry the index of its set, and 6 words: size, rate, sketch.

    A set has an entry for each class it has signatures under; where too many
    parts are empty these are also the tokens of its prefix, by class as the
    parts are, so that sketches tell these sets apart too.  With sketches a signature's
    last bit tells its round: 0 for the FIRST parts, 1 for the others and prefixes.
    """
    none = np.empty(0, np.int64)
    picked = [(i, c, *pe) for i, x in enumerate(sets) if len(x) for c, *pe in classes.of(len(x))]
    if not picked:
        return np.empty(0, np.uint64), none, none, np.empty((0, 6), np.uint64)
    index, kind, parts, spare = (np.array(x, dtype=np.int64) for x in zip(*picked, strict=True))
    n = len(index)
    sizes = np.array([len(sets[i]) for i in index.tolist()], dtype=np.int64)
    starts = np.cumsum(parts) - parts
    tokens, entry = np.concatenate([sets[i] for i in index.tolist()]), np.repeat(np.arange(n), sizes)
    slot = starts[entry] + (mix(tokens, 11) % parts[entry].astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    low = np.bincount(slot, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(slot, (tokens >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    filled = np.bincount(slot, minlength=total) > 0
    owner = np.repeat(np.arange(n), parts)
    place = np.arange(total, dtype=np.int64) - starts[owner]
    with np.errstate(over="ignore"):
        sig = mix(mix(low, 1) + mix(high, 2) + mix((kind[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64), 3), 4)
    differ = parts - spare - 1  # tokens in which two sets of the class may differ
    facts = np.zeros((n, 6), dtype=np.uint64)
    facts[:, 0] = sizes
    if classes.sketched:
        sig = sig & ~np.uint64(1) | (place >= FIRST).astype(np.uint64)
        facts[:, 1] = np.where(differ <= ALL, 2.0**32, np.ceil(2.0**32 * TAKEN / np.maximum(differ, 1))).astype(np.uint64)
        facts[:, 2:] = sketches(tokens, entry, n, facts[:, 1])
    found, owners = [sig[filled]], [owner[filled]]
    for e in np.flatnonzero(np.bincount(owner[~filled], minlength=n) > spare).tolist():
        tokens, size = sets[index[e]], int(sizes[e])  # tokens are sorted, so the prefix has the first in one order for all sets
        prefix = tokens[: size + (-size * classes.num // classes.den) + 1]
        found.append(mix(mix(prefix, 13) + np.uint64(kind[e]), 4) | np.uint64(classes.sketched))
        owners.append(np.full(len(prefix), e, dtype=np.int64))
    return np.concatenate(found), np.concatenate(owners), index, facts


class Union:
    """Disjoint sets over 0..n-1; the root is the smallest."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each signature its smallest node; and the (node, root) rows that connect all nodes of a signature."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.empty(len(sig), dtype=bool)
    first[:1] = True
    first[1:] = sig[1:] != sig[:-1]
    least = node[np.flatnonzero(first)][np.cumsum(first) - 1]
    a, b = node[node != least], least[node != least]
    both = np.unique(np.stack([a, b]), axis=1)
    return sig[first], node[first], *forest(both[0], both[1])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) rows that connect what the pairs connect."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    links = Union(len(names))
    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        links.join(x, y)
    roots = np.array([links.find(i) for i in range(len(names))], dtype=np.int64)
    moved = roots != np.arange(len(names))
    return names[moved], names[roots[moved]] if len(names) else names


def compared(sig: np.ndarray, entry: np.ndarray, node: np.ndarray, facts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) rows that connect the entries of a signature that sizes and sketches do not tell apart; of a signature of over WIDE entries all.

    An entry of size 0 stands for a star of sets and is connected with all of its signature.
    """
    order = np.lexsort((entry, sig))
    sig, entry = sig[order], entry[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(sig)))
    left, right = [], []
    wide = np.flatnonzero(count > WIDE)
    for f, n in zip(first[wide].tolist(), count[wide].tolist(), strict=True):
        left.append(node[entry[f : f + n]])
        right.append(np.full(n, node[entry[f]]))
    at = np.arange(len(sig)) - np.repeat(first, count)
    room = np.repeat(count, count) - at - 1  # entries of the bucket that follow
    rows = np.flatnonzero((room > 0) & (np.repeat(count, count) <= WIDE))
    size = facts[:, 0].astype(np.int64)
    step = 1
    while len(rows):
        for chunk in np.array_split(rows, max(1, len(rows) // 200_000)):
            x, y = entry[chunk], entry[chunk + step]
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            some = (node[x] != node[y]) & ((low == 0) | (den * low >= num * high))
            x, y = x[some], y[some]
            apart = np.bitwise_count(facts[x, 2:] ^ facts[y, 2:]).sum(axis=1)
            some = apart <= limits(size[x] + size[y], np.minimum(facts[x, 1], facts[y, 1]), num, den)
            pair = np.unique(np.stack([node[x[some]], node[y[some]]]), axis=1)
            left.append(pair[0])
            right.append(pair[1])
        step += 1
        rows = rows[room[rows] >= step]
    return forest(np.concatenate(left), np.concatenate(right)) if left else (node[:0], node[:0])


SIGNED = "id {kind}, text_hash long, n_shingles long, set_key binary, node long, stretch long, shard int, sigs binary, nodes binary, a binary, b binary, who binary, facts binary"
LINKED = "id {kind}, text_hash long, n_shingles long, set_key binary, node long, a long, b long"
MET = "id {kind}, text_hash long, n_shingles long, set_key binary, node long, a long, b long, stretch long, shard int, late boolean, sigs binary, nodes binary, who binary, facts binary, label long"
TOLD = "shard int, sigs binary, nodes binary, who binary, facts binary"


_outside = itertools.count()  # numbers what no task makes


def packed(sig: np.ndarray, entry: np.ndarray) -> tuple[bytes, bytes]:
    """The signatures' last bytes; and their entries, which ascend, as steps, by which byte of four, so that what is zero stands together."""
    steps = np.diff(entry, prepend=0).astype("<u4")
    return sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes(), steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(sigs: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(nodes) // 4
    sig = np.zeros((n, 8), dtype=np.uint8)
    sig[:, :SIG_BYTES] = np.frombuffer(sigs, np.uint8).reshape(n, SIG_BYTES)
    steps = np.ascontiguousarray(np.frombuffer(nodes, np.uint8).reshape(4, n).T)
    return sig.view("<u8").ravel(), np.cumsum(steps.view("<u4").ravel(), dtype=np.int64)


def _signed(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, shards: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: for each document its set, and for each shard the signatures of the sets of many documents.

    With sketches there is a third: for each stretch of documents its entries' nodes and facts.
    """
    words, classes = Hashes(), Classes(num, den)
    context = TaskContext.get()
    stretch, most = (context.partitionId() if context else next(_outside)) << 32, FLUSH_ROWS * min(4, max(1, shards // 1000))
    seen: set[int] = set()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def rows(**columns: list | pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def dealt(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order by shard, and where the shards begin in it."""
        shard = (mix(values.view(np.uint64), 5) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def flush() -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *(len(x[2]) for x in kept)])
        sig, entry = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] + b for x, b in zip(kept, before, strict=False)])
        node, facts = np.concatenate([x[2] for x in kept]), np.concatenate([x[3] for x in kept])
        kept.clear()
        seen.clear()
        a = b = node[:0]
        if classes.sketched:  # what is too wide already is starred here, and sends one entry on
            names, flat, count = np.unique(sig, return_inverse=True, return_counts=True)
            wide = count[flat] > WIDE
            if wide.any():
                _, _, a, b = stars(sig[wide], node[entry[wide]])
                order = np.flatnonzero(wide)[np.argsort(node[entry[wide]], kind="stable")]
                first = order[np.unique(flat[order], return_index=True)[1]]
                # That entry stands for sets it may be unlike, so neither size (0) nor sketch may tell it apart.
                each, local = np.unique(entry[first], return_inverse=True)
                sig, entry = np.concatenate([sig[~wide], sig[first]]), np.concatenate([entry[~wide], len(node) + local])
                node = np.concatenate([node, node[each]])
                facts = np.concatenate([facts, np.zeros((len(each), 6), dtype=np.uint64)])
        else:
            sig, least, a, b = stars(sig, node[entry])
        order, cut = dealt(sig)
        by, at = dealt(a)
        sig, a, b = sig[order], a[by], b[by]
        full = [i for i in range(shards) if cut[i] < cut[i + 1] or at[i] < at[i + 1]]
        columns: dict[str, list] = {"shard": full, "sigs": [sig[cut[i] : cut[i + 1]].tobytes() for i in full]}
        columns |= {c: [x[at[i] : at[i + 1]].tobytes() for i in full] for c, x in (("a", a), ("b", b))}
        if classes.sketched:
            entry = entry[order]
            both = []
            for i in full:
                by = np.argsort(entry[cut[i] : cut[i + 1]], kind="stable") + cut[i]
                both.append(packed(sig[by], entry[by]))
            columns |= {"stretch": [stretch] * len(full), "sigs": [x[0] for x in both], "nodes": [x[1] for x in both]}
            yield rows(stretch=[stretch], shard=[(stretch >> 32) % shards], who=[node.tobytes()], facts=[facts.tobytes()])
        else:
            least = least[order]
            columns["nodes"] = [least[cut[i] : cut[i + 1]].tobytes() for i in full]
        yield rows(**columns)

    for batch in slices(batches, "text"):
        sets = shingle_sets(raw_texts(batch, "text"), k, words)
        keys = [set_key(x) if len(x) else None for x in sets]
        nodes = [int.from_bytes(x[:8], "little", signed=True) if x else None for x in keys]
        yield rows(id=batch.column("id"), text_hash=batch.column("text_hash"), n_shingles=[len(x) for x in sets], set_key=keys, node=nodes, stretch=[stretch] * len(sets), shard=(batch.column("h").to_numpy() % shards).tolist())
        fresh = []
        for i, x in enumerate(nodes):
            if x is not None and x not in seen:
                seen.add(x)
                fresh.append(i)
        sig, entry, index, facts = signatures([sets[i] for i in fresh], classes)
        if len(sig):
            kept.append((sig, entry, np.array([nodes[i] for i in fresh], dtype=np.int64)[index], facts))
        if sum(len(x[0]) for x in kept) >= most:
            yield from flush()
            stretch += 1
    if kept:
        yield from flush()


def _joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _after(known: pa.Table, schema: pa.Schema, **columns: list | np.ndarray) -> pa.Table:
    """Rows of these columns after known ones; what either lacks is null."""
    n = len(next(iter(columns.values())))
    return pa.Table.from_arrays([
        pa.concat_arrays([
            *(known.column(f.name).cast(f.type).chunks if f.name in known.column_names and f.name not in ("a", "b") else [pa.nulls(known.num_rows, f.type)]),
            pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type),
        ]) for f in schema
    ], schema=schema)


def _bucket_links(table: pa.Table, schema: pa.Schema, num: int, den: int) -> pa.Table:
    """The links of one shard, after the documents that came along; with sketches of a shard that has its stretches' facts too."""
    signed = table.filter(pc.is_valid(table.column("sigs")))
    if Classes(num, den).sketched:
        met, told = (to_arrow_schema(_parse_datatype_string(x.format(kind="bigint"))) for x in (MET, TOLD))
        found = _met(table, met.set(0, table.schema[0]))
        parts = [_told(found.filter(pc.and_(pc.equal(found.column("stretch"), s), pc.is_null(found.column("n_shingles")))), told) for s in pc.unique(signed.column("stretch")).to_pylist()]
        links = _sketch_links(pa.concat_tables([told.empty_table(), *parts]), num, den)
        x, y = (links.column(c).to_numpy() for c in ("a", "b"))
    else:
        _, _, x, y = stars(_joined(signed, "sigs", np.uint64), _joined(signed, "nodes", np.int64))
    a, b = forest(np.concatenate([_joined(signed, "a", np.int64), x]), np.concatenate([_joined(signed, "b", np.int64), y]))
    return _after(table.filter(pc.is_valid(table.column("n_shingles"))), schema, a=a, b=b)


def _met(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of one shard the signatures that come more than once, by stretch and round, and the stars, after the other rows that came along."""
    signed = table.filter(pc.is_valid(table.column("sigs")))
    both = [unpacked(x, y) for x, y in zip(signed.column("sigs").to_pylist(), signed.column("nodes").to_pylist(), strict=True)]
    sig = np.concatenate([x[0] for x in both]) if both else np.empty(0, np.uint64)
    _, flat, count = np.unique(sig, return_inverse=True, return_counts=True)
    often = count[flat] > 1
    a, b = forest(_joined(signed, "a", np.int64), _joined(signed, "b", np.int64))
    out: dict[str, list] = {c: [] for c in ("stretch", "shard", "late", "sigs", "nodes")}
    at = 0
    for row, (x, y) in zip(signed.select(["stretch", "shard"]).to_pylist(), both, strict=True):
        for late in (False, True):
            some = often[at : at + len(x)] & (x & np.uint64(1) == late)
            if some.any():
                for c, value in zip(out, (row["stretch"], row["shard"], late, *packed(x[some], y[some])), strict=True):
                    out[c].append(value)
        at += len(x)
    known = _after(table.filter(pc.is_null(table.column("sigs"))), schema, a=a, b=b)
    return pa.concat_tables([known, _after(known.slice(0, 0), schema, **out)])


def _told(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The signatures of one stretch with what is known of their sets, without those of sets that an earlier stretch has.

    Sets that have a label go by it.
    """
    own = table.filter(pc.is_valid(table.column("facts")))
    who, facts = _joined(own, "who", np.int64), _joined(own, "facts", np.uint64).reshape(-1, 6)
    # An entry of size 0 stands for a star, which the earlier stretch need not have.
    unnamed = pc.is_null(table.column("label"))
    mine = ~np.isin(who, table.filter(unnamed).column("node").drop_null().to_numpy()) | (facts[:, 0] == 0)
    named = table.filter(pc.invert(unnamed)).sort_by("node")
    if named.num_rows:
        nodes = named.column("node").to_numpy()
        at = np.minimum(np.searchsorted(nodes, who), len(nodes) - 1)
        who = np.where(nodes[at] == who, named.column("label").to_numpy()[at], who)
    out: dict[str, list] = {f.name: [] for f in schema}
    signed = table.filter(pc.is_valid(table.column("sigs")))
    for row in signed.select(["shard", "sigs", "nodes"]).to_pylist():
        sig, entry = unpacked(row["sigs"], row["nodes"])
        sig, entry = sig[mine[entry]], entry[mine[entry]]
        if len(sig):
            each, local = np.unique(entry, return_inverse=True)
            sigs, nodes = packed(sig, local)
            for c, value in zip(out, (row["shard"], sigs, nodes, who[each].tobytes(), facts[each].tobytes()), strict=True):
                out[c].append(value)
    return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _sketch_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """The links of one shard by signatures, sizes and sketches."""
    both = [unpacked(x, y) for x, y in zip(table.column("sigs").to_pylist(), table.column("nodes").to_pylist(), strict=True)]
    if not both:
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b")})
    before = np.cumsum([0, *(len(x) // 8 for x in table.column("who").to_pylist())])
    sig, entry = np.concatenate([x[0] for x in both]), np.concatenate([x[1] + b for x, b in zip(both, before, strict=False)])
    a, b = compared(sig, entry, _joined(table, "who", np.int64), _joined(table, "facts", np.uint64).reshape(-1, 6), num, den)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sketched(signed: DataFrame, kind: str, n_docs: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(documents' rows, links) of signed rows, by signatures that are shared.

    However many shards similar sets meet in, they have at most as many links as
    the FIRST parts, and no more once these have made them one component.
    """
    met, told = (to_arrow_schema(_parse_datatype_string(x.format(kind=kind))) for x in (MET, TOLD))
    found = written(signed.groupBy("shard").applyInArrow(lean_group(lambda t: _met(t, met)), MET.format(kind=kind)), "met")
    swept(signed.sparkSession)
    each = found.where("n_shingles is not null")
    # Of a set that several stretches have, the first one tells.
    nodes = each.where("node is not null").select("node", "stretch")
    owners = nodes.groupBy("node").agg(F.min("stretch").alias("owner"))
    copies = led(nodes, "node", owners, "owner", n_docs).where("stretch > owner").select("node", "stretch").distinct()
    parts = found.where("sigs is not null or facts is not null").select("node", "stretch", "shard", "late", "sigs", "nodes", "who", "facts", "label").unionByName(copies, allowMissingColumns=True)

    def linked(rows: DataFrame) -> DataFrame:
        sent = rows.drop("late").groupBy("stretch").applyInArrow(lean_group(lambda t: _told(t, told)), TOLD)
        out = written(sent.groupBy("shard").applyInArrow(lean_group(lambda t: _sketch_links(t, num, den)), "a long, b long"), "links")
        del sent
        swept(signed.sparkSession)
        return out

    near = connected_components(linked(parts.where("late is null or not late")).unionByName(found.where("a is not null").select("a", "b")))
    labels = near.join(owners, "node").select("node", F.col("owner").alias("stretch"), F.col("component").alias("label"))
    links = linked(parts.where("late is null or late").unionByName(labels, allowMissingColumns=True))
    return each, links.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b")))


def matrix_links(sets: list[np.ndarray], num: int, den: int) -> Union:
    """Connect the sets that reach the threshold, by a token-group matrix over them."""
    n = len(sets)
    links = Union(n)
    group = np.repeat(np.arange((n + GROUP - 1) // GROUP), GROUP)[:n]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(group, sizes)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]  # the matrix: for each token the groups that hold it
    groups = int(group[-1]) + 1
    for q in range(n):
        query, size = sets[q], int(sizes[q])
        lo, hi = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
        width = hi - lo
        at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        overlap = np.bincount(owner[at], minlength=groups)
        for g in np.flatnonzero(den * overlap >= num * size).tolist():
            for m in range(max(q + 1, g * GROUP), min(n, (g + 1) * GROUP)):
                other = int(sizes[m])
                if den * min(size, other) < num * max(size, other) or links.find(q) == links.find(m):
                    continue
                place = np.minimum(np.searchsorted(sets[m], query), other - 1)
                both = int(np.count_nonzero(sets[m][place] == query))
                if den * both >= num * (size + other - both):
                    links.join(q, m)
    return links


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit words of each binary value, without copies."""
    out: list[np.ndarray] = []
    for x in column.chunks:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].tolist() if len(x) else [0]
        data = x.buffers()[2] if len(x) else None
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        out += [raw[i:j].view(np.uint64) for i, j in zip(ends, ends[1:], strict=False)]
    return out


VERIFIED = "whole boolean, set_key binary, root binary, node long, root_node long"


def _verified(table: pa.Table, num: int, den: int) -> pa.Table:
    """Roots of the verified components among the sets of one task: sets' keys where whole components are here, else nodes."""
    keys, component, whole, node = (table.column(c).to_pylist() for c in ("set_key", "component", "whole", "node"))
    tokens = _arrays(table.column("tokens"))
    first = {key: i for i, key in reversed(list(enumerate(keys)))}
    kept = sorted(first.values(), key=lambda i: (component[i], tokens[i][:4].tolist(), len(tokens[i])))
    out: dict[str, list] = {c: [] for c in ("whole", "set_key", "root", "node", "root_node")}
    start = 0
    while start < len(kept):  # whole components, so many at once that a matrix pays
        end = start
        while end < len(kept) and (end - start < BATCH_SETS or component[kept[end]] == component[kept[end - 1]]):
            end += 1
        part = kept[start:end]
        links = matrix_links([tokens[i] for i in part], num, den)
        for at, i in enumerate(part):
            root = part[links.find(at)]
            for c, value in zip(out, (whole[i], keys[i], keys[root], node[i], node[root]), strict=True):
                out[c].append(value)
        start = end
    kinds = {"whole": pa.bool_(), "set_key": pa.binary(), "root": pa.binary(), "node": pa.int64(), "root_node": pa.int64()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})


def _rooted(docs: DataFrame, key: str, text: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each document: id, text_hash, n_shingles, set_key; for each distinct set: set_key, the root of its component and the component's least id; the number of documents)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A set of n tokens has some 5 n (den - num) / (den + num) signatures, and a token some six bytes of text.
    shards = max(shuffle_partitions(spark), math.ceil(size / 6 * 5 * (den - num) / (den + num) / SHARD_ROWS))
    schema, linked = (to_arrow_schema(_parse_datatype_string(x.format(kind=kind))) for x in (SIGNED, LINKED))
    signed = docs.withColumn("h", F.xxhash64("id")).withColumn("text_hash", F.xxhash64("text")).mapInArrow(lean(lambda it: _signed(it, k, num, den, shards, schema)), SIGNED.format(kind=kind))
    if Classes(num, den).sketched:
        each, links = _sketched(signed, kind, n_docs, num, den)
    else:
        signed = written(signed.groupBy("shard").applyInArrow(lean_group(lambda t: _bucket_links(t, linked, num, den)), LINKED.format(kind=kind)), "signed")
        each, links = signed.where("a is null"), signed.where("a is not null").select("a", "b")
    each = each.select("id", "text_hash", "n_shingles", "set_key", "node")
    del signed
    swept(spark)
    # Nodes are 64 bits of a set's key.  Should two sets share one, their components are verified together, and fall apart there.
    near = connected_components(links)

    # The distinct sets of components, each with the text of one document.
    sets = each.where("set_key is not null").groupBy("set_key", "node").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"))
    members = written(sets.join(near, "node").select("id", "set_key", "node", "component", "n"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("blocks"))
    n_members, n_tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(shuffle_partitions(spark), math.ceil(n_members / 1000), math.ceil(4 * n_tokens / BLOCK_TOKENS))

    # Only members' token sets are shuffled; other documents end at the sieve.
    sieve = spark.sparkContext.broadcast(Sieve(members.select(F.xxhash64("id").alias("h")), "h", n_members))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Hashes()
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(sieve.value.passes(batch.column("h").to_numpy())))
            found = shingle_sets(raw_texts(batch, "text"), k, words)
            kept = pa.array([len(x) > 0 for x in found], pa.bool_())
            columns = [batch.column("id"), pa.array([set_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "key", "tokens"]).filter(kept)

    picked = docs.select(F.xxhash64("id").alias("h"), "id", "text").mapInArrow(lean(tokens), f"at {kind}, key binary, tokens binary")
    sized = members.join(sizes, "component")  # before tokens come along, which else were shuffled once more
    full = picked.join(sized, (F.col("key") == F.col("set_key")) & F.col("at").eqNullSafe(F.col("id"))).select("set_key", "node", "component", "blocks", "tokens")
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(block.cast("int")))))
    full = full.withColumn("block", block.cast("int")).withColumn("other", other).withColumn("whole", F.col("blocks") == 1)
    task = F.when(F.col("whole"), F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    found = full.select(task.alias("task"), "component", "whole", "set_key", "node", "tokens")
    verified = written(found.groupBy("task").applyInArrow(lean_group(lambda t: _verified(t, num, den)), VERIFIED), "verified")
    del picked, full, found
    swept(spark)
    roots = verified.where("whole").select("set_key", "root")
    cut = verified.where("not whole")
    if cut.limit(1).count():
        over = connected_components(cut, "node", "root_node").withColumn("root", F.col("component").cast("string").cast("binary"))
        roots = roots.unionByName(cut.select("set_key", "node").distinct().join(over, "node", "left").select("set_key", F.coalesce("root", F.col("node").cast("string").cast("binary")).alias("root")))

    rooted = written(sets.join(roots, "set_key", "left").select("set_key", "id", F.coalesce("root", "set_key").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return each.drop("node"), led(rooted.drop("id"), "root", least, "component_id", n_docs).select("set_key", F.struct("root", "component_id").alias("of")), n_docs


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of ``num / den`` at least.

    Returns (key, n_shingles, component_id), one row for each input row;
    component_id is the smallest key that links reach.  Texts that are null or
    have no word have no shingles and are linked with nothing: their component
    is their own key.  Rows that repeat, and rows whose key is null, are nodes
    like others (a component of null keys alone is null).  Other columns are not
    read; an empty table gives an empty one.  ``docs`` is read twice and should be
    a table, or written as one before: what tasks send depends on their rows' order.
    """
    each, named, n_docs = _rooted(docs, key, text, k, num, den)
    alone = each.where("set_key is null").select(F.col("id").alias(key), "n_shingles", F.col("id").alias("component_id"))
    return alone.unionByName(led(each, "set_key", named, "of", n_docs).select(F.col("id").alias(key), "n_shingles", F.col("of.component_id").alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group of similar documents one row, with all columns: that of the smallest key.

    Documents are rows, not keys: a row goes if it is similar to one that stays,
    whatever other rows share its key.  Null keys come last.  Among rows of a
    group that share the smallest key, the text of the smallest hash stays, and
    of rows equal in key and text any one.  Rows without words are linked with
    nothing and stay; an empty table gives an empty one.
    """
    each, named, n_docs = _rooted(docs, key, text, k, num, den)
    found = led(each, "set_key", named, "of", n_docs).select("id", "text_hash", "of.root", F.col("id").eqNullSafe(F.col("of.component_id")).alias("first"))
    found = written(found, "found")
    ties = found.where("first").groupBy("root").agg(F.count("*").alias("n"), F.min("text_hash").alias("kept")).where("n > 1")
    ties = written(ties.select("root", "kept"), "ties")
    on = {"id": F.col(quote(key)), "text_hash": F.xxhash64(quote(text))}
    gone = found.where("not first").select("id", "text_hash")
    if not ties.limit(1).count():
        return without(docs, gone, on)
    tied = found.where("first").join(ties, "root")
    gone = gone.unionByName(tied.where("text_hash <> kept").select("id", "text_hash"))
    equal = written(tied.where("text_hash = kept").groupBy("id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("id", "text_hash"), "equal")
    left = without(docs, gone, on)
    if not equal.limit(1).count():
        return left
    # Rows that are equal in key and text: one of each.
    same = equal.select(F.col("id").alias("equal_id"), F.col("text_hash").alias("equal_hash"))
    alike = left.select(F.struct(*quoted(docs.columns)).alias("row"), on["id"].alias("id"), on["text_hash"].alias("text_hash"))
    alike = alike.join(same, F.col("id").eqNullSafe(F.col("equal_id")) & (F.col("text_hash") == F.col("equal_hash")), "left_semi")
    return without(left, equal, on).unionByName(alike.dropDuplicates(["id", "text_hash"]).select("row.*"))


#: The registered query's: three words, 90 of 100.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), both_ AS (
  SELECT s.r AS a, t.r AS b, count(*) AS c FROM s JOIN s AS t ON s.x = t.x AND s.r <> t.r GROUP BY ALL
), link AS (
  SELECT a, b FROM both_ JOIN n AS m ON m.r = a JOIN n AS o ON o.r = b WHERE 100 * c >= 90 * (m.n + o.n - c)
), walk(r, x) AS (
  SELECT r, r FROM d UNION SELECT walk.r, b FROM walk JOIN link ON link.a = walk.x
), least_ AS (
  SELECT walk.r, min(d.doc_id) AS component_id FROM walk JOIN d ON d.r = walk.x GROUP BY walk.r
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN least_ USING (r) LEFT JOIN n USING (r)
"""
