"""SentencePiece encoding and decoding, with sampled segmentations (operator 1).

``encode`` gives the tokenizer's own ids for each text and checks that they decode
to it.  Besides, it draws k distinct segmentations of the whole text without
replacement, by Gumbel top-k: the pieces of the vocabulary that fit a text form a
lattice, whose paths have the product of their pieces' weights, and the k paths
whose log weights, each perturbed by a Gumbel variable of its own, are largest are
a sample without replacement (Kool et al., 2019).

The search over the exponentially many paths is A* on perturbed bounds (Maddison
et al., 2014).  A region is a set of paths: those that begin with given pieces and
go on with any but certain pieces.  Its mass is known in closed form, so its
largest perturbed value can be drawn without looking inside, below that of the
region around it.  The region with the largest value is opened: its best path is a
plain sample of it, and the rest of it falls apart into one region for each
piece of that path.  A region's value is exact, so each opening yields a
segmentation, and the (k+1)-th value is the threshold of the inclusion scores.

No piece crosses from a word into the next space, so the lattice of a text is a
chain of words' lattices; those are built once for each distinct word of a slice,
for all words side by side.  All draws are functions of the row key, the sample
and the position, hence the same on any partitioning.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripple.llm.common import HELD, lean, mix, quote, raw_texts, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
CHUNK = re.compile(rb" *[^ ]+| +")
SLICE = 5 << 20
KEEP = 200_000  # chunks whose lattices a task keeps
LONG = 64  # bytes of a chunk beyond which it is not kept, and mean bytes beyond which a slice is cut smaller
HEAD = 48  # steps of a path from which a bound is taken that spares the others


class Pieces:
    """The vocabulary as a trie over bytes, with weights.

    The model's scores are ranks of merges, not chances; a piece of rank r weighs
    -log(r + 10), as word frequencies fall with their rank, and a byte of a
    character without piece as much as four times the last rank.
    """

    def __init__(self, proto: bytes, theta: float) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        sp, n = self.library, self.library.vocab_size()
        self.bytes = np.zeros(256, dtype=np.int32)
        self.surface: list[bytes] = [b""] * n
        self.weight = np.zeros(n)
        trie: dict[int, int] = {}
        ends: dict[int, int] = {}
        size = 1
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes[byte], self.surface[i] = i, bytes([byte])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = piece.encode()
                self.surface[i] = raw.replace(SPACE, b" ")
                self.weight[i] = -theta * np.log(i + 10)
                at = 0
                for byte in raw:
                    key = at << 8 | byte
                    if key not in trie:
                        trie[key] = size
                        size += 1
                    at = trie[key]
                ends[at] = i
        self.sizes = np.fromiter(map(len, self.surface), np.int32, n)
        self.places = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)
        self.space = [sp.piece_to_id("▁")]
        self.byte_weight = -theta * np.log(4 * n)
        self.ends = np.full(size, -1, dtype=np.int32)
        self.ends[list(ends)] = list(ends.values())
        # The trie's edges in an open-addressed table.
        self.bits = 18
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        keys, values = np.array(list(trie), dtype=np.int64), np.array(list(trie.values()), dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 12) & ((1 << self.bits) - 1)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes below, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | letters
        slot = self._slot(keys)
        found = self.keys.take(slot)
        out = np.where(found == keys, self.values.take(slot), -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Lattice:
    """The lattices of distinct chunks, side by side; nodes are byte positions, edges stand by their start.

    ``to``, ``id``, ``log`` (of an edge's chance at its node) and ``upto`` (the
    chances up to it) are by edge; ``at`` (a node's first edge) and ``count`` by node.
    """

    FIELDS = ("letters", "first", "last", "at", "count", "to", "id", "log", "upto", "start")

    def __init__(self, pieces: Pieces, chunks: list[bytes]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.letters = np.frombuffer(b"\0".join(chunks) + b"\0" if chunks else b"", np.uint8)
        n_nodes = len(self.letters)
        first = np.cumsum(sizes + 1) - sizes - 1
        last = first + sizes
        self.first, self.last = first.astype(np.int32), last.astype(np.int32)
        limit = np.repeat(self.last, sizes + 1)
        inner = (self.letters & 0xC0) != 0x80
        inner[last] = False
        here = np.flatnonzero(inner).astype(np.int32)
        wide = np.where(self.letters < 0x80, 1, np.where(self.letters < 0xE0, 2, np.where(self.letters < 0xF0, 3, 4))).astype(np.int32)
        alone = np.zeros(n_nodes, dtype=bool)  # characters that are a piece
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        at, nodes, depth = here, np.zeros(len(here), dtype=np.int32), 0
        n_edges = np.zeros(n_nodes, dtype=np.int32)
        while len(at):
            nodes = pieces.step(nodes, self.letters.take(at + depth))
            depth += 1
            on = np.flatnonzero(nodes >= 0)
            at, nodes = at.take(on), nodes.take(on)
            ids = pieces.ends.take(nodes)
            some = np.flatnonzero(ids >= 0)
            if len(some):
                start = at.take(some)
                found.append((start, depth, ids.take(some)))
                n_edges[start] += 1
                if depth <= 4:
                    alone[start[wide.take(start) == depth]] = True
            on = np.flatnonzero(at + depth < limit.take(at))
            at, nodes = at.take(on), nodes.take(on)
        lost = here[~alone[here]]
        n_edges[lost] += 1
        total = int(n_edges.sum())
        self.count = n_edges
        self.at = np.cumsum(n_edges, dtype=np.int32) - n_edges
        self.to, self.id, weight = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        fill = self.at + n_edges - 1  # long pieces come first
        for start, length, ids in found:
            slot = fill.take(start)
            self.to[slot], self.id[slot], weight[slot] = start + length, ids, pieces.weight.take(ids)
            fill[start] = slot - 1
        slot = fill[lost]
        self.to[slot], self.id[slot], weight[slot] = lost + wide[lost], -1, wide[lost] * pieces.byte_weight

        # The sum over all paths from a node to its chunk's end, for all nodes of one distance at a time; far from the end, where
        # the sums could underflow, by their logs.
        mass, gain = np.zeros(n_nodes), np.exp(weight)
        mass[last] = 1.0
        near = int(600 / max(1e-9, float(-weight.min(initial=-1.0))))
        by_size = np.argsort(-sizes, kind="stable")
        long, ends = -sizes[by_size], last[by_size]
        rest: np.ndarray | None = None
        longest = int(sizes.max(initial=0))
        for distance in range(1, longest + 1):
            if distance == near + 1:
                with np.errstate(divide="ignore"):
                    rest = np.log(mass)
            node = ends[: np.searchsorted(long, -distance, "right")] - distance
            count = n_edges[node]
            if distance > 1 or not count.all():
                node = node[count > 0]
                count = n_edges[node]
            if not len(node):
                continue
            begin = np.cumsum(count) - count
            edge = np.repeat(self.at.take(node) - begin, count) + np.arange(int(begin[-1] + count[-1]))
            if rest is None:
                mass[node] = np.add.reduceat(gain.take(edge) * mass.take(self.to.take(edge)), begin)
            else:
                value = weight[edge] + rest[self.to[edge]]
                top = np.maximum.reduceat(value, begin)
                rest[node] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), begin))
        self.start = np.repeat(np.arange(n_nodes, dtype=np.int32), n_edges)
        if rest is None:
            chance = gain * mass.take(self.to) / mass.take(self.start)
            self.log = np.log(chance)
        else:
            self.log = weight + rest[self.to] - rest[self.start]
            chance = np.exp(self.log)
        upto = np.cumsum(chance)
        before = np.append(0.0, upto)[self.at]
        self.upto = (upto - before.take(self.start)).astype(np.float32)
        self.upto[(self.at + n_edges - 1)[n_edges > 0]] = 2.0  # the last edge takes what is left


class Store:
    """Lattices one after another in arrays that grow; what follows the kept ones is overwritten."""

    def __init__(self, pieces: Pieces) -> None:
        self.arrays = {f: np.empty(0, getattr(Lattice(pieces, []), f).dtype) for f in Lattice.FIELDS}
        self.kept = dict.fromkeys(Lattice.FIELDS, 0)

    def add(self, lattice: Lattice, keep: bool) -> Lattice:
        """The kept lattices and this one, as one; it is kept itself if asked."""
        nodes, edges = self.kept["letters"], self.kept["to"]
        shift = {"first": nodes, "last": nodes, "to": nodes, "start": nodes, "at": edges}
        out = object.__new__(Lattice)
        for f in Lattice.FIELDS:
            new, old, n = getattr(lattice, f), self.arrays[f], self.kept[f]
            if len(old) < n + len(new):
                self.arrays[f] = np.empty(int(1.2 * (n + len(new))), old.dtype)
                self.arrays[f][:n] = old[:n]
            part = self.arrays[f][n : n + len(new)]
            part[:] = new
            if f in shift:
                part += part.dtype.type(shift[f])
            setattr(out, f, self.arrays[f][: n + len(new)])
            if keep:
                self.kept[f] = n + len(new)
        return out


class Known(dict):
    """Numbers chunks, given without the space they begin with, and keeps the lattices of so many.

    At first all are kept, from half of that number on those that occur more
    than once in a slice; what is kept changes no result.
    """

    def __init__(self, pieces: Pieces, keep: int = KEEP) -> None:
        super().__init__()
        self.pieces, self.store, self.keep = pieces, Store(pieces), keep
        self.base = 0
        self.own, self.own_count = np.empty(0, np.int32), np.empty(0, np.int64)  # the tokenizer's own ids of the chunks that are kept

    def numbered(self, chunks: list[bytes]) -> tuple[np.ndarray, Lattice, np.ndarray, np.ndarray]:
        """The chunks' numbers, and by number their lattices, the tokenizer's own ids, and the counts of these.

        No piece holds a space after another character, so no merge crosses
        from one chunk to the next, and a text's ids are those of its chunks.
        """
        found = pa.array(chunks, pa.binary()).dictionary_encode()
        names, which, base = found.dictionary.to_pylist(), found.indices.to_numpy(), self.base
        numbers = np.fromiter(map(self.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(numbers < 0)
        new = [names[i] for i in fresh.tolist()]
        often = np.bincount(which, minlength=len(names))[fresh] > 1
        if base + len(new) <= self.keep // 2:  # as long as there is room, all of them
            often[:] = True
        often &= np.fromiter(map(len, new), np.int64, len(new)) <= LONG
        often[np.flatnonzero(often)[max(0, self.keep - base) :]] = False
        order = np.argsort(~often, kind="stable")
        numbers[fresh[order]] = np.arange(len(new)) + base
        numbers = numbers.take(which)
        n_kept, ordered = int(often.sum()), [new[i] for i in order.tolist()]
        kept, passing = ([SPACE + c.replace(b" ", SPACE) for c in x] for x in (ordered[:n_kept], ordered[n_kept:]))
        if n_kept:
            self.store.add(Lattice(self.pieces, kept), True)
            self.update(zip(ordered[:n_kept], range(base, base + n_kept), strict=True))
        self.base = base + n_kept
        ids = self.pieces.library.encode([c.decode() for c in ordered]) if ordered else []  # a space is added before each
        ids = [x or self.pieces.space for x in ids]  # but not to an empty text, which stands for a space at the end
        count = np.concatenate([self.own_count, np.fromiter(map(len, ids), np.int64, len(ids))])
        own = np.concatenate([self.own, np.fromiter(chain.from_iterable(ids), np.int32, int(count[base:].sum()))])
        self.own_count = count[: self.base].copy()
        self.own = own[: int(self.own_count.sum())].copy()
        return numbers, self.store.add(Lattice(self.pieces, passing), False), own, count


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt alone."""
    return ((mix(key, salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lattice: Lattice, nodes: np.ndarray, last: np.ndarray, keys: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from each node to its chunk's end: (number of edges of each path, edges path by path)."""
    counts = np.zeros(len(nodes), dtype=np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    on = np.flatnonzero(nodes != last)
    node, key, stop = nodes.take(on), keys.take(on), last.take(on)
    while len(on):
        edge = lattice.at.take(node)
        open_ = np.flatnonzero(lattice.count.take(node) > 1)
        if len(open_):
            u, e = uniform(key.take(open_), salt).astype(np.float32), edge.take(open_)
            left = np.flatnonzero(u >= lattice.upto.take(e))
            while len(left):
                e[left] += 1
                left = left[u.take(left) >= lattice.upto.take(e.take(left))]
            edge[open_] = e
        taken.append((on, edge))
        counts[on] += 1
        node = lattice.to.take(edge)
        more = np.flatnonzero(node != stop)
        on, node, stop = on.take(more), node.take(more), stop.take(more)
        with np.errstate(over="ignore"):
            key = key.take(more) + np.uint64(0x632BE59BD9B4E019)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    begin = ends - counts
    for depth, (which, edge) in enumerate(taken):
        out[begin[which] + depth] = edge
    return counts, out


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, .. for count[0] numbers, then begin[1], .."""
    if not len(count):
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(int(ends[-1]))


def chunks_of(text: bytes) -> list[bytes]:
    """Maximal runs of spaces with what follows them, after the space that the tokenizer adds; each without its first space."""
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [c[1:] for c in CHUNK.findall(b" " + text)]
    return text.split(b" ") if text else []


class Sampler:
    """The k-best perturbed paths of the documents of one slice."""

    def __init__(self, known: Known, texts: list[bytes], keys: np.ndarray, k: int) -> None:
        self.k, self.keys = k, keys
        split = [chunks_of(x) for x in texts]
        per = np.fromiter(map(len, split), np.int64, len(split))
        self.chunk, self.lattice, own, count = known.numbered(list(chain.from_iterable(split)))
        del split
        #: The tokenizer's own ids, text by text, and how many each has.
        each = count.take(self.chunk)
        self.own = own.take(ragged((np.cumsum(count) - count).take(self.chunk), each))
        self.n_own = _sums(each, per)
        self.per, self.doc_first = per, np.cumsum(per) - per  # chunks of each document, and the first of them
        self.first, self.last = self.lattice.first.take(self.chunk), self.lattice.last.take(self.chunk)
        with np.errstate(over="ignore"):
            nth = (np.arange(len(self.chunk)) - np.repeat(self.doc_first, per)).astype(np.uint64)
            self.chunk_key = mix(np.repeat(keys, per) + nth * np.uint64(0x9E3779B97F4A7C15), 3)
        self.samples: list[dict[str, np.ndarray]] = []
        n = len(texts)
        #: Open regions of each document, best first: value, sample, step; and the edges barred at the step.
        self.value, self.parent, self.step = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.barred: list[list[tuple[int, ...]]] = [[()] * k for _ in range(n)]
        self.threshold = np.full(n, -np.inf)
        self._run()

    def _run(self) -> None:
        n = len(self.keys)
        counts, edges = walk(self.lattice, self.first, self.last, self.chunk_key, 100)
        bound = -np.log(-np.log(uniform(self.keys, 7)))
        self._add(np.arange(n), counts, edges, bound, np.zeros(n, np.int64), [()] * n)
        for s in range(1, self.k):
            docs = np.flatnonzero(self.value[:, 0] > -np.inf)
            if not len(docs):
                break
            bound, parent, step = self.value[docs, 0].copy(), self.parent[docs, 0].copy(), self.step[docs, 0].copy()
            barred = [self.barred[d][0] for d in docs.tolist()]
            self._drop_best(docs)
            counts, edges = self._resample(docs, parent, step, barred, s)
            self._add(docs, counts, edges, bound, step, barred)
        self.threshold = self.value[:, 0].copy()

    def _drop_best(self, docs: np.ndarray) -> None:
        for x, empty in ((self.value, -np.inf), (self.parent, 0), (self.step, 0)):
            x[docs, :-1] = x[docs, 1:]
            x[docs, -1] = empty
        for d in docs.tolist():
            self.barred[d] = [*self.barred[d][1:], ()]

    def _resample(self, docs: np.ndarray, parent: np.ndarray, step: np.ndarray, barred: list[tuple[int, ...]], s: int) -> tuple[np.ndarray, np.ndarray]:
        """Sample the region of each document: its parent's pieces before the step, another piece there, any pieces after."""
        lat = self.lattice
        at = np.empty(len(docs), dtype=np.int64)  # the chunk that holds the step
        held = np.empty(len(docs), dtype=np.int64)  # pieces of that chunk before the step
        before: list[tuple[np.ndarray, np.ndarray]] = [(at, at)] * len(docs)  # counts of the chunks before that one, and pieces before the step
        for p in range(s):
            which = np.flatnonzero(parent == p)
            if not len(which):
                continue
            old = self.samples[p]
            row = old["slot"][docs[which]]
            begin, first = old["begin"][row], old["edge_begin"][row]  # of the parents
            at_edge = first + step[which]
            chunk = np.searchsorted(old["chunk_begin"], at_edge, "right") - 1
            at[which] = self.doc_first[docs[which]] + chunk - begin
            held[which] = at_edge - old["chunk_begin"][chunk]
            for j, b, c, f, e in zip(which.tolist(), begin.tolist(), chunk.tolist(), first.tolist(), at_edge.tolist(), strict=True):
                before[j] = old["counts"][b:c], old["edges"][f:e]
        # The step itself: an edge that is not barred, by its chance among these.
        picked = np.empty(len(docs), dtype=np.int32)
        u = uniform(self.keys[docs], 1000 + s)
        for j, (c, inner) in enumerate(zip(at.tolist(), held.tolist(), strict=True)):
            node = int(lat.to[before[j][1][-1]]) if inner else int(self.first[c])
            free = [e for e in range(int(lat.at[node]), int(lat.at[node] + lat.count[node])) if e not in barred[j]]
            upto = np.cumsum(np.exp(lat.log[free]))
            picked[j] = free[min(len(free) - 1, int(np.searchsorted(upto, u[j] * upto[-1], "right")))]
        # The rest of the step's chunk and all later chunks, freely.  Stretches of documents are copied whole.
        ends = (self.doc_first + self.per)[docs]
        later = list(zip(at.tolist(), ends.tolist(), strict=True))
        nodes, last, keys = (np.concatenate([x[a:b] for a, b in later]) for x in (self.first, self.last, self.chunk_key))
        cut = np.cumsum(ends - at)
        opening = cut - (ends - at)
        nodes[opening] = lat.to[picked]
        n_new, new = walk(lat, nodes, last, keys, 100 + s)
        edge_cut = np.append(0, np.cumsum(n_new))[cut]
        n_new[opening] += held + 1
        counts: list[np.ndarray] = []
        edges: list[np.ndarray] = []
        a = x = 0
        for j, (b, y) in enumerate(zip(cut.tolist(), edge_cut.tolist(), strict=True)):
            counts += [before[j][0], n_new[a:b]]
            edges += [before[j][1], picked[j : j + 1], new[x:y]]
            a, x = b, y
        return np.concatenate(counts), np.concatenate(edges)

    def _add(self, docs: np.ndarray, counts: np.ndarray, edges: np.ndarray, bound: np.ndarray, step: np.ndarray, barred: list[tuple[int, ...]]) -> None:
        """Keep a sample for each of ``docs``, and the regions that the rest of its region falls into."""
        lat, s, n = self.lattice, len(self.samples), len(docs)
        slot = np.full(len(self.keys), -1, dtype=np.int64)
        slot[docs] = np.arange(n)
        per = self.per[docs]
        n_edges = _sums(counts, per)
        begin = np.cumsum(n_edges) - n_edges
        log = lat.log.take(edges)
        total = np.cumsum(log)
        offset = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0.0) if len(log) else np.zeros(n)
        logp = np.where(n_edges > 0, total[np.maximum(begin + n_edges, 1) - 1] - offset, 0.0) if len(log) else np.zeros(n)
        self.samples.append({
            "slot": slot, "docs": docs, "counts": counts, "edges": edges, "begin": np.cumsum(per) - per, "edge_begin": begin, "n_edges": n_edges,
            "chunk_begin": np.cumsum(counts) - counts, "logp": logp, "value": bound,
        })
        if not len(edges):
            return
        # A uniform number has 53 bits, so log(-log(u)) lies within -37 and 4: a region of that much less mass than k others
        # cannot be among the first k.  Masses never exceed the chance of what comes before, which only falls along a path.
        head = np.minimum(n_edges, step + HEAD)
        sure = np.full(n, -np.inf)
        sure[n_edges > 0] = self._kth_mass(total, log, offset, edges, begin, step, head, n_edges > 0)
        # So the first steps are looked at, from the region's own on: the sums fall along the documents, which gives the last of them.
        least = np.searchsorted(np.negative(total), 43.0 - offset - sure, "right") + 1
        n_kept = np.maximum(0, np.minimum(begin + n_edges, least) - begin - step)
        kept = ragged(begin + step, n_kept)
        doc = np.repeat(np.arange(n), n_kept)
        nth = kept - begin[doc]
        picked, prefix = edges[kept], total[kept] - log[kept] - offset[doc]
        some, begin = n_kept > 0, np.cumsum(n_kept) - n_kept
        mass = self._others(picked)
        hold = np.flatnonzero(nth == step[doc])
        for i, d in zip(hold.tolist(), doc[hold].tolist(), strict=True):
            if barred[d]:
                left = lat.count[lat.start[picked[i]]] > len(barred[d]) + 1
                mass[i] = max(0.0, mass[i] - float(np.exp(lat.log[list(barred[d])]).sum())) if left else 0.0
        with np.errstate(divide="ignore", over="ignore"):
            location = prefix + np.log(mass)
            key = mix(self.keys[docs][doc] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
            rank = np.log(-np.log(uniform(key, 500 + s))) - location  # the smaller, the larger the perturbed value
        rank[mass <= 0] = np.inf
        edges, n_edges = picked, n_kept
        if not len(edges):
            return
        filled, live = np.flatnonzero(some), np.ones(int(some.sum()), dtype=bool)
        left = self.k - s  # regions that can still be opened, or give the threshold
        for _ in range(left):
            best = np.minimum.reduceat(rank, begin[filled])
            # Each document's best region that is left, if it belongs among the first of them.
            value = -np.logaddexp(-bound[filled], best)
            live &= np.isfinite(best) & (value > self.value[docs[filled], left - 1])
            if not live.any():
                break
            wanted = np.full(n, np.nan)
            wanted[filled[live]] = best[live]
            hit = np.flatnonzero(rank == np.repeat(wanted, n_edges))
            hit = hit[np.unique(doc[hit], return_index=True)[1]]
            rank[hit] = np.inf
            for i, d, v in zip(hit.tolist(), filled[live].tolist(), value[live].tolist(), strict=True):
                row, k = int(docs[d]), self.k
                own = int(nth[i])
                at = int(np.searchsorted(-self.value[row], -v, "right"))
                for x, new in ((self.value, v), (self.parent, s), (self.step, own)):
                    x[row, at + 1 :] = x[row, at : k - 1].copy()
                    x[row, at] = new
                edge = int(edges[i])
                self.barred[row] = [*self.barred[row][:at], (*barred[d], edge) if own == int(step[d]) else (edge,), *self.barred[row][at : k - 1]]

    def _others(self, edges: np.ndarray) -> np.ndarray:
        """The chance of the other edges at each edge's node."""
        lat = self.lattice
        mass = -np.expm1(lat.log.take(edges))
        mass[lat.count.take(lat.start.take(edges)) == 1] = 0.0
        return mass

    def _kth_mass(self, total: np.ndarray, log: np.ndarray, offset: np.ndarray, edges: np.ndarray, begin: np.ndarray, step: np.ndarray, head: np.ndarray, some: np.ndarray) -> np.ndarray:
        """A lower bound of the k-th largest log mass of each document's regions, from the first steps of its path; -inf where there are fewer."""
        first, count = (begin + np.minimum(step, head - 1))[some], (head - np.minimum(step, head - 1))[some]
        at = ragged(first, count)
        with np.errstate(divide="ignore"):
            # The step itself may have more edges barred: it is left out.
            value = total[at] - log[at] - np.repeat(offset[some], count) + np.log(self._others(edges[at]))
        starts = np.cumsum(count) - count
        value[starts] = -np.inf
        for _ in range(self.k - 1):
            best = np.maximum.reduceat(value, starts)
            value[value == np.repeat(best, count)] = -np.inf
        return np.maximum.reduceat(value, starts)

    def ids(self, pieces: Pieces, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the s-th samples, text by text; how many each has, -1 for texts without such a sample)."""
        lat, sample = self.lattice, self.samples[s]
        ids = lat.id.take(sample["edges"])
        counts = np.full(len(self.keys), -1, dtype=np.int64)
        n_edges = sample["n_edges"]
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # a character without piece: its bytes
            node = lat.start[sample["edges"][lost]]
            wide = np.ones(len(ids), dtype=np.int64)
            wide[lost] = lat.to[sample["edges"][lost]] - node
            ends = np.cumsum(wide)
            whole = np.repeat(ids, wide)
            whole[ragged(ends[lost] - wide[lost], wide[lost])] = pieces.bytes[lat.letters[ragged(node, wide[lost])]]
            ids, n_edges = whole, _sums(wide, n_edges)
        counts[sample["docs"]] = n_edges
        return ids, counts


def decode(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of ids that stand one after another, so many each; the space before every text is taken off."""
    size = pieces.sizes.take(ids)
    ends = np.cumsum(size, dtype=np.int32)  # a slice has far fewer than 2**31 bytes
    total = int(ends[-1]) if len(ends) else 0
    raw = pieces.letters.take(np.repeat(pieces.places.take(ids) - ends + size, size) + np.arange(total, dtype=np.int32)).tobytes()
    ends = np.cumsum(_sums(size, counts)).tolist()
    return [(lambda x: x[1:] if x[:1] == b" " else x)(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_last: dict[tuple, Known] = {}


def _known(proto: bytes, theta: float, keep: int) -> Known:
    """The vocabulary and the lattices kept so far; a worker's later tasks take up what its earlier ones left."""
    key = (xxhash.xxh3_64_intdigest(proto), theta, keep)
    if key not in _last:
        _last.clear()
        _last[key] = Known(Pieces(proto, theta), keep)
    return _last[key]


def row_keys(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(repr(k).encode(), seed) for k in keys], dtype=np.uint64)


def log_inclusion(logp: float, threshold: float) -> float:
    """Log of the chance that a path's perturbed value exceeds the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = logp - threshold
    return float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The tokenizer's file, which the driver reads and sends to the tasks (0.5 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _bounded(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of so many bytes, or a fifth where texts have few spaces: their chunks hardly repeat, and each needs a lattice."""
    for batch in slices(batches, "text", limit):
        raw = raw_texts(batch, "text")
        if sum(map(len, raw)) > LONG * (len(raw) + sum(x.count(b" ") for x in raw)):
            yield from slices(iter([batch]), "text", limit // 5)
        else:
            yield batch


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, theta: float = 1.0, seed: int = 17, model: str = MODEL, with_ids: bool = False, slice_bytes: int = SLICE, keep: int = KEEP, carry: bool = True) -> DataFrame:
    """Encode each text, check that it decodes, and sample k segmentations without replacement.

    Returns, one row for each input row: key, n_ids and ids_sha256 (of the
    tokenizer's own ids as little-endian int32), decodes (whether these ids give
    the text back), and for the samples, best first, arrays sample_n_ids,
    sample_sha256, sample_logp (log chance of the segmentation under the lattice),
    sample_log_inclusion (log chance of being among the k, given the threshold)
    and samples_decode; with ``with_ids`` also ids and sample_ids.

    A task handles ``slice_bytes`` of text at once and keeps the lattices of
    ``keep`` chunks; both bound its memory (some 450 MB as they are, 200 MB at 2 MB
    and 40,000), and without ``carry`` it keeps nothing for the worker's next task; none
    of these changes a result.  A text with fewer than k segmentations has them all.  Null texts count as
    empty, and an empty text has one empty segmentation.  Texts of one key share
    their draws where they begin alike; keys may be of any type and null.  Other
    columns are not read; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))
    plain = docs.select(F.col(quote(key)).alias("id"), F.coalesce(quote(text), F.lit("")).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    own = "n_ids long, ids_sha256 string, decodes boolean"
    drawn = "sample_n_ids array<long>, sample_sha256 array<string>, sample_logp array<double>, sample_log_inclusion array<double>, samples_decode boolean"
    full = ", ids array<int>, sample_ids array<array<int>>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(proto.value, theta, keep) if carry else Known(Pieces(proto.value, theta), keep)
        pieces = known.pieces
        gc.disable()  # nothing here refers to itself; the collector would walk the millions of chunks again and again
        try:
            yield from encoded(batches, known, pieces)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch], known: Known, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, slice_bytes):
            raw = raw_texts(batch, "text")
            sampler = Sampler(known, raw, row_keys(batch.column("id").to_pylist(), seed), k)
            rows: list[dict[str, list]] = [{"n": [], "sha": [], "logp": [], "in": [], "ids": []} for _ in raw]

            def cut(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
                ends = np.cumsum(counts).tolist()
                return [ids[b - n : b] for b, n in zip(ends, counts.tolist(), strict=True)]

            def sha(ids: np.ndarray) -> str:
                return hashlib.sha256(ids.astype("<i4", copy=False)).hexdigest()

            ids = cut(sampler.own, sampler.n_own)
            decodes = [a == b for a, b in zip(decode(pieces, sampler.own, sampler.n_own), raw, strict=True)]
            good = [True] * len(raw)
            for s, sample in enumerate(sampler.samples):
                flat, counts = sampler.ids(pieces, s)
                held = np.flatnonzero(counts >= 0).tolist()
                counts = counts[held]
                for d, x, back in zip(held, cut(flat, counts), decode(pieces, flat, counts), strict=True):
                    logp = float(sample["logp"][sample["slot"][d]])
                    rows[d]["n"].append(len(x))
                    rows[d]["sha"].append(sha(x))
                    rows[d]["logp"].append(logp)
                    rows[d]["in"].append(log_inclusion(logp, float(sampler.threshold[d])))
                    good[d] = good[d] and back == raw[d]
                    if with_ids:
                        rows[d]["ids"].append(x.tolist())
            columns = [
                batch.column("id"),
                pa.array(sampler.n_own, pa.int64()),
                pa.array([sha(x) for x in ids]),
                pa.array(decodes),
                pa.array([r["n"] for r in rows], pa.list_(pa.int64())),
                pa.array([r["sha"] for r in rows], pa.list_(pa.string())),
                pa.array([r["logp"] for r in rows], pa.list_(pa.float64())),
                pa.array([r["in"] for r in rows], pa.list_(pa.float64())),
                pa.array(good),
            ]
            names = ["id", "n_ids", "ids_sha256", "decodes", "sample_n_ids", "sample_sha256", "sample_logp", "sample_log_inclusion", "samples_decode"]
            if with_ids:
                columns += [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([r["ids"] for r in rows], pa.list_(pa.list_(pa.int32())))]
                names += ["ids", "sample_ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    # Much of the time would else go into fetching the same large arrays from the system, slice after slice.
    return plain.mapInArrow(lean(run, 32 << 20 if carry else HELD), f"id {kind}, {own}, {drawn}{full}").withColumnRenamed("id", key)
