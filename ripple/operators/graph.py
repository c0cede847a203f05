"""Graphs of nodes as edge DataFrames: levels, cycles, reachability.

Depth decides what a loop over DataFrames costs, size what memory can hold.  Graphs
of up to SMALL_EDGES edges, a bound that is checked, are walked in memory, whatever
their depth.  Beyond it, loops go by rounds, one for each level or hop: a round joins
the edges with its frontier only, appends what it found to one table in the shared
folder, and its cost follows the frontier.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.sources.errors import CycleError
from ripple.sources.shared import Growing, drop, written

SMALL_EDGES = 500_000
BATCH_ROWS = 50_000  # rows that a walk in memory puts out at once


def levels(edges: dict[str, list[str]]) -> dict[str, int]:
    """Each node's longest distance from a node without parents; CycleError for a cycle. Parents that have no entry count."""
    children, waits, level = defaultdict(list), {}, {}
    for child, parents in edges.items():
        waits.setdefault(child, 0)
        for p in dict.fromkeys(parents):
            waits.setdefault(p, 0)
            waits[child] += 1
            children[p].append(child)
    ready = deque(n for n, k in waits.items() if k == 0)
    for n in ready:
        level[n] = 0
    while ready:
        n = ready.popleft()
        for c in children[n]:
            level[c] = max(level.get(c, 0), level[n] + 1)
            waits[c] -= 1
            if waits[c] == 0:
                ready.append(c)
    left = {n for n, k in waits.items() if k > 0}
    if left:
        raise CycleError(_cycle({n: [p for p in edges.get(n, []) if p in left] for n in left}))
    return level


def _cycle(edges: dict[str, list[str]]) -> list[str]:
    at, seen = min(n for n, p in edges.items() if p), []
    while at not in seen:
        seen.append(at)
        at = min(p for p in edges[at] if edges.get(p)) if any(edges.get(p) for p in edges[at]) else edges[at][0]
    return [*seen[seen.index(at) :], at]


class Small:
    """A graph in memory: nodes by number, and for each those ahead of it, in two arrays."""

    def __init__(self, table: pa.Table) -> None:
        numbers: dict[object, int] = {}
        self.names: list = []
        ends = []
        for column in ("a", "b"):
            out = np.empty(table.num_rows, dtype=np.int32)
            for i, x in enumerate(table.column(column).to_pylist()):
                at = numbers.setdefault(_plain(x), len(numbers))
                if at == len(self.names):
                    self.names.append(x)
                out[i] = at
            ends.append(out)
        self.numbers, (a, b) = numbers, ends
        order = np.argsort(a, kind="stable")
        self.ahead = b[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.names) + 1))

    def next(self, at: int) -> list[int]:
        return self.ahead[self.first[at] : self.first[at + 1]].tolist()

    def reached(self, seed: object) -> list:
        """What a node leads to; the node itself only by a cycle."""
        start = self.numbers.get(_plain(seed))
        if start is None:
            return []
        seen, queue = set(), deque([start])
        while queue:
            for b in self.next(queue.popleft()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        return [self.names[i] for i in seen]

    def on_cycles(self) -> list:
        """Nodes of strongly connected parts of more than one node, or with an edge to themselves (after Tarjan, without recursion)."""
        index, low, on, path, out, count = {}, {}, set(), [], [], 0
        for root in range(len(self.names)):
            if root in index:
                continue
            work = [(root, iter(self.next(root)))]
            index[root] = low[root] = count
            count += 1
            path.append(root)
            on.add(root)
            while work:
                at, rest = work[-1]
                b = next(rest, None)
                if b is None:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[at])
                    if low[at] == index[at]:
                        part = []
                        while not part or part[-1] != at:
                            part.append(path.pop())
                            on.discard(part[-1])
                        if len(part) > 1 or at in self.next(at):
                            out += part
                elif b not in index:
                    index[b] = low[b] = count
                    count += 1
                    path.append(b)
                    on.add(b)
                    work.append((b, iter(self.next(b))))
                elif b in on:
                    low[at] = min(low[at], index[b])
        return [self.names[i] for i in out]


def _frame(like: DataFrame, **columns: list) -> DataFrame:
    """Rows with columns of the type of ``like``'s only column, and whole numbers."""
    kind = like.schema.fields[0].dataType
    rows = list(zip(*columns.values(), strict=True))
    return like.sparkSession.createDataFrame(rows, ", ".join(f"{c} {kind.simpleString() if i == 0 else 'int'}" for i, c in enumerate(columns)))


def topo_levels(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, level): longest paths from nodes without parents.

    CycleError where nodes are left over.  Edges with a null end are ignored.
    """
    pairs = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct()
    pairs = written(pairs, "topo")
    node = pairs.select(F.col("child").alias("node"))
    if pairs.count() <= SMALL_EDGES:
        parents: dict[object, list] = {}
        names = {}
        for c, p in zip(*(x.to_pylist() for x in pairs.toArrow().columns), strict=True):
            parents.setdefault(_plain(c), []).append(_plain(p))
            names[_plain(c)], names[_plain(p)] = c, p
        found = levels(parents)
        return _frame(node, node=[names[n] for n in found], level=list(found.values()))
    free = written(pairs.select(F.col("parent").alias("node")).distinct().join(node.distinct(), "node", "left_anti"), "topo")
    # How many parents of each node have no level yet.
    waiting = written(pairs.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("open")), "topo")
    done, level = Growing(free.withColumn("level", F.lit(0)), "levels"), 0
    while free.limit(1).count():
        less = pairs.join(free, pairs["parent"] == free["node"], "left_semi").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("less"))
        left = written(waiting.join(less, "node", "left").select("node", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")), "topo")
        drop(waiting)
        drop(free)
        waiting, level = left.where("open > 0"), level + 1
        free = written(left.where("open = 0").select("node"), "topo")
        waiting = written(waiting, "topo")
        drop(left)
        done.add(free.withColumn("level", F.lit(level)))
    some = waiting.limit(10_000).collect()
    if some:
        found: dict[str, list[str]] = {}
        among = pairs.join(waiting, pairs["child"] == waiting["node"], "left_semi").join(waiting, pairs["parent"] == waiting["node"], "left_semi")
        for r in among.limit(10_000).collect():
            found.setdefault(r["child"], []).append(r["parent"])
        raise CycleError(sorted(map(str, found)))
    return done.rows


def cycle_nodes(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that lie on a cycle.

    Beyond what memory holds, nodes that nothing leads to and nodes that lead
    nowhere are peeled off, round by round, until what is left is small enough, or
    nothing more can be peeled.  Then each node takes the largest node that leads to
    it as its colour, and what of a colour leads back to that node is on a cycle with
    it; the rest goes on (Orzan, 2004).
    """
    pairs = edges.select(F.col(parent).alias("a"), F.col(child).alias("b")).where("a is not null and b is not null").distinct()
    loops = written(pairs.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")), "loops")
    pairs = written(pairs.where(F.col("a") != F.col("b")), "cycles")
    found, size = Growing(loops, "cyclic"), pairs.count()
    while size > SMALL_EDGES:
        core = pairs.join(pairs.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi").join(pairs.select(F.col("a").alias("y")).distinct(), F.col("b") == F.col("y"), "left_semi")
        core = written(core, "cycles")
        now = core.count()
        if now == size:
            drop(core)
            found.add(parts := _coloured(pairs))
            core = pairs.join(parts.select(F.col("node").alias("x")), F.col("a") == F.col("x"), "left_anti").join(parts.select(F.col("node").alias("y")), F.col("b") == F.col("y"), "left_anti")
            core = written(core, "cycles")
            now = core.count()
        drop(pairs)
        pairs, size = core, now
    if size:
        nodes = Small(pairs.toArrow()).on_cycles()
        found.add(_frame(found.rows, node=nodes))
    return found.rows.distinct()


def _coloured(pairs: DataFrame) -> DataFrame:
    """Nodes that are on a cycle with the largest node that leads to them; of a graph where all are led to, some at least, and whole parts."""
    colours = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        offered = pairs.join(colours, pairs["a"] == colours["node"]).select(F.col("b").alias("node"), "colour")
        after = written(colours.union(offered).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
        changed = after.withColumnRenamed("colour", "now").join(colours, "node").where(F.col("now") != F.col("colour")).limit(1).count()
        drop(colours)
        colours = after
        if not changed:
            break
    at, to = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
    within = written(pairs.join(at, "a").join(to, "b").where(F.col("ca") == F.col("cb")).select("a", "b"), "within")
    roots = colours.where(F.col("node") == F.col("colour")).select("node")
    back = _hops(within.select(F.col("b").alias("a"), F.col("a").alias("b")), roots.select(F.col("node").alias("seed")))
    # A part has at least two nodes, as edges from a node to itself are gone.
    return written(back.select("node").union(back.where("seed <> node").select("seed")).distinct(), "parts")


def reverse_edges(edges: DataFrame, nodes: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, children): for each node the sorted nodes that depend on it, none as an empty list."""
    by = edges.groupBy(F.col(parent).alias("node")).agg(F.array_sort(F.collect_set(child)).alias("children"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(by, "node", "left").withColumn("children", F.coalesce("children", F.array().cast(by.schema["children"].dataType)))


def reach(edges: DataFrame, seeds: DataFrame, keep_seeds: bool = False) -> DataFrame:
    """(seed, node): what each seed reaches along edges a -> b of any comparable type.

    A seed is among what it reaches only if a cycle leads back to it and
    ``keep_seeds`` is set.  Unknown seeds reach nothing.
    """
    pairs = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "reach")
    starts = seeds.select("seed").distinct()
    found = _small_reach(pairs, starts) if pairs.count() <= SMALL_EDGES else _hops(pairs, starts)
    return found if keep_seeds else found.where("seed <> node")


def _small_reach(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Breadth-first from each seed; the edges, of a checked number, go to every task of seeds."""
    shared = pairs.sparkSession.sparkContext.broadcast(Small(pairs.toArrow()))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            type_, seeds, nodes = batch.schema.field("seed").type, [], []
            for seed in batch.column("seed").to_pylist():
                found = shared.value.reached(seed)
                for at in range(0, len(found), BATCH_ROWS):
                    seeds += [seed] * len(found[at : at + BATCH_ROWS])
                    nodes += found[at : at + BATCH_ROWS]
                    if len(seeds) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(seeds, type_), pa.array(nodes, type_)], names=["seed", "node"])
                        seeds, nodes = [], []
            if seeds:
                yield pa.RecordBatch.from_arrays([pa.array(seeds, type_), pa.array(nodes, type_)], names=["seed", "node"])

    return starts.select(F.col("seed").cast(pairs.schema["a"].dataType)).mapInArrow(run, f"seed {kind}, node {kind}")


def _plain(x: object) -> object:
    return tuple(sorted(x.items())) if isinstance(x, dict) else x


def _hops(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Hop by hop from the seeds; only what a hop finds for the first time hops on."""
    front = written(starts.join(pairs, starts["seed"] == pairs["a"]).select("seed", F.col("b").alias("node")).distinct(), "front")
    found = Growing(front, "reached")
    while front.limit(1).count():
        ahead = front.join(pairs, front["node"] == pairs["a"]).select("seed", F.col("b").alias("node")).distinct()
        new = written(ahead.join(found.rows, ["seed", "node"], "left_anti"), "front")
        drop(front)
        front = new
        found.add(front)
    return found.rows


def descendants(edges: DataFrame, seeds: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node): all that depends on any of the seeds, directly or not, without the seeds."""
    found = reach(edges.select(F.col(parent).alias("a"), F.col(child).alias("b")), seeds, keep_seeds=True)
    return found.select("node").distinct().join(seeds.select(F.col("seed").alias("node")), "node", "left_anti")
