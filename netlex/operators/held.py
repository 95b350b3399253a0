"""Searches from many roots in tasks that hold a graph: arcs are packed and dealt to some tasks once, a task searches from its
share of the roots level by level, and only sums over roots (or the pairs asked for) leave it. No level is shuffled or written.

Graphs are told apart by `graph` (0, 1, ...), so many of them, such as rewires, are searched in one go. A task holds one graph of up
to `HELD` nodes and arcs, and a matrix of about `CELLS` cells (node, root); larger graphs are searched by shuffles (`flow`, `traverse`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netlex.functions.shared import settle
from netlex.operators.ranks import row_ordinals

#: Nodes and arcs of a graph that a task may hold, cells of its matrix, roots of a block, and numbers that are added up at once.
HELD, CELLS, ROOTS, CHUNK = 1 << 24, 1 << 22, 128, 1 << 16
#: Rows of a packed piece, and of a batch of pairs.
PIECE = 1 << 18
#: An arc of a cell costs as much as this many numbers of whole rows.
PUSH = 12


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits that tells all numbers apart (the last steps of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(names: DataFrame, df: DataFrame, column: str, to: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the number `to` of the node that `column` names; rows without one go."""
    return df.join(names.select(*keys, F.col("name").alias(column), F.col("node").alias(to)), [*keys, column])


def named_arcs(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, name, node) and (graph, come, go): numbers of the nodes, and the distinct edges between them; edges: (graph, src,
    dst), nodes: (graph, node)."""
    e = settle(edges.select("graph", "src", "dst").filter("src is not null and dst is not null").distinct())
    every = e.select("graph", F.explode(F.array("src", "dst")).alias("name")).union(nodes.select("graph", "node")).filter("name is not null").distinct()
    names = settle(row_ordinals(every, [F.asc("graph"), F.asc("name")], "i").select("graph", "name", F.col("i").cast("int").alias("node")))
    arcs = numbered(names, numbered(names, e, "src", "come", ("graph",)), "dst", "go", ("graph",)).select("graph", "come", "go")
    return names, settle(arcs)


def fits(names: DataFrame, arcs: DataFrame) -> bool:
    """Whether a task may hold each of the graphs."""
    sizes = names.select("graph").union(arcs.select("graph")).groupBy("graph").agg(F.count("*").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= HELD


def packed(df: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """key, kind, bytes: rows of df with the same key (int), packed as Arrow pieces without it."""
    rest = df.drop(key)
    schema = to_arrow_schema(rest.schema)

    def piece(at: int, rows: list[pa.Table]) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, schema) as writer:
            writer.write_table(pa.concat_tables(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([kind]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["key", "kind", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, at = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            whole = pa.Table.from_batches([batch]).select(schema.names).cast(schema)
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if rows and (keys[lo] != at or n >= PIECE):
                    yield piece(at, rows)
                    rows, n = [], 0
                at = int(keys[lo])
                rows.append(whole.slice(lo, hi - lo))
                n += hi - lo
        if rows:
            yield piece(at, rows)

    dealt = df.withColumn(key, F.col(key).cast("int")).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return settle(dealt.mapInArrow(run, "key int, kind string, bytes binary"))


def opened(batches: list[pa.RecordBatch], kind: str) -> pa.Table | None:
    """The rows that pieces of a kind hold."""
    pieces = [pa.ipc.open_stream(b.as_buffer()).read_all() for batch in batches for k, b in zip(batch.column("kind").to_pylist(), batch.column("bytes"), strict=True) if k == kind]
    return pa.concat_tables(pieces).combine_chunks() if pieces else None


class Arcs:
    """Arcs of a graph by both ends; nodes are numbers from 0, `ids` their ids."""

    def __init__(self, come: np.ndarray, go: np.ndarray, more: np.ndarray):
        every = [x for x in (come, go, more) if len(x)]
        base = min(int(x.min()) for x in every)
        held = np.zeros(max(int(x.max()) for x in every) - base + 1, bool)
        for x in every:
            held[x - base] = True
        self.ids, self.n, self.arcs = np.flatnonzero(held) + base, int(held.sum()), len(come)
        local = (np.cumsum(held) - 1).astype(np.int32)
        come, go = local[come - base], local[go - base]
        self.of = lambda ids: local[ids - base].astype(np.int64)
        order = np.lexsort((come, go))
        self.come, self.go = come[order], go[order]
        # The same arcs by where they come from.
        order = np.lexsort((go, come))
        self.out, self.degree = go[order], np.bincount(come, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        self.turned: Arcs | None = None

    def components(self) -> np.ndarray:
        """The least node of each node's component, if arcs stand both ways round."""
        label = np.arange(self.n)
        while True:
            ahead = label[label]
            new = ahead.copy()
            np.minimum.at(new, label[self.come], ahead[self.go])
            np.minimum.at(new, self.come, ahead[self.go])
            if (new == label).all():
                return label
            label = new

    def corners(self) -> np.ndarray:
        """In how many triangles each node is, if arcs stand both ways round and once: wedges from the end of less degree, closed by an arc."""
        place = np.empty(self.n, np.int64)
        place[np.lexsort((np.arange(self.n), self.degree))] = np.arange(self.n)
        low, high = place[self.come], place[self.go]
        low, high = low[low < high], high[low < high]
        key = np.sort(low * self.n + high)
        low, high = key // self.n, key % self.n
        first = np.searchsorted(low, np.arange(self.n + 1))
        size, count = np.diff(first)[high], np.zeros(self.n, np.int64)
        ends, lo = np.cumsum(size), 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            n = size[lo:hi]
            arc = np.repeat(np.arange(lo, hi), n)
            third = high[np.arange(int(n.sum())) + np.repeat(first[high[lo:hi]] - (np.cumsum(n) - n), n)]
            wanted = low[arc] * self.n + third
            spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[spot] == wanted
            for x in (low[arc[hit]], high[arc[hit]], third[hit]):
                np.add.at(count, x, 1)
            lo = hi
        return count[place]

    def back(self) -> Arcs:
        """The arcs turned round."""
        if self.turned is None:
            t = object.__new__(Arcs)
            t.ids, t.n, t.arcs, t.of, t.out = self.ids, self.n, self.arcs, self.of, self.come
            t.come, t.go = self.out, np.repeat(np.arange(self.n, dtype=np.int32), self.degree)
            t.degree = np.bincount(self.go, minlength=self.n)
            t.first = np.concatenate([[0], np.cumsum(t.degree)])
            t.turned, self.turned = self, t
        return self.turned

    def spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the arcs from nodes: places of these in `nodes`, and where they go."""
        size = self.degree[nodes]
        start = np.cumsum(size) - size
        return np.repeat(np.arange(len(nodes)), size), self.out[np.arange(int(size.sum())) + np.repeat(self.first[nodes] - start, size)]

    def met(self, front: np.ndarray, wanted: np.ndarray | None, matrix: np.ndarray, add: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (of `wanted`, a mask) that arcs reach from nodes of the front, ascending, and for each the rows of matrix added up."""
        if 8 * int(self.degree[front].sum()) < self.arcs:
            place, go = self.spread(front)
            order = np.argsort(go, kind="stable")
            come, go = front[place[order]], go[order]
            if wanted is not None:
                hit = wanted[go]
                come, go = come[hit], go[hit]
        else:
            hit = np.zeros(self.n, bool)
            hit[front] = True
            hit = hit[self.come] if wanted is None else hit[self.come] & wanted[self.go]
            come, go = self.come[hit], self.go[hit]
        width = matrix.shape[1]
        if not len(go):
            return np.empty(0, np.int64), np.empty((0, width), matrix.dtype)
        first = np.flatnonzero(np.append(True, go[1:] != go[:-1]))
        out = np.empty((len(first), width), matrix.dtype)
        bounds, most, lo = np.append(first, len(go)), max(1, CHUNK // width), 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
            if hi == lo + 1:
                # One node may have more arcs than are added up at once.
                row = add.reduce(matrix[come[bounds[lo] : min(bounds[hi], bounds[lo] + most)]], axis=0)
                for i in range(bounds[lo] + most, bounds[hi], most):
                    row = add(row, add.reduce(matrix[come[i : min(i + most, bounds[hi])]], axis=0))
                out[lo] = row
            else:
                out[lo:hi] = add.reduceat(matrix[come[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], axis=0)
            lo = hi
        return go[first].astype(np.int64), out


def _blocks(roots: np.ndarray, n: int, most: int) -> Iterator[np.ndarray]:
    width = min(most, max(8, CELLS // max(1, n)))
    for lo in range(0, len(roots), width):
        yield roots[lo : lo + width]


def _dependencies(graph: Arcs, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: sum and squares of Brandes' dependencies of the roots on it, and whether another root reaches it.

    A cell (node, root) is one number, node x roots + root. A level with few cells pushes these along their arcs; one with many
    adds up whole rows of the matrix."""
    total, squares, reached = np.zeros(graph.n), np.zeros(graph.n), np.zeros(graph.n, bool)
    back = graph.back()
    for block in _blocks(roots, graph.n, ROOTS):
        w = len(block)
        matrix = np.zeros((graph.n, w))
        flat, seen, mark = matrix.reshape(-1), np.zeros(graph.n * w, bool), np.empty(graph.n * w, np.int32)
        few = lambda arcs, rows: PUSH * int(arcs.degree[rows].sum()) < arcs.arcs * (w + 1)  # noqa: B023, E731
        cells, value = block * w + np.arange(w), np.ones(w)
        seen[cells], levels = True, []
        while len(cells):
            rows = cells // w
            levels.append((cells, value))
            if few(graph, rows):
                place, go = graph.spread(rows)
                to = go.astype(np.int64) * w + (cells - rows * w)[place]
                fresh = ~seen[to]
                to, place = to[fresh], place[fresh]
                np.add.at(flat, to, value[place])
                # Of equal targets the last one stands for all.
                mark[to] = np.arange(len(to), dtype=np.int32)
                cells = to[mark[to] == np.arange(len(to), dtype=np.int32)]
                value = flat[cells]
                flat[cells] = 0
            else:
                flat[cells] = value
                front = np.zeros(graph.n, bool)
                front[rows] = True
                ends, out = graph.met(np.flatnonzero(front), ~seen.reshape(graph.n, w).all(axis=1), matrix, np.add)
                flat[cells] = 0
                mask = (out > 0) & ~seen.reshape(graph.n, w)[ends]
                value, cells = out[mask], (ends[:, None] * w + np.arange(w))[mask]
            seen[cells] = True
        share, after = None, None
        for cells, sigma in reversed(levels[1:]):
            rows, delta = cells // w, np.zeros(len(cells))
            if share is not None:
                ahead = after // w
                if few(back, ahead):
                    place, go = back.spread(ahead)
                    to = go.astype(np.int64) * w + (after - ahead * w)[place]
                    np.add.at(flat, to, share[place])
                    delta = flat[cells] * sigma
                    flat[to] = 0
                else:
                    flat[after] = share
                    front, wanted = np.zeros(graph.n, bool), np.zeros(graph.n, bool)
                    front[ahead], wanted[rows] = True, True
                    ends, out = back.met(np.flatnonzero(front), wanted, matrix, np.add)
                    flat[after] = 0
                    spot = np.full(graph.n, -1)
                    spot[ends] = np.arange(len(ends))
                    spot, at = spot[rows], cells - rows * w
                    hit = spot >= 0
                    delta[hit] = out[spot[hit], at[hit]] * sigma[hit]
            np.add.at(total, rows, delta)
            np.add.at(squares, rows, delta * delta)
            reached[rows] = True
            share, after = (1 + delta) / sigma, cells
    return total, squares, reached


def _levels(graph: Arcs, roots: np.ndarray, depth: int | None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """block of roots, distance, nodes, bits: which roots of the block reach a node first at the distance, 64 of them a number."""
    for block in _blocks(roots, graph.n, 512):
        at = np.arange(len(block))
        fresh = np.zeros((graph.n, (len(block) + 63) // 64), np.uint64)
        np.bitwise_or.at(fresh, (block, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        old, nodes, level = fresh.copy(), np.flatnonzero(fresh.any(axis=1)), 0
        bits = fresh[nodes]
        while len(nodes):
            yield block, level, nodes, bits
            if level == depth:
                break
            ends, out = graph.met(nodes, None, fresh, np.bitwise_or)
            fresh[nodes] = 0
            out &= ~old[ends]
            some = out.any(axis=1)
            nodes, bits, level = ends[some], out[some], level + 1
            fresh[nodes] = bits
            old[nodes] |= bits


#: What a task makes of its arcs, roots and, if asked for, names (node, name).
Work = Callable[[Arcs, np.ndarray, pa.Table | None], Iterator[pa.Table]]


def dealt(arcs: DataFrame, roots: DataFrame, work: Work, schema: str, names: DataFrame | None = None, split: bool = True) -> DataFrame:
    """graph and the rows of `work` (of the schema) on every share of the roots (graph, node), or on all of a graph unless it may be
    split; arcs: packed by graph; names: packed, too, if wanted."""
    spark = arcs.sparkSession
    graphs, most = roots.agg((F.max("graph") + 1), F.count("*")).first()
    graphs = int(graphs or 1)
    # A graph goes to so many tasks that all cores have some; each has 64 roots or more.
    each = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // graphs), -(-most // (64 * graphs)))) if split else 1
    mine = packed(roots.select((F.col("graph") * each + F.pmod(F.hash("node"), F.lit(each))).alias("part"), F.col("node").alias("root")), "part", "roots", ["root"])
    shared = arcs if names is None else arcs.union(names)
    shared = shared.select(F.explode(F.sequence(F.col("key") * each, F.col("key") * each + each - 1)).alias("part"), "kind", "bytes")
    rows = shared.union(mine.select("key", "kind", "bytes")).repartitionById(graphs * each, F.col("part").cast("int"))
    kind = {f: pa.int32() for f in ("come", "go")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list(batches)
        mine, edges, held = (opened(pieces, k) for k in ("roots", "arcs", "names"))
        if mine is None:
            return
        at = pieces[0].column("part")[0].as_py() // each
        del pieces
        come, go = ((edges[f].to_numpy() if edges is not None else np.empty(0, kind[f].to_pandas_dtype())) for f in ("come", "go"))
        del edges
        ids = mine["root"].to_numpy()
        graph = Arcs(come, go, ids)
        for out in work(graph, np.unique(graph.of(ids)), held):
            yield from out.add_column(0, "graph", pa.array(np.full(len(out), at, np.int32))).combine_chunks().to_batches()

    return rows.mapInArrow(run, f"graph int, {schema}")


def dependency_rows(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """graph, node, delta, squares: a row for each node and task; nodes are numbers."""

    def work(graph: Arcs, mine: np.ndarray, _) -> Iterator[pa.Table]:
        total, squares, reached = _dependencies(graph, mine)
        yield pa.table({"node": graph.ids[reached].astype(np.int32), "delta": total[reached], "squares": squares[reached]})

    return dealt(arcs, roots, work, "node int, delta double, squares double")


def distance_rows(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """graph, node, dist, n: how many roots reach the node at a distance, a row for each task; nodes are numbers."""

    def work(graph: Arcs, mine: np.ndarray, _) -> Iterator[pa.Table]:
        counts: list[np.ndarray] = []
        for _, level, nodes, bits in _levels(graph, mine, None):
            if level == len(counts):
                counts.append(np.zeros(graph.n, np.int64))
            counts[level][nodes] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for level, n in enumerate(counts):
            some = np.flatnonzero(n)
            yield pa.table({"node": graph.ids[some].astype(np.int32), "dist": np.full(len(some), level, np.int32), "n": n[some]})

    return dealt(arcs, roots, work, "node int, dist int, n long")


def _set_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the bits that are set, by row; numbers without any cost next to nothing."""
    row, column = np.nonzero(bits)
    held = bits[row, column]
    if np.bitwise_count(held).sum(dtype=np.int64) > 8 * len(held):
        at, place = np.nonzero(np.unpackbits(held.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return row[at], column[at] * 64 + place
    rows, places = [], []
    while len(held):
        least = held & (~held + np.uint64(1))
        rows.append(row)
        places.append(column * 64 + np.bitwise_count(least - np.uint64(1)))
        held = held ^ least
        left = held != 0
        row, column, held = row[left], column[left], held[left]
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order]


def pair_rows(arcs: DataFrame, roots: DataFrame, names: DataFrame, kind: str, depth: int | None) -> DataFrame:
    """graph, root, node, dist by name, in batches; nothing is held but the block at hand. names: packed (node, name); kind: their type."""

    def work(graph: Arcs, mine: np.ndarray, held: pa.Table) -> Iterator[pa.Table]:
        at = held["node"].to_numpy()
        order = np.argsort(at)
        named = held["name"].combine_chunks().take(pa.array(order[np.searchsorted(at, graph.ids, sorter=order)]))
        for block, level, nodes, bits in _levels(graph, mine, depth):
            ends = np.cumsum(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
            lo, done = 0, 0
            while lo < len(nodes):
                hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE, "right")))
                row, place = _set_bits(bits[lo:hi])
                yield pa.table({"root": named.take(pa.array(block[place])), "node": named.take(pa.array(nodes[lo + row])), "dist": pa.array(np.full(len(row), level, np.int32))})
                lo, done = hi, int(ends[hi - 1])

    return dealt(arcs, roots, work, f"root {kind}, node {kind}, dist int", names)
