"""Brandes' dependencies from many roots at once. A graph that a task may hold is searched there (`held`); a larger one by blocks
of roots that share rows, and tiles of edges that share tasks.

There, a row (block, node) holds the roots of its block that reach the node at one level (`at`, a byte each, their places in the
block) and a number for each (`value`). A level is one shuffle: rows meet a tile of edges, block by block, and are added
up there as a matrix, so no pair of root and edge becomes a row. A tile has about `TILE` edges, so no task holds the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import held
from netlex.operators.ranks import row_ordinals

#: Roots of a block (a place is one byte), edges of a tile, and numbers of the matrix that a task adds up at once.
BLOCK, TILE, CHUNK = 128, 1 << 18, 1 << 21
#: Pairs of root and node that are searched in one wave: what a wave holds is bounded, whatever the number of roots.
WAVE = 1 << 29

_LEVEL = "block long, node int, at binary, value binary"
_KINDS = {"edges": 0, "seen": 1, "front": 2}


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _held(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row, and all rows' numbers one after another."""
    sizes, parts = [], []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        sizes.append(np.diff(ends))
        if len(chunk) and ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    joined = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return np.concatenate(sizes).astype(np.int64) // np.dtype(kind).itemsize if sizes else np.empty(0, np.int64), joined.view(kind)


def _rows(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a kind: nodes, repeated for each place; places in the block; values (none of rows seen)."""
    rows = table.filter(pc.equal(table["kind"], _KINDS[kind]))
    nodes = rows["node"].to_numpy()
    sizes, at = _held(rows["at"], np.uint8)
    return np.repeat(nodes, sizes), at, _held(rows["value"], np.float64)[1]


def _edges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """from, to of the tile's edges, by to."""
    rows = table.filter(pc.equal(table["kind"], _KINDS["edges"]))
    return _held(rows["at"], np.int32)[1], _held(rows["value"], np.int32)[1]


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that edges of this tile reach from the front, ascending, and for each the sums of the front's values by place."""
    come, go = _edges(table)
    nodes, at, value = _rows(table, "front")
    if not len(nodes):
        return np.empty(0, np.int32), np.empty((0, BLOCK))
    known, place = np.unique(nodes, return_inverse=True)
    matrix = np.zeros((len(known), BLOCK))
    matrix[place, at] = value
    spot = np.minimum(np.searchsorted(known, come), len(known) - 1)
    hit = known[spot] == come
    spot, go = spot[hit], go[hit]
    ends, first = np.unique(go, return_index=True)
    out = np.empty((len(ends), BLOCK))
    bounds, most = np.append(first, len(go)), max(1, CHUNK // BLOCK)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        if hi == lo + 1:
            # One node may have more edges than fit at once.
            out[lo] = sum(matrix[spot[i : min(i + most, bounds[hi])]].sum(axis=0) for i in range(bounds[lo], bounds[hi], most))
        else:
            out[lo:hi] = np.add.reduceat(matrix[spot[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], axis=0)
        lo = hi
    return ends, out


def _of_matrix(block: int, nodes: np.ndarray, mask: np.ndarray, matrix: np.ndarray) -> dict:
    """Columns of _LEVEL: a row for each node with a place in mask."""
    sizes = mask.sum(axis=1)
    kept = sizes > 0
    ends = np.concatenate([[0], np.cumsum(sizes[kept])])
    at = np.nonzero(mask)[1].astype(np.uint8)
    return {"block": pa.array(np.full(int(kept.sum()), block), pa.int64()), "node": pa.array(nodes[kept].astype(np.int32)), "at": _binary(ends, at), "value": _binary(ends * 8, matrix[mask])}


def _forward(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Numbers of shortest paths to the nodes of a tile that the front reaches first."""
    ends, out = _sums(table)
    mask = out > 0
    nodes, at, _ = _rows(table, "seen")
    if len(ends) and len(nodes):
        spot = np.minimum(np.searchsorted(ends, nodes), len(ends) - 1)
        hit = ends[spot] == nodes
        mask[spot[hit], at[hit]] = False
    return pa.table(_of_matrix(key[0].as_py(), ends, mask, out))


def _backward(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What roots' paths hand to the rows seen (values: numbers of paths) from the front (values: shares); also its sum and squares by node."""
    ends, out = _sums(table)
    nodes, at, sigma = _rows(table, "seen")
    delta = np.zeros(len(nodes))
    if len(ends):
        spot = np.minimum(np.searchsorted(ends, nodes), len(ends) - 1)
        delta = np.where(ends[spot] == nodes, out[spot, at], 0.0) * sigma
    # The next front is (1 + delta) / sigma.
    known, place = np.unique(nodes, return_inverse=True)
    share, mask = np.zeros((len(known), BLOCK)), np.zeros((len(known), BLOCK), bool)
    share[place, at], mask[place, at] = (1 + delta) / sigma, True
    total, squares = (np.bincount(place, x, len(known)).astype(float) for x in (delta, delta * delta))
    return pa.table(_of_matrix(key[0].as_py(), known, mask, share) | {"delta": pa.array(total), "squares": pa.array(squares)})


def _pack(table: pa.Table) -> pa.Table:
    """A tile's edges as one row, ordered by their ends."""
    come, go = table["come"].to_numpy(), table["go"].to_numpy()
    order = np.lexsort((come, go))
    pack = lambda x: pa.array([x[order].astype(np.int32).tobytes()], pa.binary())
    return pa.table({"tile": table["tile"].slice(0, 1).combine_chunks(), "at": pack(come), "value": pack(go)})


def _tiles(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tile, at, value): edges come -> go, packed; (node, tile): where a node's incoming edges lie; (node, tile): where its outgoing ones do."""
    placed = row_ordinals(edges, [F.asc("go"), F.asc("come")], "i")
    home = settle(placed.groupBy("go").agg(F.floor(F.min("i") / TILE).cast("int").alias("tile")))
    rows = settle(edges.join(home, "go"))
    away = settle(rows.select(F.col("come").alias("node"), "tile").distinct())
    return settle(rows.groupBy("tile").applyInArrow(_pack, "tile int, at binary, value binary")), home.select(F.col("go").alias("node"), "tile"), away


def _met(tiles: tuple[DataFrame, DataFrame, DataFrame], seen: DataFrame, front: DataFrame, lone: bool) -> DataFrame:
    """block, tile, kind, node, at, value: what a step groups by (block, tile); lone: rows seen without a front stay."""
    packed, home, away = tiles
    columns = ["block", "tile", "kind", "node", "at", "value"]
    kind = lambda k: F.lit(_KINDS[k]).alias("kind")
    ahead = front.join(away, "node").withColumn("kind", kind("front")).select(columns)
    wanted = ahead.select("block", "tile").distinct()
    edges = packed.join(wanted, "tile").select("block", "tile", kind("edges"), F.lit(None).cast("int").alias("node"), "at", "value")
    old = seen.join(home, "node", "left" if lone else "inner").withColumn("tile", F.coalesce("tile", F.lit(0)))
    old = old if lone else old.join(wanted, ["block", "tile"], "left_semi")
    return ahead.union(edges).union(old.withColumn("kind", kind("seen")).select(columns))


def _wave(forth, back, both: bool, roots: DataFrame) -> DataFrame | None:
    """node, delta, squares of the roots (_LEVEL rows of distance 0), a row for each block and node.

    Where each edge stands both ways round (`both`), what a level meets again lies in it or in the one before, so a step reads
    two levels and not all that was seen."""
    bare = lambda level: level.withColumn("value", F.lit(None).cast("binary"))
    levels, seen = [roots], bare(roots)
    while True:
        fresh = settle(_met(forth, seen, levels[-1], False).groupBy("block", "tile").applyInArrow(_forward, _LEVEL))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = (bare(levels[-2]) if both else seen).union(bare(fresh))
        if len(levels) % 8 == 0 and not both:
            seen = settle(seen)
    out, front = None, levels[-1].limit(0)
    for level in reversed(levels[1:]):
        here = settle(_met(back, level, front, True).groupBy("block", "tile").applyInArrow(_backward, f"{_LEVEL}, delta double, squares double"))
        rows, front = here.select("node", "delta", "squares"), here.select("block", "node", "at", "value")
        out = rows if out is None else out.union(rows)
    return out


def laid_out(edges: DataFrame, nodes: DataFrame) -> tuple:
    """Names of the nodes, and what sums from any of `nodes` (node) over the same edges can share: packed arcs if a task may hold
    the graph; otherwise none, but tiles of the edges in both directions (the same if each edge stands both ways round), and whether
    they are the same. With a column `graph` (0, 1, ...) in both, each graph stands for itself."""
    keyed = lambda df: df if "graph" in df.columns else df.withColumn("graph", F.lit(0))
    names, arcs = held.named_arcs(keyed(edges), keyed(nodes))
    if BLOCK * names.count() <= WAVE and held.fits(names, arcs):
        return names, held.packed(arcs, "graph", "arcs", ["go", "come"]), None, None, False
    arcs = settle(arcs.select("come", "go"))
    turned = arcs.select(F.col("go").alias("come"), F.col("come").alias("go"))
    both, forth = turned.join(arcs, ["come", "go"], "left_anti").isEmpty(), _tiles(arcs)
    return names, None, forth, forth if both else _tiles(turned), both


def dependency_sums(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, delta, squares: sums over `roots` (node) of Brandes' dependency of a root on the node, and of its square; roots
    reach along src -> dst, a root has none on itself, and nodes that are no root's other node have no row. With a column `graph`
    (0, 1, ...) in both, each graph stands for itself, and the rows have it, too.

    Forward, rows carry the number of shortest paths; backward, a level's rows hand their share to the one before."""
    return sums_from(laid_out(edges, roots), roots)


def sums_from(layout: tuple, roots: DataFrame) -> DataFrame:
    """dependency_sums over edges laid out before, with `roots` among their nodes."""
    names, whole, forth, back, both = layout
    keys = ["graph"] if "graph" in roots.columns else []
    starts = held.numbered(names, roots.select(*keys, "node").distinct(), "node", "id", tuple(keys))
    if whole is not None:
        total = held.dependency_rows(whole, starts.select(*(keys or [F.lit(0).alias("graph")]), F.col("id").alias("node")))
        return _named(total, names, keys)
    placed = row_ordinals(starts.select("id"), [F.asc("id")], "i")
    byte, one = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0")), F.lit(bytearray(np.float64(1).tobytes()))
    starts = settle(placed.select(F.floor(F.col("i") / BLOCK).alias("block"), F.col("id").alias("node"), byte(F.col("i") % BLOCK).alias("at"), one.alias("value")))
    blocks = (starts.count() + BLOCK - 1) // BLOCK
    step = max(1, WAVE // BLOCK // max(1, names.count()))
    total = None
    for first in range(0, blocks, step):
        rows = _wave(forth, back, both, starts.filter((F.col("block") >= first) & (F.col("block") < first + step)))
        if rows is not None:
            rows = settle(rows.groupBy("node").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares")))
            total = rows if total is None else total.union(rows)
    if total is None:
        total = names.limit(0).select("node", F.lit(0.0).alias("delta"), F.lit(0.0).alias("squares"))
    return _named(total, names, keys)


def _named(total: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    sums = total.groupBy("node").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares"))
    return sums.join(names, "node").select(*keys, F.col("name").alias("node"), "delta", "squares")
