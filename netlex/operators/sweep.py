"""Threshold sweeps, merges and removals, all answered from one spanning forest; significance backbone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import held
from netlex.operators.components import star_labels
from netlex.operators.graph import strength
from netlex.operators.ranks import row_ordinals
from netlex.operators.traverse import component_sizes


def spanning_forest(scored: DataFrame) -> DataFrame:
    """(a, b, score) -> the edges of the minimum spanning forest by (score, a, b), with `tree` (least node of the final
    component), by Boruvka rounds: every component takes its least outgoing edge, so each round at least halves their number."""
    key = F.struct("score", "a", "b")
    edges = settle(scored.select("a", "b", "score").filter("a <> b").distinct())
    labels = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    forest = None
    while True:
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").filter("ca <> cb")
        live = settle(ends.select("a", "b", "score", "ca", "cb"))
        if live.isEmpty():
            break
        both = live.select(F.col("ca").alias("c"), key.alias("k")).union(live.select(F.col("cb"), key))
        best = both.groupBy("c").agg(F.min("k").alias("k")).select("k.*").distinct()
        picked = settle(live.join(best, ["a", "b", "score"]))
        forest = picked.select("a", "b", "score") if forest is None else forest.union(picked.select("a", "b", "score"))
        merged = star_labels(picked.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("was"), F.col("comp").alias("new")).withColumnRenamed("was", "comp")
        labels = settle(labels.join(merged, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))
        edges = live.select("a", "b", "score")
    if forest is None:
        return edges.withColumn("tree", F.col("a")).limit(0)
    return forest.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("tree")), "a").select("a", "b", "score", "tree")


#: Merges that are replayed in one task.
RANGE = 100_000


def _replay(frame: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the edges of one range in ascending order; `ca`, `cb` name the components that the range starts with, `na`,
    `nb` their sizes."""
    frame = frame.sort_values("at", kind="stable")
    parent: dict = {}
    size: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes_a, sizes_b = [], []
    for a, b, n, m in zip(frame["ca"], frame["cb"], frame["na"], frame["nb"], strict=True):
        x, y = find(a), find(b)
        n, m = size.get(x, n), size.get(y, m)
        sizes_a.append(n)
        sizes_b.append(m)
        parent[y] = x
        size[x] = n + m
    return frame[["a", "b", "score"]].assign(size_a=sizes_a, size_b=sizes_b)


def merge_events(scored: DataFrame, most: int = RANGE) -> DataFrame:
    """a, b, score, size_a, size_b, min_size: every merge of components in ascending (score, a, b).

    A reconstruction by ranges: the forest's edges are cut in half by their order; what the lower half joins becomes one node with a
    size in the upper half, and so on with both halves at once, until no range has more than `most` edges. Ranges are then replayed
    apart. All ranges of a level are one job, and there are log2(edges / most) levels."""
    forest = row_ordinals(spanning_forest(scored).drop("tree"), [F.asc("score"), F.asc("a"), F.asc("b")], "at")
    one = F.lit(1).cast("long")
    rows = settle(forest.select("*", F.col("a").alias("ca"), F.col("b").alias("cb"), one.alias("na"), one.alias("nb"), F.lit(0).cast("long").alias("part")))
    half = 1
    while half * most < rows.count():
        half *= 2
    while half > 1:
        half //= 2
        upper = F.pmod(F.floor(F.col("at") / (half * most)), F.lit(2)) == 1
        lower = rows.filter(~upper)
        key = lambda c: F.struct("part", F.col(c).alias("node"))
        labels = star_labels(lower.select(key("ca").alias("a"), key("cb").alias("b")))
        sizes = lower.select(key("ca").alias("node"), F.col("na").alias("n")).union(lower.select(key("cb"), "nb")).distinct()
        held = labels.join(sizes, "node")
        joined = settle(held.select("node", "comp").join(held.groupBy("comp").agg(F.sum("n").alias("size")), "comp").select(F.col("node.part").alias("part"), F.col("node.node").alias("was"), F.col("comp.node").alias("now"), "size"))
        above = rows.filter(upper)
        for c, n in (("ca", "na"), ("cb", "nb")):
            found = joined.select("part", F.col("was").alias(c), "now", "size")
            above = above.join(found, ["part", c], "left").withColumns({c: F.coalesce("now", c), n: F.coalesce("size", n)}).drop("now", "size")
        part = lambda df, x: df.withColumn("part", F.col("part") * 2 + x).select(rows.columns)
        rows = settle(part(lower, 0).union(part(above, 1)))
    kind = dict(forest.dtypes)
    schema = f"a {kind['a']}, b {kind['b']}, score {kind['score']}, size_a long, size_b long"
    return rows.groupBy("part").applyInPandas(lambda f: _replay(f), schema).withColumn("min_size", F.least("size_a", "size_b"))


def _cell(grid: list[float]):
    """The place in the sorted grid of the first point above the score; null if there is none."""
    first = F.array_min(F.filter(F.array(*[F.lit(float(t)) for t in sorted(grid)]), lambda t: t > F.col("score")))
    return F.array_position(F.array(*[F.lit(float(t)) for t in sorted(set(grid))]), first).cast("int") - 1


def _points(scored: DataFrame, grid: list[float]) -> DataFrame:
    """t, cell: the grid's points, each as often as it is given."""
    at = {float(t): i for i, t in enumerate(sorted(set(grid)))}
    return scored.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(at[float(t)]).alias("cell")) for t in grid])))


def threshold_edges(scored: DataFrame, grid: list[float]) -> DataFrame:
    """t, edges (score < t) for each grid point; edges are only counted."""
    counts = scored.filter("a <> b").groupBy(_cell(grid).alias("cell")).agg(F.count("*").alias("edges")).filter("cell is not null")
    upto = Window.orderBy("cell").rangeBetween(Window.unboundedPreceding, 0)
    rows = _points(scored, grid).join(counts, "cell", "left")
    each = rows.groupBy("cell").agg(F.first("edges").alias("edges")).select("cell", F.coalesce(F.sum("edges").over(upto), F.lit(0)).alias("edges"))
    return rows.select("t", "cell").join(each, "cell").select("t", "edges")


def _giants(edges: DataFrame, cells: int) -> DataFrame:
    """edges (a, b, cell) -> cell, giant: the largest of the components that a cell's edges make, together with those of all cells
    before, out of nodes that they touch.

    As the ranges of merge_events, but over cells: what the lower half of the cells joins becomes one node with a size in the upper
    half, where edges inside a node go, and so on with both halves at once, down to single cells. No forest is needed."""
    one = F.lit(1).cast("long")
    rows = settle(edges.select("cell", F.col("a").alias("ca"), F.col("b").alias("cb"), one.alias("na"), one.alias("nb"), F.lit(0).cast("long").alias("part")))
    key = lambda c: F.struct("part", F.col(c).alias("node"))

    def joined(lower: DataFrame) -> DataFrame:
        """part, was, now, size: a part's nodes, the component of each, and how much that holds."""
        labels = star_labels(lower.select(key("ca").alias("a"), key("cb").alias("b")))
        sizes = lower.select(key("ca").alias("node"), F.col("na").alias("n")).union(lower.select(key("cb"), "nb")).distinct()
        held = settle(labels.join(sizes, "node"))
        whole = held.groupBy("comp").agg(F.sum("n").alias("size"))
        return held.select("node", "comp").join(whole, "comp").select(F.col("node.part").alias("part"), F.col("node.node").alias("was"), F.col("comp.node").alias("now"), "size")

    half = 1
    while half < cells:
        half *= 2
    while half > 1:
        half //= 2
        upper = F.pmod(F.floor(F.col("cell") / half), F.lit(2)) == 1
        lower, above = rows.filter(~upper), rows.filter(upper)
        found = settle(joined(lower))
        for c, n in (("ca", "na"), ("cb", "nb")):
            above = above.join(found.withColumnRenamed("was", c), ["part", c], "left").withColumns({c: F.coalesce("now", c), n: F.coalesce("size", n)}).drop("now", "size")
        part = lambda df, x: df.withColumn("part", F.col("part") * 2 + x).select(rows.columns)
        # Edges between the same two nodes are one; the cell tells nothing more than the part in the end.
        rows = settle(part(lower, 0).union(part(above.filter("ca <> cb"), 1)).distinct())
    return joined(rows).groupBy(F.col("part").cast("int").alias("cell")).agg(F.max("size").alias("giant"))


def _numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return at[: len(a)], at[len(a) :], len(ids)


def forest_of(a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of least cells, by Boruvka rounds."""
    order = np.argsort(cell, kind="stable")
    a, b, n = _numbers(a[order], b[order])
    comp, live, kept = np.arange(n), np.arange(len(a)), []
    while True:
        u, v = comp[a[live]], comp[b[live]]
        apart = u != v
        u, v, live = u[apart], v[apart], live[apart]
        if not len(live):
            return order[np.concatenate(kept)] if kept else order[:0]
        best = np.full(n, len(a))
        np.minimum.at(best, u, live)
        np.minimum.at(best, v, live)
        roots = np.flatnonzero(best < len(a))
        edge, parent = best[roots], np.arange(n)
        kept.append(np.unique(edge))
        parent[roots] = comp[a[edge]] + comp[b[edge]] - roots
        # Two that take the same edge point at each other.
        both = roots[(parent[parent[roots]] == roots) & (roots < parent[roots])]
        parent[both] = both
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]


def giants_of(a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells, ascending, and the size of the largest component of the edges up to each."""
    a, b, n = _numbers(a, b)
    label, size, giants = np.arange(n), np.ones(n, np.int64), []
    cells = np.unique(cell)
    for c in cells:
        u, v = label[a[cell == c]], label[b[cell == c]]
        ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y = at[: len(u)], at[len(u) :]
        graph = held.Arcs(np.concatenate([x, y]), np.concatenate([y, x]), np.arange(len(ends)))
        now, moved = ends[graph.components()], np.arange(n)
        moved[ends] = now
        gone = ends[now != ends]
        np.add.at(size, moved[gone], size[gone])
        size[gone] = 0
        label = moved[label]
        giants.append(int(size.max()))
    return cells, np.array(giants, np.int64)


#: Edges of a task that makes them a forest, at first.
FOREST = 1 << 21


def _edges_of(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    rows = list(batches)
    return [np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows]) for c in ("a", "b", "cell")] if rows else None


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _edges_of(batches)
    if found:
        kept = forest_of(*found)
        yield from pa.table([x[kept] for x in found], ["a", "b", "cell"]).to_batches(max_chunksize=1 << 16)


def _whole_giants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _edges_of(batches)
    if found:
        cells, giants = giants_of(*found)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(giants)], ["cell", "giant"])


def _cell_giants(edges: DataFrame, cells: int) -> DataFrame:
    """_giants, of fewer edges: what parts of the edges join, a forest of each part joins as well. Parts are ranges of a, each held by
    a task, and grow until one holds all that is left; where forests no longer get fewer, _giants goes on with them."""
    kind, n, most = edges.schema["a"].dataType.simpleString(), edges.count(), FOREST
    if kind not in ("int", "bigint"):
        return _giants(edges, cells)
    while n > most:
        parts = -(-n // most)
        edges = settle(edges.repartitionByRange(parts, "a", "b").mapInArrow(_forests, f"a {kind}, b {kind}, cell int"))
        left = edges.count()
        if left > 0.9 * n and most >= held.HELD // 2:
            return _giants(edges, cells)
        n, most = left, min(2 * most, held.HELD // 2)
    return edges.repartition(1).mapInArrow(_whole_giants, "cell int, giant long")


def threshold_sweep(scored: DataFrame, grid: list[float]) -> DataFrame:
    """t, edges (score < t), giant (largest component's nodes; 0 without edges) for each grid point."""
    cells = settle(scored.filter("a <> b").select("a", "b", _cell(grid).alias("cell")).filter("cell is not null"))
    # Each score counts from the first grid point above it; running sums and maxima do the rest.
    edges = cells.groupBy("cell").agg(F.count("*").alias("edges"))
    rows = _points(scored, grid).join(edges, "cell", "left").join(_cell_giants(cells, len(set(grid))), "cell", "left")
    upto = Window.orderBy("cell").rangeBetween(Window.unboundedPreceding, 0)
    each = rows.groupBy("cell").agg(F.first("edges").alias("edges"), F.first("giant").alias("giant"))
    each = each.select("cell", F.coalesce(F.sum("edges").over(upto), F.lit(0)).alias("edges"), F.coalesce(F.max("giant").over(upto), F.lit(0)).alias("giant"))
    return rows.select("t", "cell").join(each, "cell").select("t", "edges", "giant")


def critical_threshold(sweep: DataFrame, drop: float = 0.15) -> DataFrame:
    """The greatest grid point at which, going down, the giant's share falls by more than `drop` of the whole."""
    w = Window.orderBy(F.desc("t"))
    rows = sweep.withColumn("share", F.try_divide("giant", F.max("giant").over(Window.partitionBy())))
    falls = rows.withColumn("fall", F.lag("share").over(w) - F.col("share")).filter(F.col("fall") > drop)
    return falls.orderBy(F.desc("t")).limit(1).select("t", "fall")


def disparity_alpha(pairs: DataFrame) -> DataFrame:
    """a, b, weight, alpha: least of (1 - w/s)^(k - 1) at both ends; an end with one link gives 0."""
    ends = strength(pairs)
    of = lambda end: ends.select(F.col("node").alias(end), F.col("strength").alias(f"s_{end}"), F.col("deg").alias(f"k_{end}"))
    alpha = lambda e: F.when(F.col(f"k_{e}") <= 1, F.lit(0.0)).otherwise(F.pow(1 - F.col("weight") / F.col(f"s_{e}"), F.col(f"k_{e}") - 1))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "weight", F.least(alpha("a"), alpha("b")).alias("alpha"))


def backbone(scored: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(kept edges with alpha < threshold, their touched nodes with comp and size)."""
    kept = settle(scored.filter(F.col("alpha") < threshold))
    nodes = kept.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return kept, component_sizes(kept.select("a", "b"), nodes)


def backbone_report(scored: DataFrame, threshold: float) -> DataFrame:
    """kept, kept_share, nodes, giant, giant_share."""
    kept, sized = backbone(scored, threshold)
    total = scored.agg(F.count("*").alias("edges")).crossJoin(kept.agg(F.count("*").alias("kept")))
    parts = sized.agg(F.count("*").alias("nodes"), F.coalesce(F.max("size"), F.lit(0)).alias("giant"))
    rows = total.crossJoin(parts)
    return rows.select("kept", F.try_divide("kept", "edges").alias("kept_share"), "nodes", "giant", F.coalesce(F.try_divide("giant", "nodes"), F.lit(0.0)).alias("giant_share"))


def backbone_nodes(pairs: DataFrame, threshold: float, top: int | None = None) -> DataFrame:
    """node, strength, deg, in_giant of the nodes that the backbone touches; the `top` of highest degree, if given."""
    _, sized = backbone(disparity_alpha(pairs), threshold)
    giant = sized.orderBy(F.desc("size"), "comp").limit(1).select("comp").withColumn("in_giant", F.lit(True))
    rows = sized.join(F.broadcast(giant), "comp", "left").join(strength(pairs), "node")
    rows = rows.select("node", "strength", "deg", F.coalesce("in_giant", F.lit(False)).alias("in_giant"))
    return rows if top is None else rows.orderBy(F.desc("deg"), "node").limit(top)


def removal_curve(pairs: DataFrame, order: DataFrame, steps: int) -> DataFrame:
    """step (0..steps), giant_frac: largest component over survivors after removing the first `step` nodes of `order`
    (node, place from 1). An edge lives until its first end goes; read backwards, removals are merges."""
    places = order.filter(F.col("place") <= steps)
    of = lambda end: places.select(F.col("node").alias(end), F.col("place").alias(f"p_{end}"))
    lived = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    life = F.least(F.coalesce("p_a", F.lit(steps + 1)), F.coalesce("p_b", F.lit(steps + 1)))
    scored = lived.select("a", "b", (-life).cast("double").alias("score"))
    # At step s all edges with life > s stand, that is score < -s.
    sweep = threshold_sweep(scored, [float(-s) for s in range(steps + 1)])
    total = order.agg(F.count("*").alias("n"))
    rows = sweep.select((-F.col("t")).cast("int").alias("step"), "giant").crossJoin(F.broadcast(total))
    alone = F.when(F.col("n") > F.col("step"), F.greatest("giant", F.lit(1))).otherwise(F.lit(0))
    return rows.select("step", F.coalesce(F.try_divide(alone, F.col("n") - F.col("step")), F.lit(0.0)).alias("giant_frac"))


def compare_removals(pairs: DataFrame, orders: dict[str, DataFrame], steps: int) -> DataFrame:
    """name, first_below_half (null if never), end_frac: one row an order."""
    out = None
    for name, order in orders.items():
        curve = removal_curve(pairs, order, steps)
        row = curve.agg(F.min(F.when(F.col("giant_frac") < 0.5, F.col("step"))).alias("first_below_half"), F.max_by("giant_frac", "step").alias("end_frac")).select(F.lit(name).alias("name"), "first_below_half", "end_frac")
        out = row if out is None else out.union(row)
    return out


def removal_gap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Largest difference of two removal curves."""
    return one.join(two.withColumnRenamed("giant_frac", "other"), "step").agg(F.max(F.abs(F.col("giant_frac") - F.col("other"))).alias("max_gap"))


def worst_single_removal(pairs: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate, giant_share among the rest, smallest first: components of every candidate's graph in one run, keyed by
    (candidate, node)."""
    spark_pairs = pairs.select("a", "b").crossJoin(F.broadcast(candidates.select(F.col("node").alias("gone")))).filter("a <> gone and b <> gone")
    keyed = spark_pairs.select(F.struct("gone", F.col("a").alias("node")).alias("a"), F.struct("gone", F.col("b").alias("node")).alias("b"))
    sizes = star_labels(keyed).groupBy("comp").agg(F.count("*").alias("size")).groupBy(F.col("comp.gone").alias("node")).agg(F.max("size").alias("giant"))
    n = nodes.select("node").distinct().agg((F.count("*") - 1).alias("n"))
    rows = candidates.select("node").join(sizes, "node", "left").crossJoin(F.broadcast(n))
    return rows.select("node", F.try_divide(F.coalesce("giant", F.lit(1)), "n").alias("giant_share"))

