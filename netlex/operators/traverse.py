"""Breadth-first search from many roots at once, paths, and the centralities that rest on them.

All roots share one frontier. A driver loop reads one count a level and cuts lineage by checkpoints.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.functions.shared import settle
from netlex.operators import held
from netlex.operators.components import components
from netlex.operators.flow import dependency_sums, laid_out, sums_from
from netlex.operators.ranks import row_ordinals


def component_sizes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp, size."""
    comp = components(pairs, nodes)
    return comp.join(comp.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("node", "comp", "size")


def ranked_components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp, size, place: 1 for the largest component, ties by least node. The ranking is over components."""
    sized = component_sizes(pairs, nodes)
    order = row_ordinals(sized.select("comp", "size").distinct(), [F.desc("size"), F.asc("comp")], "place")
    return sized.join(order.select("comp", (F.col("place") + 1).alias("place")), "comp").select("node", "comp", "size", "place")


def giant(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the largest component."""
    sized = component_sizes(pairs, nodes)
    top = sized.orderBy(F.desc("size"), "comp").limit(1).select("comp")
    return sized.join(F.broadcast(top), "comp", "left_semi").select("node")


def component_report(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """components, giant, clusters (of two or more beyond the giant), isolated, outside_share."""
    sizes = components(pairs, nodes).groupBy("comp").agg(F.count("*").alias("size"))
    agg = sizes.agg(F.count("*").alias("components"), F.max("size").alias("giant"), F.count_if(F.col("size") > 1).alias("several"), F.count_if(F.col("size") == 1).alias("isolated"), F.sum("size").alias("n"))
    return agg.select("components", "giant", F.greatest(F.col("several") - 1, F.lit(0)).cast("long").alias("clusters"), "isolated", F.try_divide(F.col("n") - F.col("giant"), "n").alias("outside_share"))


def outside_giant(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp, size of the nodes that are not in the largest component."""
    return ranked_components(pairs, nodes).filter("place > 1").select("node", "comp", "size")


#: Roots of one block: their search shares a row, one bit each. Up to FEW roots are searched by shuffles at any size: they make no
#: more than four rows a node, and no task needs the graph.
BITS, FEW = 64, 256


def _search(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(block, node, dist, bits) and (block, bit, root): a row (block, node) holds the roots of a block of BITS that have
    reached the node as bits, so a level joins and shuffles up to BITS times fewer rows than there are pairs."""
    e = settle(edges.select("src", "dst").distinct())
    places = row_ordinals(roots.select(F.col("node").alias("root")).filter("root is not null").distinct(), [F.asc("root")], "at")
    placed = settle(places.select(F.floor(F.col("at") / BITS).alias("block"), F.expr(f"shiftleft(1L, cast(at % {BITS} as int))").alias("bit"), "root"))
    none = F.lit(0).cast("long")
    # fresh: roots that reach the node at this level; old: those that reached it before.
    state = settle(placed.select("block", F.col("root").alias("node"), F.col("bit").alias("fresh"), none.alias("old")))
    rows = lambda level: state.filter("fresh <> 0").select("block", "node", F.lit(level).alias("dist"), F.col("fresh").alias("bits"))
    found, level = rows(0), 0
    while max_depth is None or level < max_depth:
        level += 1
        step = state.filter("fresh <> 0").select("block", F.col("node").alias("src"), "fresh").join(e, "src").groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("fresh").alias("fresh"))
        both = step.select("block", "node", "fresh", none.alias("old")).union(state.select("block", "node", none, F.col("old").bitwiseOR(F.col("fresh"))))
        both = both.groupBy("block", "node").agg(F.bit_or("fresh").alias("fresh"), F.bit_or("old").alias("old"))
        state = settle(both.select("block", "node", F.col("fresh").bitwiseAND(F.bitwise_not("old")).alias("fresh"), "old"))
        if state.filter("fresh <> 0").isEmpty():
            break
        found = settle(found.union(rows(level))) if level % 4 == 0 else found.union(rows(level))
    return found, placed


def _held(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Names, packed arcs and numbers of the roots (graph, node), if they are more than FEW and a task may hold the graph."""
    keyed = lambda df: df if "graph" in df.columns else df.withColumn("graph", F.lit(0))
    roots = keyed(roots).select("graph", "node").filter("node is not null").distinct()
    if roots.limit(FEW + 1).count() <= FEW and "graph" not in edges.columns:
        return None
    names, arcs = held.named_arcs(keyed(edges), roots)
    if not held.fits(names, arcs):
        return None
    return names, held.packed(arcs, "graph", "arcs", ["go", "come"]), held.numbered(names, roots, "node", "id", ("graph",)).select("graph", F.col("id").alias("node"))


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, dist along src -> dst; a root reaches itself at 0; what is not reached is absent.

    Pairs are told apart only in the result, which tasks that hold the graph make as it is read."""
    whole = _held(edges, roots)
    if whole is not None:
        names, arcs, starts = whole
        return held.pair_rows(arcs, starts, held.packed(names, "graph", "names", ["node"]), roots.schema["node"].dataType.simpleString(), max_depth).drop("graph")
    found, placed = _search(edges, roots, max_depth)
    names = placed.groupBy("block").agg(F.collect_list(F.struct("bit", "root")).alias("names"))
    of = F.filter("names", lambda x: F.col("bits").bitwiseAND(x["bit"]) != 0)
    return found.join(names, "block").select(F.explode(of).alias("x"), "node", "dist").select("x.root", "node", "dist")


def distance_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, dist, n: as bfs, but only how many roots reach the node at a distance; there is no row for a pair. With a column `graph`
    (0, 1, ...) in both, each graph stands for itself, and the rows have it, too."""
    keys = ["graph"] if "graph" in roots.columns else []
    whole = _held(edges, roots)
    if whole is not None:
        names, arcs, starts = whole
        rows = held.distance_rows(arcs, starts).groupBy("node", "dist").agg(F.sum("n").alias("n"))
        return rows.join(names, "node").select(*keys, F.col("name").alias("node"), "dist", "n")
    if keys:
        of = lambda c: F.struct("graph", F.col(c).alias("node"))
        edges, roots = edges.select(of("src").alias("src"), of("dst").alias("dst")), roots.filter("node is not null").select(of("node").alias("node"))
    rows = _search(edges, roots)[0].groupBy("node", "dist").agg(F.sum(F.bit_count("bits")).alias("n"))
    return rows.select("node.graph", "node.node", "dist", "n") if keys else rows


def reach_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, dist, n: how many nodes each of `nodes` reaches at a distance along src -> dst, itself at 0, if all ends are among them."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return distance_counts(turned, nodes).select(F.col("node").alias("root"), "dist", "n")


def _times(dist: DataFrame):
    """How many pairs a row stands for: one of bfs one, one of reach_counts n."""
    return F.col("n") if "n" in dist.columns else F.lit(1).cast("long")


def shortest_path(edges: DataFrame, start, end, max_depth: int | None = None) -> DataFrame:
    """One row: path (array, null if there is none), reached (nodes reached from start, within max_depth hops if that is given).

    Of several shortest paths, the one whose nodes are least, read from the end."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    one = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("node"))
    seen = settle(bfs(e, one(start), max_depth).select("node", "dist"))
    reached = seen.agg(F.count("*").alias("reached"))
    at = one(end).join(seen, "node").select("node", "dist", F.array("node").alias("path"))
    depth = at.agg(F.max("dist")).first()[0] or 0
    for level in range(depth - 1, -1, -1):
        before = seen.filter(F.col("dist") == level).select(F.col("node").alias("src"))
        step = at.select(F.col("node").alias("dst"), "path").join(e, "dst").join(before, "src").groupBy().agg(F.min(F.struct("src", "path")).alias("x"))
        at = settle(step.select(F.col("x.src").alias("node"), F.concat(F.array("x.src"), "x.path").alias("path")))
    return reached.crossJoin(at.agg(F.max("path").alias("path"))).select("path", "reached")


def distance_summary(dist: DataFrame) -> DataFrame:
    """avg_path and diameter over ordered reachable pairs; dist: of bfs or reach_counts, here and below."""
    n = _times(dist)
    return dist.filter("dist > 0").agg((F.sum(F.col("dist") * n) / F.sum(n)).alias("avg_path"), F.max("dist").alias("diameter"))


def eccentricity(dist: DataFrame) -> DataFrame:
    return dist.groupBy(F.col("root").alias("node")).agg(F.max("dist").alias("ecc"))


def reach(edges: DataFrame, hub: DataFrame, nodes: DataFrame) -> DataFrame:
    """From the hub (one node): furthest distance, nodes there, reached (without the hub), unreachable."""
    dist = bfs(edges, hub).filter("dist > 0").groupBy("dist").agg(F.count("*").alias("n"))
    far = dist.agg(F.coalesce(F.max("dist"), F.lit(0)).alias("furthest"), F.coalesce(F.max_by("n", "dist"), F.lit(0)).alias("nodes_there"), F.coalesce(F.sum("n"), F.lit(0)).alias("reached"))
    return far.crossJoin(nodes.agg(F.countDistinct("node").alias("n"))).select("furthest", "nodes_there", "reached", (F.col("n") - 1 - F.col("reached")).alias("unreachable"))


def distance_ring(edges: DataFrame, root: DataFrame, d: int, exclude: DataFrame) -> DataFrame:
    return bfs(edges, root, d).filter(F.col("dist") == d).select("node").join(exclude.select("node"), "node", "left_anti")


#: Upper bounds of distance over eccentricity, and their labels.
BANDS = [(0.18, "core"), (0.38, "close"), (0.58, "near"), (0.78, "far"), (0.92, "remote")]


def distance_bands(dist: DataFrame, ecc: DataFrame) -> DataFrame:
    """dist with band: seven labels by dist over the root's eccentricity."""
    x = F.try_divide("dist", "ecc")
    band = F.when(F.col("dist") == 0, "here")
    for bound, label in BANDS:
        band = band.when(x <= bound, label)
    return dist.join(ecc.withColumnRenamed("node", "root"), "root").select(*dist.columns, band.otherwise("edge").alias("band"))


def closeness(dist: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, closeness (scaled by the reached share), harmonic; both over n - 1 other nodes."""
    n = nodes.select("node").distinct().agg(F.count("*").alias("n"))
    m = _times(dist)
    sums = dist.filter("dist > 0").groupBy(F.col("root").alias("node")).agg(F.sum(m).alias("r"), F.sum(F.col("dist") * m).alias("far"), F.sum(m / F.col("dist")).alias("inv"))
    rows = nodes.select("node").distinct().join(sums, "node", "left").crossJoin(F.broadcast(n))
    close = F.try_divide(F.col("r") * F.col("r"), F.col("far") * (F.col("n") - 1))
    return rows.select("node", F.coalesce(close, F.lit(0.0)).alias("closeness"), F.coalesce(F.try_divide("inv", F.col("n") - 1), F.lit(0.0)).alias("harmonic"))


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, betweenness over ordered sources, ends excluded, over (n - 1)(n - 2). For an undirected graph give both
    orientations. With `sources` (a sample of nodes) the sum is scaled by n over their number."""
    v = nodes.select("node").distinct()
    roots = v if sources is None else sources.select("node").distinct()
    n, s = v.count(), roots.count()
    scale = n / max(1, s) / max(1, (n - 1) * (n - 2))
    return v.join(dependency_sums(edges, roots), "node", "left").select("node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_within(edges: DataFrame, nodes: DataFrame, error: float = 0.01, confidence: float = 0.95, batch: int = 64, seed: int = 1) -> DataFrame:
    """node, betweenness, error, sources: betweenness from sources drawn by hash, in batches that double, until with the given
    confidence no node is off by more than `error`, or all nodes have been sources (error 0, exact).

    Bounds are empirical Bernstein bounds on a source's share of a node, which lies in [0, 1], over all nodes and batches at once.
    Even without any variance they are too wide for the first few batches, so these are searched in one go with the next."""
    v = settle(nodes.select("node").distinct().withColumn("h", F.xxhash64(F.lit(seed), "node")))
    n, e = v.count(), settle(edges.select("src", "dst").distinct())
    order = row_ordinals(v, [F.asc("h"), F.asc("node")], "place")
    rounds = max(1, math.ceil(math.log2(max(2, n / batch))) + 1)
    tail = math.log(3 * max(1, n) * rounds / (1 - confidence))
    layout = laid_out(e, v)
    sums, done = None, 0
    while True:
        more = max(batch, 2 * done)
        while more < n and 3 * tail / more * n / max(1, n - 1) > error:
            more *= 2
        more = min(n, more)
        part = order.filter((F.col("place") >= done) & (F.col("place") < more)).select("node")
        x = max(1, n - 2)
        new = sums_from(layout, part).select("node", (F.col("delta") / x).alias("s"), (F.col("squares") / (x * x)).alias("q"))
        sums = settle(new if sums is None else sums.union(new).groupBy("node").agg(F.sum("s").alias("s"), F.sum("q").alias("q")))
        done = more
        mean, square = F.coalesce("s", F.lit(0.0)) / max(1, done), F.coalesce("q", F.lit(0.0)) / max(1, done)
        variance = F.greatest(square - mean * mean, F.lit(0.0)) * (done / max(1, done - 1))
        half = F.lit(0.0) if done >= n else F.sqrt(2 * variance * tail / done) + 3 * tail / done
        rows = settle(v.join(sums, "node", "left").select("node", (mean * n / max(1, n - 1)).alias("betweenness"), (half * n / max(1, n - 1)).alias("error"), F.lit(done).cast("long").alias("sources")))
        if done >= n or (rows.agg(F.max("error")).first()[0] or 0.0) <= error:
            return rows
