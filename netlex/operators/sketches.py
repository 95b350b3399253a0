"""Neighbourhood sketches: distances, closeness and harmonic centrality of large graphs without a row for every pair of nodes.

Every node holds REGISTERS small counters (a HyperLogLog sketch of the nodes within t hops). A round hands the counters of the
nodes that changed along their edges and keeps the greatest of each, so after t rounds a sketch covers t hops. Memory is nodes x
counters, a round's rows are the edges of changed nodes, and there are as many rounds as the longest shortest path. A single count
has a relative standard error of about 1.04 / sqrt(REGISTERS) (13 % with 64, 9 % with 128); sums over all nodes are closer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlex.functions.shared import settle

REGISTERS = 64


def _estimate(names: list[str]) -> Column:
    """Number of distinct nodes behind the registers: linear counting while many are empty, else the harmonic mean."""
    m = len(names)
    power = sum((F.pow(F.lit(2.0), -F.col(c)) for c in names[1:]), F.pow(F.lit(2.0), -F.col(names[0])))
    empty = sum(((F.col(c) == 0).cast("int") for c in names[1:]), (F.col(names[0]) == 0).cast("int"))
    bias = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    raw = bias * m * m / power
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.ln(m / empty.cast("double"))).otherwise(raw)


def neighbourhoods(edges: DataFrame, nodes: DataFrame, registers: int = REGISTERS, seed: int = 1) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(node, reached, far, inverse) and [(distance, pairs), ...] along src -> dst, all estimated: nodes that reach a node (itself
    aside), the sums of their distances and of 1 / distance; and ordered pairs at each distance. registers: a power of 2 from 16 on.

    For an undirected graph give both orientations; for distances from a node, give the edges turned round."""
    if registers < 16 or registers & (registers - 1):
        raise ValueError("registers must be a power of 2 from 16 on")
    names, bits = [f"r{i}" for i in range(registers)], int(math.log2(registers))
    e = settle(edges.select("src", "dst").filter("src <> dst").distinct().repartition("src"))
    h = F.xxhash64(F.lit(seed), "node")
    place, rest = F.pmod(h, F.lit(registers)), F.shiftrightunsigned(h, bits)
    # The position of the first set bit, from 1: 64-bit values are split so that no double is rounded.
    first = (64 - bits) - F.floor(F.log2(F.greatest(rest, F.lit(1)).cast("double") + 0.5)).cast("int")
    start = nodes.select("node").distinct().withColumns({"h_": place, "f_": F.when(rest == 0, 65 - bits).otherwise(first)})
    state = start.select("node", *(F.when(F.col("h_") == i, F.col("f_")).otherwise(0).cast("byte").alias(c) for i, c in enumerate(names)))
    zero = F.lit(0.0)
    state = settle(state.withColumn("now", _estimate(names)).withColumns({"reached": zero, "far": zero, "inverse": zero, "changed": F.lit(True)}))
    histogram: list[tuple[int, float]] = []
    t = 0
    while True:
        t += 1
        sent = state.filter("changed").select(F.col("node").alias("src"), *names).join(e, "src").groupBy(F.col("dst").alias("node")).agg(*(F.max(c).alias(f"in_{c}") for c in names))
        both = state.join(sent, "node", "left")
        grown = F.lit(False)
        for c in names:
            grown = grown | (F.coalesce(f"in_{c}", F.lit(0)) > F.col(c))
        both = both.withColumn("changed", grown).withColumns({c: F.greatest(c, F.coalesce(f"in_{c}", F.lit(0).cast("byte"))) for c in names})
        both = both.withColumn("then", F.when(F.col("changed"), F.greatest(_estimate(names), "now")).otherwise(F.col("now"))).withColumn("new", F.col("then") - F.col("now"))
        state = settle(both.select("node", *names, F.col("then").alias("now"), (F.col("reached") + F.col("new")).alias("reached"), (F.col("far") + t * F.col("new")).alias("far"), (F.col("inverse") + F.col("new") / t).alias("inverse"), "changed", "new"))
        moved, added = state.agg(F.count_if("changed"), F.sum("new")).first()
        state = state.drop("new")
        if not moved:
            return state.select("node", "reached", "far", "inverse"), histogram
        histogram.append((t, float(added or 0.0)))


def sketched_closeness(edges: DataFrame, nodes: DataFrame, registers: int = REGISTERS, seed: int = 1) -> DataFrame:
    """node, closeness, harmonic as traverse.closeness gives them, estimated; for distances from a node, edges are turned round."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near, _ = neighbourhoods(back, nodes, registers, seed)
    n = nodes.select("node").distinct().count()
    close = F.try_divide(F.col("reached") * F.col("reached"), F.col("far") * max(1, n - 1))
    return near.select("node", F.coalesce(close, F.lit(0.0)).alias("closeness"), (F.col("inverse") / max(1, n - 1)).alias("harmonic"))


def sketched_distances(edges: DataFrame, nodes: DataFrame, registers: int = REGISTERS, seed: int = 1) -> DataFrame:
    """dist, pairs: ordered pairs at each distance from 1, estimated; the last one is at most the diameter."""
    _, histogram = neighbourhoods(edges, nodes, registers, seed)
    return edges.sparkSession.createDataFrame(histogram, "dist int, pairs double")


def sketched_summary(edges: DataFrame, nodes: DataFrame, registers: int = REGISTERS, seed: int = 1) -> DataFrame:
    """avg_path, diameter (a lower bound) as traverse.distance_summary gives them, estimated."""
    rows = sketched_distances(edges, nodes, registers, seed)
    return rows.agg(F.try_divide(F.sum(F.col("dist") * F.col("pairs")), F.sum("pairs")).alias("avg_path"), F.max("dist").alias("diameter"))
