"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.functions.shared import settle


#: Edges of a task: small edge sets are not spread over more tasks than they fill, whatever the number of shuffle partitions.
EDGES = 100_000


def _large_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Every neighbour larger than a node is hung on the smallest node that this node sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _within(_within(hung, tasks).distinct(), tasks)


def _small_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """a > b: a node and its smaller neighbours are hung on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _within(_within(inner.union(least.select("a", F.col("m").alias("b"))), tasks).distinct(), tasks)


def _within(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def star_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, comp): comp is the least node of the component; nodes without edges are absent.

    Null ends and loops are dropped. Only a count and a checksum come to the driver.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e)
    # Rounds never add edges, so their number bounds all of them.
    tasks = e.count() // EDGES + 1
    tasks = tasks if tasks < int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    e, before = _within(e, tasks), None
    for _ in range(max_rounds):
        e = settle(_small_star(_large_star(e, tasks), tasks))
        now = e.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node) with comp, isolates included."""
    labels = star_labels(edges)
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
