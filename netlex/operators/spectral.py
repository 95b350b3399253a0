"""Eigenvector centrality and PageRank by power iteration; one scalar row a round comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlex.functions.shared import settle


def eigenvector(sym: DataFrame, nodes: DataFrame, tol: float = 1e-12, max_rounds: int = 500, rounds: int | None = None) -> tuple[DataFrame, float]:
    """(node, value of unit L2 norm) and the leading eigenvalue (Rayleigh quotient), by iterating I + A on both
    orientations `sym`. Stops when the L1 change is below n x tol, or after exactly `rounds`."""
    v = nodes.select("node").distinct()
    n = v.count()
    e = settle(sym.select("src", "dst").repartition("src"))
    x = settle(v.withColumn("x", F.lit(1.0 / max(1, n) ** 0.5)))
    for i in range(rounds if rounds is not None else max_rounds):
        pull = e.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("y"))
        raw = settle(x.join(pull, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x")))
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        moved = raw.agg(F.sum(F.abs(F.col("x") / norm - F.col("old")))).first()[0] or 0.0
        x = raw.select("node", (F.col("x") / norm).alias("x"))
        if i % 8 == 7:
            x = settle(x)
        if rounds is None and moved < n * tol:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"eigenvector did not converge in {max_rounds} rounds")
    quotient = e.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("x").alias("y")).join(x, "node").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
    return x.withColumnRenamed("x", "eigenvector"), quotient


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tol: float = 1e-13, max_rounds: int = 500, rounds: int | None = None) -> DataFrame:
    """node, pagerank over all nodes; the mass of nodes without links is spread evenly. Stops at an L1 change below tol."""
    v = nodes.select("node").distinct()
    n = max(1, v.count())
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e = settle(e.join(out, "src").repartition("src"))
    x = settle(v.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / n).alias("x")))
    for _ in range(rounds if rounds is not None else max_rounds):
        idle = x.filter("out = 0").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        pull = e.join(x.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") / F.col("out")).alias("y"))
        new = damping * (F.coalesce("y", F.lit(0.0)) + idle / n) + (1 - damping) / n
        both = settle(x.join(pull, "node", "left").select("node", "out", new.alias("x"), F.abs(new - F.col("x")).alias("moved")))
        moved = both.agg(F.sum("moved")).first()[0] or 0.0
        x = both.drop("moved")
        if rounds is None and moved < tol:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"pagerank did not converge in {max_rounds} rounds")
    return x.select("node", F.col("x").alias("pagerank"))
