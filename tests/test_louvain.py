"""Louvain runs to its end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlex.operators import communities, graph, held


def test_a_ring_is_moved_to_the_end(spark, monkeypatch):
    n = 400
    ring = [(i, i + 1) for i in range(n - 1)] + [(0, n - 1)]
    pairs = spark.createDataFrame(ring, "a long, b long").withColumn("weight", F.lit(1))
    of = lambda part: communities.modularity(graph.symmetrize(pairs), part).first()[0]
    part = communities.louvain(pairs)
    bounded = communities.louvain(pairs, sweeps=4, levels=2)
    assert of(part) > 0.85 > of(bounded)
    assert all(r.comm <= r.node for r in part.collect()) and part.count() == n


def test_registered_queries_bound_nothing(spark, monkeypatch, tmp_path):
    from netlex.plans import registry

    seen = []
    monkeypatch.setattr(communities, "louvain", lambda pairs, weighted, **more: seen.append(more) or pairs.select(F.col("a").alias("node"), F.col("a").alias("comm")))
    spark.createDataFrame([(1, 1, "R"), (1, 2, "R")], "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("louvain_weighted", "louvain_unweighted"):
        registry.QUERIES[name](spark, str(tmp_path))
    assert seen == [{}, {}]


@pytest.mark.parametrize("most", [held.HELD, 0])
def test_cliques_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(held, "HELD", most)
    rows = [(6 * c + i, 6 * c + j) for c in range(4) for i in range(6) for j in range(i + 1, 6)] + [(0, 6), (6, 12), (12, 18)]
    pairs = spark.createDataFrame(rows, "a long, b long").withColumn("weight", F.lit(1))
    part = communities.louvain(pairs)
    assert communities.modularity(graph.symmetrize(pairs), part).first()[0] > 0.65
    assert {r.node: r.comm for r in part.collect()} == {i: i // 6 * 6 for i in range(24)}


def test_moves_gain():
    rng = np.random.default_rng(3)
    edges = np.unique(np.sort(rng.integers(0, 60, (220, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.ones(len(src))
    comm = communities._moves(src, dst, weight, 60, 1, None)
    base = communities._quality(src, dst, weight, comm)
    assert base > communities._quality(src, dst, weight, np.arange(60)) + 0.1
